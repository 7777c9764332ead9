"""Readers and writers of question banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NESTED = "dimension string, definition string, sub_aspects map<string,struct<filtered_questions:array<string>,original_count:int,removed_count:int,seed_question:string>>"


def number_questions(rows: DataFrame, order: list[str], name: str = "qid") -> DataFrame:
    """Number the questions of a bank from 1. A bank has hundreds of rows, so that one partition orders it."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def flat_bank(nested: DataFrame, source: Column | None = None) -> DataFrame:
    """qid, dimension, sub_aspect, question_text, definition, source_yaml of a nested bank.

    Files count in order of name, sub-aspects and questions in order of their
    place; a text counts once within its sub-aspect. ``nested`` has file, dimension,
    definition and sub_aspects: array<struct<name, questions>>.
    """
    file = F.col("file") if source is None else source
    subs = nested.select(file.alias("source_yaml"), "dimension", "definition", F.posexplode("sub_aspects").alias("s", "sub"))
    rows = subs.select("source_yaml", "dimension", "definition", "s", F.col("sub.name").alias("sub_aspect"), F.posexplode(F.array_distinct(F.transform("sub.questions", F.trim))).alias("q", "question_text"))
    rows = rows.filter("question_text <> ''")
    return number_questions(rows, ["source_yaml", "s", "q"]).select("qid", "dimension", "sub_aspect", "question_text", "definition", "source_yaml")


def read_yaml_bank(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """A nested bank of YAML texts by file name: dimension, definition, sub_aspects with filtered_questions or a list."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    rows = []
    for file in sorted(texts):
        data = yaml.safe_load(texts[file]) or {}
        subs = data.get("sub_aspects") or {}
        named = [(str(k), [str(q) for q in ((v or {}).get("filtered_questions", []) if isinstance(v, dict) else v or [])]) for k, v in subs.items()]
        rows.append((file, str(data.get("dimension") or file.rsplit(".", 1)[0].removesuffix("_filtered")), data.get("definition"), named))
    return spark.createDataFrame(rows, "file string, dimension string, definition string, sub_aspects array<struct<name:string,questions:array<string>>>")


def without_dropped(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """dimension, sub_aspect, questions, original_count, removed_count after dropping (dimension, question_text) rows."""
    flags = rows.join(dropped.select("dimension", "question_text").distinct().withColumn("gone", F.lit(True)), ["dimension", "question_text"], "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("gone").isNull(), F.struct("qid", "question_text"))))
    return flags.groupBy("dimension", "sub_aspect").agg(F.transform(kept, lambda x: x["question_text"]).alias("questions"), F.count(F.lit(1)).alias("original_count"), F.count("gone").alias("removed_count"))


def emptied_dimensions(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Dimensions that a drop would leave without questions: a writer must refuse."""
    left = rows.join(dropped.select("dimension", "question_text"), ["dimension", "question_text"], "left_anti")
    return rows.select("dimension").distinct().join(left.select("dimension"), "dimension", "left_anti")
