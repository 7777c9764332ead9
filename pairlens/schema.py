"""Schemas of the entities and the guards that readers apply."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_PREFERENCE = (
    "domain string, context array<struct<role:string,content:string>>, response1 string, response2 string, overall_preference int, "
    "individual_preference array<struct<score:int,reasoning:string,feedback1:string,feedback2:string>>"
)
PAIRS = "prompt_id string, domain string, context string, response_a string, response_b string, winner string, preference_strength int"
BANK = "qid int, dimension string, sub_aspect string, question_text string, definition string, source_yaml string"
ORACLE_QUESTIONS = "sample_id string, qid int, ans_a string, ans_b string, parse_fail boolean, pair_contrib double, u1_answerable int, u2_abs_contrib double, u3_decisive double, dim string, sub_aspect string, question_text string"
HUMAN_RELEVANCE = "sample_id string, qid int, h double, n_annotators int"
WEIGHTS = "sample_id string, selected_qids array<int>, importance_raw array<double>, importance_softmax array<double>, parse_ok boolean, n_missing_qids int"

#: Other names that files use for a column.
ALIASES = {"dim": ("dimension",), "selected_qids": ("ranked_qids",)}


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{what} lacks {', '.join(missing)}")
    return df


def resolve_aliases(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rename columns that are there under another known name."""
    for column in columns:
        if column not in df.columns:
            for other in ALIASES.get(column, ()):
                if other in df.columns:
                    df = df.withColumnRenamed(other, column)
                    break
    return df


def with_defaults(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add optional columns that are absent: name -> (type, value)."""
    for name, (kind, value) in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value).cast(kind))
    return df
