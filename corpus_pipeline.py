"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet to the shared folder and read again as the next one's docs. All but the
last return the columns of documents:

1. toxicity: documents predicted to be toxic go.
2. quality: documents predicted to be of low quality go.
3. near_duplicates: of each group of near copies the document with the smallest
   id stays (five-word shingles, similarity 0.8).
4. secrets: secrets are masked in the texts, and n_chars follows.
5. packing: the pieces of every document and their places in sequences.

Null and empty texts are neither toxic nor low-quality by any passage or term of
their own, are near copies of nothing and pack as one piece. Rows with a null id
stay in every stage. Rows with the same id and text count once from the third
stage on; rows that share an id but not a text stay. Ties between near copies go to
the smallest id. Texts of any length are read whole. An empty table gives no rows.
Extra columns, whatever their names, pass through to the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import neardup, packing, quality, secrets, toxicity
from pairlens.llm._support import staged, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.without_junk(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redacted(docs)
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Models, sketches and tokenizers can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
