"""Joins with the semantics that the pipelines rely on, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class JoinKeyError(ValueError):
    """A join's key is not what it must be."""


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.desc(c) for c in order])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def lookup(df: DataFrame, other: DataFrame, keys: list[str], order: list[Column | str], fill: dict[str, object] | None = None) -> DataFrame:
    """Left join to the first row of each key; rows are neither lost nor multiplied. ``fill``: values for what isn't found."""
    out = df.join(keep_first(other, keys, order), keys, "left")
    return out.fillna(fill) if fill else out


def one_to_one(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join that raises where a key repeats on either side."""
    for side, name in ((df, "left"), (other, "right")):
        if not repeated_keys(side, keys).isEmpty():
            raise JoinKeyError(f"the {name} side repeats {', '.join(keys)}")
    return df.join(other, keys, how)


def missing_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a partner: what a completeness check complains about."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def require_complete(df: DataFrame, other: DataFrame, keys: list[str], what: str) -> DataFrame:
    if not missing_keys(df, other, keys).isEmpty():
        raise JoinKeyError(f"some rows have no {what}")
    return df


def require_disjoint(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The leak guard: raises if a key is on both sides."""
    if not left.join(right.select(*keys).distinct(), keys, "left_semi").isEmpty():
        raise JoinKeyError(f"{what} overlap")
    return left


def upserted(base: DataFrame, layers: list[DataFrame], key: str, allow_new: bool = False) -> DataFrame:
    """Whole samples replaced by the last layer that has them; unknown samples raise unless allowed.

    One shuffle: rows carry their layer's number, and a window keeps a key's highest.
    """
    if not allow_new:
        for layer in layers:
            if not missing_keys(layer, base, [key]).isEmpty():
                raise JoinKeyError("a layer has unknown samples")
    rows = base.withColumn("_layer", F.lit(0))
    for i, layer in enumerate(layers, 1):
        rows = rows.unionByName(layer.withColumn("_layer", F.lit(i)))
    top = F.max("_layer").over(Window.partitionBy(key))
    return rows.withColumn("_top", top).filter("_layer = _top").drop("_layer", "_top")


def human_relevance(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, qid, h, n_annotators: the share of usable annotators that mention a question; rows: keys, qids, ok."""
    usable = F.col("ok") & F.col("qids").isNotNull()
    rows = annotations.filter(usable).withColumn("n_annotators", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    mentions = rows.select(*keys, "n_annotators", F.explode(F.array_distinct("qids")).alias("qid"))
    return mentions.groupBy(*keys, "qid", "n_annotators").agg(F.count(F.lit(1)).alias("c")).select(*keys, "qid", (F.col("c") / F.col("n_annotators")).alias("h"), "n_annotators")


def duplicates(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that repeat: number of rows and, for each other column, whether its values differ."""
    differ = [(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) > 1).alias(f"{c}_differs") for c in columns]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *differ).filter("n > 1")
