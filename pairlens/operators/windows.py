"""Totals and order statistics over whole tables without one task that holds the table, and broadcasts of checked size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64
PREFIX = 3  # hex digits: 4,096 buckets
SMALL = 100_000
TASK_ROWS = 1 << 17


def cut_points(df: DataFrame, column: str, cuts: int) -> list[float]:
    """Approximate quantiles of a column that cut its rows into about ``cuts`` parts; none where there are no values."""
    shares = [i / cuts for i in range(1, cuts)]
    return sorted(set(df.approxQuantile(column, shares, 0.25 / cuts))) if shares else []


def null_safe_join(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the other columns of ``few``, which has each key once; null keys meet null keys."""
    right = few.select(*(F.col(k).alias(f"_right_{k}") for k in keys), *(c for c in few.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return rows.join(right, same).drop(*(f"_right_{k}" for k in keys))


def places(df: DataFrame, keys: list[str], order: str, name: str, cuts: int = CUTS) -> DataFrame:
    """Adds a row's place, from 0, within its key by a numeric column without nulls.

    Buckets lie between approximate quantiles of ``order``; counts give each key's
    start in each bucket, and a window runs within a key's part of a bucket only.
    """
    at = cut_points(df, order, cuts)
    rows = df.withColumn("_bucket", sum(((F.col(order) > c).cast("int") for c in at), F.lit(0)))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    start = F.coalesce(F.sum("_count").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order)) - 1
    rows = null_safe_join(rows.withColumn("_inside", inside), counts.select(*keys, "_bucket", start.alias("_start")), [*keys, "_bucket"])
    return rows.withColumn(name, F.col("_start") + F.col("_inside")).drop("_bucket", "_inside", "_start")


def smallest_hashes(df: DataFrame, hash_col: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows with the smallest hex hashes, ties by columns; all rows where there are fewer.

    A histogram of the hashes' first digits, of fixed size, tells in which bucket the
    bound lies; only that bucket's rows are put in order.
    """
    prefix = F.substring(hash_col, 1, PREFIX)
    counts = sorted((r.p, r.n) for r in df.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, edge = 0, None
    for p, c in counts:
        if before + c > n:
            edge = p
            break
        before += c
    if edge is None:
        return df
    below = df.filter(prefix < edge)
    rank = F.row_number().over(Window.partitionBy(prefix).orderBy(hash_col, *ties))
    return below.unionByName(df.filter(prefix == edge).withColumn("_r", rank).filter(F.col("_r") <= n - before).drop("_r"))


def segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(i) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in marks:
            x = c.to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a].as_py() for c in marks)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def exact_quantiles(df: DataFrame, column: str, shares: list[float], cuts: int = CUTS) -> list[float | None]:
    """Exact quantiles with linear interpolation over a whole table; nulls don't count.

    Approximate quantiles cut the values into buckets, a histogram of fixed size tells
    in which of them the wanted ranks lie, and only those buckets are put in order.
    """
    rows = df.select(F.col(column).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)")
    at = cut_points(rows, "_x", cuts)
    rows = rows.withColumn("_bucket", sum(((F.col("_x") > c).cast("int") for c in at), F.lit(0)))
    counts = sorted((r["_bucket"], r["n"]) for r in rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in counts)
    if not n:
        return [None] * len(shares)
    ranks = sorted({r for q in shares for r in (int((n - 1) * q), min(n - 1, int((n - 1) * q) + 1))})
    wanted, start = {}, 0
    for bucket, c in counts:
        for r in ranks:
            if start <= r < start + c:
                wanted[bucket, r - start + 1] = r
        start += c
    ordered = rows.filter(F.col("_bucket").isin([b for b, _ in wanted])).withColumn("_r", F.row_number().over(Window.partitionBy("_bucket").orderBy("_x")))
    picked = ordered.filter(" or ".join(f"(_bucket = {b} and _r = {r})" for b, r in wanted)).collect()
    value = {wanted[r["_bucket"], r["_r"]]: r["_x"] for r in picked}
    out = []
    for q in shares:
        low = int((n - 1) * q)
        high = min(n - 1, low + 1)
        out.append(value[low] + (value[high] - value[low]) * ((n - 1) * q - low))
    return out


def one_value(df: DataFrame) -> Column:
    """The single value of a one-row table as a scalar subquery: no join, no action."""
    return df.scalar()


def small_broadcast(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A table to broadcast if it has at most ``most`` rows, else as it is, to be shuffled.

    Counting stops at the bound. For banks and other configuration, whose size Spark
    overestimates behind a join, so that it would shuffle the facts first.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, keys: list[str], rows: int, most: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by keys to as many partitions as it takes for ``most`` of the ``rows`` that a join will make of them.

    The bytes of a few narrow rows say nothing of what they grow to, and adaptive
    coalescing goes by them; a number of partitions that is asked for stays.
    """
    return df.repartition(max(1, -(-rows // most)), *keys)
