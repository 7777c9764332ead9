"""Splits, samples and perturbations in the order of hashes: reproducible on any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import flipped
from .windows import PREFIX, null_safe_join, one_value, smallest_hashes


def hash_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by colons; its order is a shuffle."""
    return F.sha2(F.concat_ws(":", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts)), 256)


def hash_share(*parts: Column | str) -> Column:
    """A number from 0 to 1 of the parts' hash, 28 bits of it."""
    return F.conv(F.substring(hash_key(*parts), 1, 7), 16, 10).cast("long") / float(1 << 28)


def swapped(pairs: DataFrame) -> DataFrame:
    """The responses exchanged and the winner flipped; other columns stay."""
    other = {"response_a": F.col("response_b"), "response_b": F.col("response_a"), "winner": flipped(F.col("winner"))}
    return pairs.select(*(other.get(c, F.col(c)).alias(c) for c in pairs.columns))


def doubled(pairs: DataFrame) -> DataFrame:
    """Pairs and their swapped form, told apart by swap_flag."""
    return pairs.withColumn("swap_flag", F.lit(False)).unionByName(swapped(pairs).withColumn("swap_flag", F.lit(True)))


def _smallest(df: DataFrame, keys: list[str], order: Column, n: Column | int) -> DataFrame:
    """The ``n`` rows of each key with the smallest hashes.

    A histogram of the hashes' first digits, of fixed size for a key, tells which
    buckets can't be among them; only the rest, the sample and a bucket at most, is
    put in order, whatever the size of a key.
    """
    rows = df.withColumns({"_h": order, "_n": n if isinstance(n, Column) else F.lit(n)}).withColumn("_p", F.substring("_h", 1, PREFIX))
    counts = rows.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = null_safe_join(rows, counts.select(*keys, "_p", before.alias("_b")), [*keys, "_p"]).filter(F.col("_b") < F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= F.col("_n")).select(*df.columns)


def group_split(df: DataFrame, group: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds split: dev for the int(n * ratio) groups with the smallest hashes, train for the others.

    The bound is the largest hash of the chosen groups, a scalar subquery; groups are
    put in order in one bucket of their hashes only.
    """
    groups = df.select(group).distinct().select(group, hash_key(F.lit(seed), group).alias("_h"))
    size = int(groups.count() * ratio)
    if not size:
        return df.withColumn("split", F.lit("train"))
    edge = one_value(smallest_hashes(groups, "_h", size, [group]).agg(F.max("_h")))
    return df.withColumn("split", F.when(hash_key(F.lit(seed), group) <= edge, "dev").otherwise("train"))


def fixed_size(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest hashes of their key; all rows where there are fewer."""
    return smallest_hashes(df.withColumn("_h", hash_key(F.lit(seed), key)), "_h", n, [key]).drop("_h")


def allocation(df: DataFrame, strata: list[str], total: int, least: int = 0) -> DataFrame:
    """strata, size, take: largest remainders of total * size / n, at most the stratum, at least ``least``; what strata can't hold goes to the largest with room.

    Strata are few; their counts are ordered in one task.
    """
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy(F.lit(1))
    quota = F.col("size") * F.lit(total) / F.sum("size").over(whole)
    rows = counts.withColumn("_q", quota).withColumn("take", F.greatest(F.floor("_q"), F.lit(least)))
    left = F.lit(total) - F.sum("take").over(whole)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy((F.col("_q") - F.floor("_q")).desc(), *strata))
    rows = rows.withColumn("_left", left).withColumn("_p", place).withColumn("take", F.least(F.col("size"), F.col("take") + F.when(F.col("_p") <= F.col("_left"), 1).otherwise(0)))
    over = F.greatest(F.lit(0), F.least(F.lit(total), F.sum("size").over(whole)) - F.sum("take").over(whole))
    room = F.col("size") - F.col("take")
    before = F.coalesce(F.sum(room).over(Window.partitionBy(F.lit(1)).orderBy(F.desc("size"), *strata).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_o", over).withColumn("_b", before)
    return rows.select(*strata, "size", (F.col("take") + F.greatest(F.lit(0), F.least(room, F.col("_o") - F.col("_b")))).cast("long").alias("take"))


def stratified(df: DataFrame, strata: list[str], key: str, total: int, seed: int = 42, least: int = 0) -> DataFrame:
    """An exact sample by strata: each stratum's rows with the smallest hashes."""
    rows = df.join(allocation(df, strata, total, least), strata)
    return _smallest(rows, strata, hash_key(F.lit(seed), key), F.col("take")).select(*df.columns)


def per_stratum(df: DataFrame, stratum: str, sizes: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """A given number of rows of each stratum, fewer where it has fewer."""
    n = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col(stratum)), F.lit(0))
    return _smallest(df.filter(F.col(stratum).isin(*sizes)), [stratum], hash_key(F.lit(seed), key), n)


def per_group_with_fill(df: DataFrame, group: str, key: str, each: int, total: int, seed: int = 42) -> DataFrame:
    """Up to ``each`` rows of every group, then rows of any group up to ``total``; adds filled. For small tables."""
    h = hash_key(F.lit(seed), key)
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(h)))
    order = Window.orderBy((F.col("_r") > each).cast("int"), h)
    return rows.withColumn("filled", F.col("_r") > each).withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= total).drop("_r", "_p")


def negatives(df: DataFrame, keys: list[str], item: str, positive: Column, ratio: float, least: int, seed: int = 42) -> DataFrame:
    """All positives and min(max(least, ratio * positives), pool) negatives per key, in the order of hashes."""
    rows = df.withColumn("_pos", positive)
    n = F.greatest(F.lit(least), F.ceil(F.count_if(F.col("_pos")).over(Window.partitionBy(*keys)) * ratio))
    rows = rows.withColumn("_n", n).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_pos").orderBy(hash_key(F.lit(seed), *keys, item))))
    return rows.filter(F.col("_pos") | (F.col("_r") <= F.col("_n"))).drop("_pos", "_n", "_r")


def ablated(bank: DataFrame, dropped: str | None = None, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """A bank without a dimension, or with max(1, int(n * fraction)) questions of each sub-aspect."""
    rows = bank if dropped is None else bank.filter(F.col("dimension") != dropped)
    if fraction >= 1:
        return rows
    group = ["dimension", "sub_aspect"]
    rows = rows.withColumn("_n", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*group)) * fraction)))
    return _smallest(rows, group, hash_key(F.lit(seed), "qid"), F.col("_n")).drop("_n")


#: Frames that a response is put in by the format perturbation.
FORMATS = (("", ""), ("Answer:\n\n", ""), ("- ", "\n"), ("```\n", "\n```"))


def reformatted(pairs: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Both responses in one of four frames, chosen by the pair's hash; adds template."""
    i = F.floor(hash_share(F.lit(seed), key) * len(FORMATS)).cast("int")
    pick = lambda j: F.element_at(F.array(*(F.lit(f[j]) for f in FORMATS)), F.col("template") + 1)
    rows = pairs.withColumn("template", i)
    return rows.withColumn("response_a", F.concat(pick(0), "response_a", pick(1))).withColumn("response_b", F.concat(pick(0), "response_b", pick(1)))


def verbose(pairs: DataFrame, rewritten: Column, verified: Column) -> DataFrame:
    """The losing side replaced by a longer rewrite, where a verifier found nothing new in it; ties go."""
    rows = pairs.filter(F.col("winner").isin("A", "B") & (verified == "no"))
    return rows.withColumn("response_a", F.when(F.col("winner") == "B", rewritten).otherwise(F.col("response_a"))).withColumn("response_b", F.when(F.col("winner") == "A", rewritten).otherwise(F.col("response_b")))
