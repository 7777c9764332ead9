"""Accuracy, robustness, swap consistency and the summaries of runs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.sources.tables import staged

from .scoring import flipped, winner_from_margin
from .windows import CUTS, cut_points, exact_quantiles


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _valid() -> Column:
    return F.col("predicted_winner").isin("A", "B")


def f1(label: str, valid: Column | None = None) -> Column:
    """F1 of one label over rows with a valid prediction; 0 where it never occurs."""
    valid = _valid() if valid is None else valid
    gold, said = F.col("winner") == label, F.col("predicted_winner") == label
    hit = F.count_if(valid & gold & said)
    return share(2 * hit, F.count_if(valid & gold) + F.count_if(valid & said))


def classification(df: DataFrame, by: str = "domain") -> DataFrame:
    """Overall (null in ``by``) and per-group metrics of winner against predicted_winner in one pass.

    real_accuracy counts ties and unparseable rows as wrong; valid_accuracy is over
    A and B predictions only. The overall macro F1 is over A and B; a group's is over
    the labels that occur in its valid rows. Groups without a valid prediction are
    left out. position_bias_a is the share of A among valid predictions.
    """
    valid = _valid()
    right = F.count_if(valid & (F.col("winner") == F.col("predicted_winner")))
    n, n_valid = F.count(F.lit(1)), F.count_if(valid)
    occurs = lambda label: F.count_if(valid & ((F.col("winner") == label) | (F.col("predicted_winner") == label))) > 0
    present = [F.when(occurs(x), f1(x)) for x in ("A", "B", "Tie")]
    group_f1 = reduce(lambda x, y: x + y, (F.coalesce(p, F.lit(0.0)) for p in present)) / F.greatest(reduce(lambda x, y: x + y, (p.isNotNull().cast("int") for p in present)), F.lit(1))
    out = df.rollup(by).agg(
        F.grouping(by).alias("_all"), n.alias("n_total"), n_valid.alias("n_valid"), F.count_if(F.col("predicted_winner") == "Tie").alias("n_tie"),
        (n - n_valid - F.count_if(F.col("predicted_winner") == "Tie")).alias("n_unparseable"), share(n_valid, n).alias("parse_rate"), share(right, n).alias("real_accuracy"), share(right, n_valid).alias("valid_accuracy"),
        F.when(F.grouping(by) == 1, (f1("A") + f1("B")) / 2).otherwise(group_f1).alias("macro_f1"), share(F.count_if(F.col("predicted_winner") == "A"), n_valid).alias("position_bias_a"),
    )
    return out.filter("_all = 1 or n_valid > 0").drop("_all")


def report(df: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of A and B over valid rows."""
    valid = df.filter(_valid())
    rows = valid.select("winner", "predicted_winner", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("label"))
    gold, said = F.col("winner") == F.col("label"), F.col("predicted_winner") == F.col("label")
    hit = F.count_if(gold & said)
    return rows.groupBy("label").agg(share(hit, F.count_if(said)).alias("precision"), share(hit, F.count_if(gold)).alias("recall"), share(2 * hit, F.count_if(gold) + F.count_if(said)).alias("f1"), F.count_if(gold).alias("support"))


def score_gaps(df: DataFrame) -> DataFrame:
    """Means of the sides' scores and of their gaps, and of the absolute gaps of ties; nulls don't count."""
    gap = F.col("score_a") - F.col("score_b")
    return df.agg(F.avg("score_a").alias("avg_score_a"), F.avg("score_b").alias("avg_score_b"), F.avg(gap).alias("avg_score_gap"), F.avg(F.when(F.col("predicted_winner") == "Tie", F.abs(gap))).alias("avg_tie_score_gap"))


def robustness(original: DataFrame, perturbed: DataFrame, key: str, swapped: bool = False) -> DataFrame:
    """Overall and per-domain accuracy before and after a perturbation, drop, invariance and flip rate.

    The join fans out where the key repeats. For swapped responses the original
    prediction is flipped before it is compared. Two unparseable outputs agree.
    """
    right = perturbed.select(key, F.col("winner").alias("_w"), F.col("predicted_winner").alias("_p"))
    both = original.join(right, key)
    before = flipped(F.col("predicted_winner")) if swapped else F.col("predicted_winner")
    same = before.eqNullSafe(F.col("_p"))
    hit = lambda gold, said: F.avg(F.coalesce((F.col(gold) == F.col(said)).cast("double"), F.lit(0.0)))
    out = both.rollup("domain").agg(F.count(F.lit(1)).alias("n"), hit("winner", "predicted_winner").alias("acc_original"), hit("_w", "_p").alias("acc_perturbed"), F.avg(same.cast("double")).alias("invariance"))
    return out.withColumn("acc_drop", F.col("acc_original") - F.col("acc_perturbed")).withColumn("flip_rate", 1 - F.col("invariance"))


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, rows of keys that repeat."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n_repeated"))


def swap_category(original: Column, swapped: Column) -> Column:
    """How a pair's verdict on (A, B) fits that on (B, A)."""
    ok = original.isin("A", "B") & swapped.isin("A", "B")
    return F.when(~F.coalesce(ok, F.lit(False)), "unparseable").when(original == flipped(swapped), "consistent").when(original == swapped, "position_locked").otherwise("inconsistent")


def swap_consistency(df: DataFrame, by: str) -> DataFrame:
    """Counts of the categories, the invariance score over parseable pairs and the locked direction; overall and by a column."""
    rows = df.withColumn("_c", swap_category(F.col("original"), F.col("swapped")))
    n = lambda c: F.count_if(F.col("_c") == c)
    parsed = F.count_if(F.col("_c") != "unparseable")
    locked = F.col("_c") == "position_locked"
    return rows.rollup(by).agg(
        F.count(F.lit(1)).alias("n"), n("consistent").alias("n_consistent"), n("position_locked").alias("n_locked"), n("unparseable").alias("n_unparseable"),
        F.try_divide(n("consistent"), parsed).alias("invariance_score"), F.count_if(locked & (F.col("original") == "A")).alias("locked_first"), F.count_if(locked & (F.col("original") == "B")).alias("locked_second"),
    )


def warmup_swap(df: DataFrame) -> DataFrame:
    """Agreement, accuracy where both orders agree, strict accuracy, position bias |f(A) + f'(B) - 1|."""
    original, back = F.col("original"), flipped(F.col("swapped"))
    agree = F.coalesce((original == back) & original.isin("A", "B"), F.lit(False))
    right = agree & (original == F.col("winner"))
    first = F.avg((F.coalesce(original, F.lit("")) == "A").cast("double"))
    second = F.avg((F.coalesce(F.col("swapped"), F.lit("")) == "A").cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(agree.cast("double")).alias("agreement"), F.try_divide(F.count_if(right), F.count_if(agree)).alias("accuracy_consistent"), F.avg(right.cast("double")).alias("strict_accuracy"), F.abs(first + second - 1).alias("position_bias"))


def migration(base: DataFrame, tuned: DataFrame, key: str) -> DataFrame:
    """still_correct, fixed, regressed, still_wrong by gold winner, with the mean strength."""
    right = tuned.select(key, F.col("predicted_winner").alias("_p"))
    was = F.coalesce(F.col("predicted_winner") == F.col("winner"), F.lit(False))
    now = F.coalesce(F.col("_p") == F.col("winner"), F.lit(False))
    what = F.when(was & now, "still_correct").when(~was & now, "fixed").when(was & ~now, "regressed").otherwise("still_wrong")
    rows = base.join(right, key).withColumn("migration", what)
    return rows.groupBy("winner", "migration").agg(F.count(F.lit(1)).alias("n"), F.avg("preference_strength").alias("mean_strength"))


def confusion(df: DataFrame, labels: tuple[str, ...] = ("A", "B", "Tie")) -> DataFrame:
    """winner by predicted_winner, a column per label and one for unparseable rows."""
    count = lambda c: F.count_if(c)
    return df.groupBy("winner").agg(*(count(F.col("predicted_winner") == x).alias(f"pred_{x.lower()}") for x in labels), count(F.col("predicted_winner").isNull()).alias("pred_none"))


def threshold_sweep(margins: DataFrame, deltas: list[float]) -> DataFrame:
    """Verdict metrics at each tie threshold from stored margins; a row is repeated per threshold inside the task."""
    rows = margins.select("winner", "margin", F.explode(F.array(*map(F.lit, deltas))).alias("tie_delta"))
    rows = rows.withColumn("predicted_winner", winner_from_margin(F.col("margin"), F.col("tie_delta")))
    valid = _valid()
    right = F.count_if(valid & (F.col("winner") == F.col("predicted_winner")))
    n, n_valid = F.count(F.lit(1)), F.count_if(valid)
    return rows.groupBy("tie_delta").agg(n.alias("n_total"), n_valid.alias("n_valid"), share(n - n_valid, n).alias("tie_rate"), share(right, n_valid).alias("valid_accuracy"), share(right, n).alias("effective_accuracy"))


def _local_frontier(df: DataFrame, cost: str, value: str) -> DataFrame:
    """Without rows that another row of their partition beats. Frontiers are merged batch by batch."""

    def run(batches):
        best = np.zeros((2, 0))  # costs and values of the frontier so far, both ascending
        for batch in batches:
            c = np.nan_to_num(batch.column(0).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            v = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            every = np.concatenate([best, [c, v]], axis=1)
            every = every[:, np.lexsort((-every[1], every[0]))]
            top = np.maximum.accumulate(every[1])
            best = np.unique(every[:, every[1] >= top], axis=1)
            best = best[:, np.argsort(best[0], kind="stable")]
            at = np.searchsorted(best[0], c, side="right") - 1
            kept = batch.filter(pa.array(v >= best[1][np.maximum(at, 0)]))
            yield pa.RecordBatch.from_arrays(kept.columns[2:], names=kept.schema.names[2:])

    longest = "_" * max(map(len, df.columns))  # before the names, so that they clash with none
    return df.select(F.col(cost).cast("double").alias(f"{longest}c"), F.col(value).cast("double").alias(f"{longest}v"), *df.columns).mapInArrow(run, df.schema)


def pareto(df: DataFrame, cost: str, value: str, cuts: int = CUTS) -> DataFrame:
    """Rows that no row of the same or a lower cost beats in value; null values are dropped, null costs are the lowest.

    Each partition first drops what its own rows beat, so that little is shuffled.
    The rest falls into buckets by approximate quantiles of the cost; the best values
    of the buckets below give each bucket its start, and a window runs within a
    bucket only. Where the cuts lie doesn't change the result.
    """
    rows = staged(_local_frontier(df, cost, value), "frontier")
    at = cut_points(rows.select(F.col(cost).cast("double").alias("c")), "c", cuts)
    rows = rows.withColumn("_bucket", F.coalesce(sum(((F.col(cost) > c).cast("int") for c in at), F.lit(0)), F.lit(0)))
    below = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the buckets, at most ``cuts``
    starts = rows.groupBy("_bucket").agg(F.max(value).alias("_top")).select("_bucket", F.max("_top").over(below).alias("_start"))
    before = Window.partitionBy("_bucket").orderBy(F.col(cost), F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.greatest("_start", F.max(value).over(before)), F.lit(-1.0))
    return rows.join(F.broadcast(starts), "_bucket").withColumn("_best", best).filter(F.col(value) >= F.col("_best")).drop("_bucket", "_start", "_best")


def guarded_leaderboard(runs: DataFrame, name: str = "run") -> DataFrame:
    """Runs by real accuracy (null as 0), ranked; comparable is false where n_total or split differs between runs."""
    whole = Window.partitionBy(F.lit(1))
    same = (F.min("n_total").over(whole) == F.max("n_total").over(whole)) & (F.min("split_hash").over(whole) == F.max("split_hash").over(whole))
    rank = F.row_number().over(Window.orderBy(F.coalesce("real_accuracy", F.lit(0.0)).desc(), F.col(name)))
    return runs.withColumn("comparable", same).withColumn("place", rank)


def _correlation(x: str, y: str) -> Column:
    """Null where a column is constant; the built-in one raises there in ANSI mode."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """n and r over rows with both values; r is null without rows and NaN where a column is constant."""
    n = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
    return df.agg(n.alias("n"), F.when(n > 0, F.coalesce(_correlation(x, y), F.lit(float("nan")))).alias("r"))


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rank): the average rank of each value of each column over all rows; nulls have none.

    All columns go through one long table. Their values are counted first, so that a
    frequent value is one row, and the counts are put in order by one range exchange;
    the sums of its partitions, a row each, give each its start.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*").filter("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    ordered = staged(counts.select(F.spark_partition_id().alias("part"), "column", "value", "n"), "counts")
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions
    starts = ordered.groupBy("column", "part").agg(F.sum("n").alias("s")).select("column", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    below = F.col("start") + F.coalesce(inside, F.lit(0))
    return ordered.join(F.broadcast(starts), ["column", "part"]).select("column", "value", (below + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; null for fewer than two rows or a constant column. The source is read once."""
    both = staged(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "both")
    ranks = staged(average_ranks(both, ["x", "y"]), "ranks")
    of = lambda c: ranks.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}"))
    ranked = both.join(of("x"), "x").join(of("y"), "y")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 2, _correlation("rx", "ry")).alias("rho"))


def five_numbers(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, quartiles and range with linear interpolation; values that aren't numbers don't count."""
    rows = df.select(F.expr(f"try_cast({column} as double)").alias("x"))
    middle, low, high = (F.lit(q).cast("double") for q in exact_quantiles(rows, "x", [0.5, 0.25, 0.75]))
    return rows.agg(F.avg("x").alias("mean"), middle.alias("median"), low.alias("p25"), high.alias("p75"), F.min("x").alias("min"), F.max("x").alias("max"))


def summary_line(df: DataFrame, column: str) -> DataFrame:
    """Mean, sample deviation (0 for one row), range."""
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.when(F.count(column) == 1, F.lit(0.0)).otherwise(F.stddev_samp(column)).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
