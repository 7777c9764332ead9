"""Audits of scored rollouts: groups of completions of one prompt, and their replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inversions import concordant
from .joins import keep_first


def primary(df: DataFrame) -> DataFrame:
    """One row per completion: the original variant's first replicate."""
    rows = df.filter(F.coalesce("variant_type", F.lit("original")) == "original")
    return keep_first(rows, ["completion_id"], ["replicate_id"])


def group_metrics(df: DataFrame) -> DataFrame:
    """Per group: mean, population deviation and range of rewards, whether they are all equal, whether any or the best completion is right."""
    best = F.max_by("winner_correct", F.struct("reward_total", F.expr("-completion_id")))
    return df.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward_total").alias("mean"), F.stddev_pop("reward_total").alias("std"), (F.max("reward_total") - F.min("reward_total")).alias("range"),
        (F.max("reward_total") == F.min("reward_total")).alias("zero_variance"), F.bool_or("winner_correct").alias("any_correct"), best.alias("best_correct"),
    )


def best_per_group(df: DataFrame, keep: str = "true") -> DataFrame:
    """The best qualifying completion of each group: reward, then |delta|, then coverage, then the smallest id."""
    return keep_first(df.filter(keep), ["group_id"], [F.desc("reward_total"), F.desc("abs_delta"), F.desc("coverage"), "completion_id"])


def stability(df: DataFrame) -> DataFrame:
    """Per completion with at least two replicates: the span of rewards and whether they are all equal."""
    g = df.groupBy("completion_id").agg(F.count(F.lit(1)).alias("n"), (F.max("reward_total") - F.min("reward_total")).alias("span"))
    return g.filter("n >= 2").withColumn("exact", F.col("span") == 0)


def ranking_accuracy(df: DataFrame) -> DataFrame:
    """Over pairs within groups with different (correct, abs_delta, coverage): the share that rewards order the same; equal rewards count as wrong.

    Pairs are counted, never made: all of a group but those with equal gold, and the
    concordant ones among them. Rows without a reward are in pairs, but never right.
    """
    gold = ["winner_correct", "abs_delta", "coverage"]
    twos = lambda n: n * (n - 1) / 2
    ties = df.filter("group_id is not null").groupBy("group_id", *gold).agg(F.count(F.lit(1)).alias("n"))
    pairs = ties.groupBy("group_id").agg(F.sum("n").alias("n"), F.sum(twos(F.col("n"))).alias("tied")).agg(F.coalesce(F.sum(twos(F.col("n")) - F.col("tied")), F.lit(0.0)).cast("long").alias("n_pairs"))
    right = concordant(df.filter("group_id is not null"), "group_id", gold, "reward_total", "completion_id").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("right"))
    return pairs.crossJoin(right).select("n_pairs", F.try_divide(F.col("right"), F.col("n_pairs")).alias("accuracy"))  # a row each


def perturbation_deltas(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per variant: the mean change of reward against the source completion, and a warning where length alone pays."""
    base = primary(df).select(F.col("completion_id").alias("source_completion_id"), F.col("reward_total").alias("_base"))
    rows = df.filter("variant_type <> 'original'").join(base, "source_completion_id", "left").withColumn("delta", F.col("reward_total") - F.col("_base"))
    g = rows.groupBy("variant_type").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"))
    return g.withColumn("warning", (F.col("variant_type") == "length") & (F.col("mean_delta") > tolerance))


def kept_for_training(df: DataFrame, floor: float = 0.0) -> DataFrame:
    """status per group: no_pseudo, none_parsed, low_reward or kept, with the best completion's id."""
    ok = F.col("parse_ok") & (F.col("pred_winner") == F.col("pseudo_winner"))
    place = F.struct("reward_total", F.expr("-completion_id"))
    g = df.groupBy("group_id").agg(F.max(F.col("pseudo_winner").isNotNull()).alias("_p"), F.max(F.when(ok, F.col("reward_total"))).alias("best_reward"), F.max_by("completion_id", F.when(ok, place)).alias("best_id"))
    status = F.when(~F.col("_p"), "no_pseudo").when(F.col("best_reward").isNull(), "none_parsed").when(F.col("best_reward") < floor, "low_reward").otherwise("kept")
    return g.select("group_id", status.alias("status"), F.when(status == "kept", F.col("best_id")).alias("best_id"))
