"""Ranking and picking of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.text import let


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds a rank from 1 within keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def local_numbers(active: DataFrame) -> DataFrame:
    """Adds q: the number of a question within its domain's active questions, from 1."""
    return ranked(active, ["domain"], [F.col("qid")], "q")


def domain_ranking(utilities: DataFrame, active: DataFrame) -> DataFrame:
    """domain, qid, mean_u2, rank: active questions by mean size of contribution, those never seen last."""
    means = utilities.groupBy("domain", "qid").agg(F.avg("u2_abs_contrib").alias("mean_u2"))
    rows = active.select("domain", "qid").join(means, ["domain", "qid"], "left").withColumn("mean_u2", F.coalesce("mean_u2", F.lit(0.0)))
    return ranked(rows, ["domain"], [F.desc("mean_u2"), F.col("qid")])


def completed(ranking: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """keys, qid, rank: ranked active questions first, then the other active ones by qid. ``active``: keys, qid."""
    rows = active.join(ranking.withColumnRenamed("rank", "_r"), [*keys, "qid"], "left")
    return ranked(rows, keys, [F.col("_r").asc_nulls_last(), F.col("qid")]).drop("_r")


def top_k_with_quota(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k picks per key, each dimension first getting k // dimensions of them; rows: keys, qid, dimension, rank.

    Dimensions count in order of their first appearance in the ranking. Adds
    phase (1 quota, 2 fill) and pick (1 to k): quota picks by dimension, then the
    fill by rank.
    """
    whole = Window.partitionBy(*keys)
    by_dim = Window.partitionBy(*keys, "dimension")
    rows = rows.withColumn("_first", F.min("rank").over(by_dim)).withColumn("_in", F.row_number().over(by_dim.orderBy("rank")))
    rows = rows.withColumn("_dims", F.size(F.collect_set("dimension").over(whole))).withColumn("_k", F.least(F.lit(k), F.count(F.lit(1)).over(whole)))
    rows = rows.withColumn("phase", F.when(F.col("_in") <= F.floor(F.col("_k") / F.col("_dims")), 1).otherwise(2))
    order = [F.col("phase"), F.when(F.col("phase") == 1, F.col("_first")).otherwise(0), F.col("rank")]
    return ranked(rows, keys, order, "pick").filter(F.col("pick") <= F.col("_k")).drop("_first", "_in", "_dims", "_k")


def capped(rows: DataFrame, keys: list[str], group: str, cap: int, k: int) -> DataFrame:
    """All rows in a new order (place): up to k rows by rank with at most ``cap`` of a group, then the delayed ones by rank."""
    rows = ranked(rows, [*keys, group], [F.col("rank")], "_in")
    fits = (F.col("_in") <= cap).cast("int")
    so_far = F.sum(fits).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    taken = (fits == 1) & (so_far <= k)
    rows = rows.withColumn("selected", taken)
    return ranked(rows, keys, [F.desc("selected"), F.col("rank")], "place").drop("_in")


def question_priors(rows: DataFrame, min_support: int = 5) -> DataFrame:
    """Per qid: n, n_nonzero, nonzero_rate, direction_accuracy, prior; rows: qid, winner, c (A-positive contribution).

    A question with fewer than ``min_support`` nonzero votes counts as undecided (0.5).
    """
    votes = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") != 0).alias("n_nonzero"), F.count_if(((F.col("c") > 0) & (F.col("winner") == "A")) | ((F.col("c") < 0) & (F.col("winner") == "B"))).alias("n_right"))
    accuracy = F.when(F.col("n_nonzero") >= min_support, F.col("n_right") / F.nullif("n_nonzero", F.lit(0))).otherwise(0.5)
    rate = F.col("n_nonzero") / F.col("n")
    return votes.select("qid", "n", "n_nonzero", rate.alias("nonzero_rate"), accuracy.alias("direction_accuracy"), (rate * F.greatest(accuracy - 0.5, F.lit(0.0))).alias("prior"))


def reranked(rows: DataFrame, keys: list[str], priors: DataFrame, a: float = 1.0, b: float = 1.0, eps: float = 0.05) -> DataFrame:
    """Adds score = (1 / rank)^a (eps + prior)^b and new_rank, ties by rank; rows: keys, qid, rank (from 1)."""
    rows = rows.join(priors.select("qid", "prior"), "qid", "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    rows = rows.withColumn("score", F.pow(1 / F.col("rank"), F.lit(a)) * F.pow(eps + F.col("prior"), F.lit(b)))
    return ranked(rows, keys, [F.desc("score"), F.col("rank")], "new_rank")


def shuffled(rows: DataFrame, keys: list[str], seed: int, item: str = "qid") -> DataFrame:
    """A stable shuffle per key: ranks by a hash of seed, key and item."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in keys), F.col(item).cast("string")), 256)
    return ranked(rows, keys, [order, F.col(item)])


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array, shifted by its maximum; uniform where the sum isn't positive."""
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    total = lambda powers: F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    shares = lambda powers: let(total(powers), lambda t: F.transform(powers, lambda p: F.when(t > 0, p / t).otherwise(1 / F.size(powers))))
    powers = let(values, lambda xs: let(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp((x - top) / temperature))))
    return let(powers, shares)


def clamped(importance: Column, low: float = 0.0, high: float = 5.0, missing: float = 0.0) -> Column:
    return F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), importance)), F.lit(missing))


def alignment(selected: Column, asked: Column, relevant: Column) -> tuple[Column, Column]:
    """Shares of a nonempty relevant set that were selected and asked; null where it is empty."""
    share = lambda x: F.try_divide(F.size(F.array_intersect(x, relevant)), F.size(F.array_distinct(relevant)))
    return share(selected), share(asked)


def ndcg(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per key NDCG@k with gains 2^g - 1; rows: keys, rank (predicted, from 1), gain, qid. 0 where the ideal is 0."""
    rows = ranked(rows, keys, [F.desc("gain"), F.col("qid")], "_ideal")
    part = lambda place: F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col(place) + 1)).otherwise(0.0))
    return rows.groupBy(*keys).agg(part("rank").alias("dcg"), part("_ideal").alias("idcg")).select(*keys, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def retrieval(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per key with a positive gain: recall, precision at k of the positive set; rows: keys, rank, gain."""
    hit = F.count_if((F.col("rank") <= k) & (F.col("gain") > 0))
    return rows.groupBy(*keys).agg(hit.alias("_h"), F.count_if(F.col("gain") > 0).alias("_p")).filter("_p > 0").select(*keys, (F.col("_h") / F.col("_p")).alias("recall"), (F.col("_h") / k).alias("precision"))


def list_mle(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the ListMLE loss of scores in the order of rank; rows: keys, rank, score."""
    rest = Window.partitionBy(*keys).orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    top = F.max("score").over(Window.partitionBy(*keys))
    rows = rows.withColumn("_m", top)
    rows = rows.withColumn("_l", F.log(F.sum(F.exp(F.col("score") - F.col("_m"))).over(rest)) + F.col("_m") - F.col("score"))
    return rows.groupBy(*keys).agg(F.sum("_l").alias("loss"))


def contrastive_gate(rows: DataFrame, keys: list[str], k: int, least: int) -> DataFrame:
    """Per key: how many of the k most relevant questions point to the gold winner, and whether that is too few; rows: keys, qid, h, aligned."""
    rows = ranked(rows, keys, [F.desc("h"), F.col("qid")], "_r")
    return rows.groupBy(*keys).agg(F.count_if((F.col("_r") <= k) & (F.col("aligned") > 0)).alias("n_aligned")).withColumn("gated", F.col("n_aligned") < least)
