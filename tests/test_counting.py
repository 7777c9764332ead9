import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import inversions, rollouts
from pairlens.operators import metrics as M


@pytest.fixture(params=[1, 3, 9])
def parts(spark, request):
    """Plans over a number of shuffle partitions that isn't reduced."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ascents():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 50, 200):
        v = [r.randint(0, 9) for _ in range(n)]
        assert inversions.ascents(np.array(v, float)) == sum(a < b for a, b in combinations(v, 2))


def rank_accuracy(rows):
    gold = lambda r: tuple((x is not None, x or 0) for x in r[2:5])
    pairs = [(a, b) for a, b in combinations([r for r in rows if r[0] is not None], 2) if a[0] == b[0] and gold(a) != gold(b)]
    right = sum(a[5] is not None and b[5] is not None and (gold(a) > gold(b)) == (a[5] > b[5]) and a[5] != b[5] for a, b in pairs)
    return len(pairs), right / len(pairs) if pairs else None


SCHEMA = "group_id int, completion_id long, winner_correct boolean, abs_delta double, coverage double, reward_total double"


def test_ranking_accuracy_equals_all_pairs(spark, parts):
    r = random.Random(parts)
    rows = [(0 if i < 150 else i % 7, i, r.random() < 0.5, r.randint(0, 3) / 4, r.randint(0, 2) / 2, r.choice([None, *[k / 8 for k in range(8)]])) for i in range(260)]
    rows += [(9, 900, None, None, None, 0.5), (9, 901, True, None, 1.0, 0.25), (None, 902, True, 1.0, 1.0, 1.0), (None, 903, False, 1.0, 1.0, 1.0), (8, 904, True, 1.0, 1.0, 1.0)]
    r.shuffle(rows)
    got = rollouts.ranking_accuracy(spark.createDataFrame(rows, SCHEMA)).collect()
    n, share = rank_accuracy(rows)
    assert len(got) == 1 and got[0].n_pairs == n and got[0].accuracy == pytest.approx(share)
    same = rollouts.ranking_accuracy(spark.createDataFrame([x[:2] + (True, 1.0, 1.0) + x[5:] for x in rows], SCHEMA)).first()
    assert same.n_pairs == 0 and same.accuracy is None
    assert rollouts.ranking_accuracy(spark.createDataFrame([], SCHEMA)).first().n_pairs == 0


def test_one_large_group(spark, parts):
    """300,000 rollouts of one group; all pairs would be 45 billion."""
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("group_id"), F.col("id").alias("completion_id"), F.lit(True).alias("winner_correct"), F.col("id").cast("double").alias("abs_delta"), F.lit(0.0).alias("coverage"), (F.col("id") * 7919 % 1009 / 8).alias("reward_total"))
    began = time.time()
    got = rollouts.ranking_accuracy(df).first()
    want = inversions.ascents(np.arange(n) * 7919 % 1009)
    assert got.n_pairs == n * (n - 1) // 2 and got.accuracy == pytest.approx(want / got.n_pairs, rel=1e-12)
    assert time.time() - began < 60


def test_spearman_equals_pandas(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice([None, 0.0, 0.0, 0.0, r.gauss(0, 1)]), r.randint(-3, 3)) for _ in range(400)] + [(1.0, None)]
    df = spark.createDataFrame(rows, "x double, y int")
    want = df.toPandas().dropna().corr(method="spearman").iloc[0, 1]
    got = M.spearman(df, "x", "y").first()
    assert got.rho == pytest.approx(want, abs=1e-12) and got.n == sum(a is not None and b is not None for a, b in rows)
    assert M.spearman(df.limit(0), "x", "y").first().rho is None
    assert M.spearman(spark.createDataFrame([(1.0, 2), (1.0, 3)], "x double, y int"), "x", "y").first().rho is None


def test_pearson_of_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    got = M.pearson(df, "x", "y").first()
    assert got.n == 2 and np.isnan(got.r)
    assert M.pearson(df.filter("y is null"), "x", "y").first().r is None
    assert M.pearson(df.withColumn("z", F.col("y") * 2), "y", "z").first().r == pytest.approx(1)


def frontier(rows):
    best = lambda c: max((v for d, v in rows if v is not None and (d is None or c is not None and d <= c)), default=-1.0)
    return sorted(((c, v) for c, v in rows if v is not None and v >= max(best(c), -1.0)), key=str)


@pytest.mark.parametrize("cuts", [1, 4, 64])
def test_pareto_equals_the_rule(spark, parts, cuts):
    r = random.Random(cuts)
    for rows in (
        [(r.randint(0, 20), r.randint(0, 20) / 20) for _ in range(150)] + [(None, 0.05), (3, None), (None, None), (5, -2.0)],
        [(i, i / 100) for i in range(100)],  # all rows are on the frontier
        [(i, -i / 100) for i in range(100)],
        [(1, 0.5)] * 5,
        [(1, -5.0)],
        [],
    ):
        df = spark.createDataFrame([(c, v, "x") for c, v in rows], "k int, value double, _c string").repartition(4)
        assert sorted(((x.k, x.value) for x in M.pareto(df, "k", "value", cuts).collect()), key=str) == frontier(rows)
