import random

import pytest

from pairlens.operators import packing

SCHEMA = "job string, n long, bytes long, tokens int"


def fold(rows, budgets):
    """The rule: row by row."""
    out, now = [], None
    for job, n, *sizes in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] or 0, r[3] or 0)):
        sizes = [s or 0 for s in sizes]
        if (job,) != now:
            now, shard, total, empty = (job,), 0, [0] * len(sizes), True
        if not empty and any(t + s > b for t, s, b in zip(total, sizes, budgets)):
            shard, total = shard + 1, [0] * len(sizes)
        total, empty = [t + s for t, s in zip(total, sizes)], False
        out.append((job, n, *sizes, shard))
    return out


def check(spark, rows, budgets, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = packing.packed(spark.createDataFrame(rows, SCHEMA), "job", ["n"], {"bytes": budgets[0], "tokens": budgets[1]}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(fold(rows, budgets), key=key)
    return got


@pytest.mark.parametrize("partitions", [1, 4, 13])
@pytest.mark.parametrize("budgets", [(100, 100), (100, 10**9), (40, 25), (5000, 900), (10**9, 10**9)])
def test_equals_the_fold(spark, partitions, budgets):
    r = random.Random(partitions * budgets[0] + budgets[1])
    rows = [("hot", i, r.randint(0, 40), r.randint(0, 25)) for i in range(400)] + [(r.choice("abc"), i, r.randint(1, 40), r.randint(1, 25)) for i in range(60)]
    rows += [(None, 1, 3, 4), (None, 2, None, None), ("zero", 1, 0, 0), ("zero", 2, 0, 0), ("one", 7, 40, 25)]
    r.shuffle(rows)
    got = check(spark, rows, budgets, partitions)
    assert max(x.shard for x in got) == (0 if budgets[0] == 10**9 else max(x[-1] for x in fold(rows, budgets)))


def test_one_job_over_many_partitions_is_cut_in_parallel(spark):
    """Shards longer than a partition and shorter ones; no task sees the whole job."""
    rows = [("j", i, 1 + i % 3, 1) for i in range(600)]
    for budget in (3, 50, 700):
        check(spark, rows, (budget, 10**9), 16)


def test_over_budget_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 5, 1), ("a", 2, 11, 1)], SCHEMA)
    with pytest.raises(packing.OverBudget):
        packing.packed(df, "job", ["n"], {"bytes": 10, "tokens": 10})
    assert packing.packed(df.limit(0), "job", ["n"], {"bytes": 10}).count() == 0
    assert [r.shard for r in packing.packed(df, "job", ["n"], {"bytes": 11}).orderBy("n").collect()] == [0, 1]
