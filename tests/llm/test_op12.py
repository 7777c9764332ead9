import hashlib
import random

import duckdb
import numpy as np
import pytest

from pairlens.llm import centroids
from pairlens.llm.topk import quantised

SCHEMA = "vec_id long, embedding array<double>, cluster string, ids int"


def brute(rows, width, k, rounds):
    """(vec_id, cluster, distance) of every vector, in Python's integers."""
    clamp = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    usable = [(i, tuple(clamp(int(np.floor(64 * float(x)))) for x in v)) for i, v in rows if i is not None and v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(usable, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r))[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((away(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        held = [[] for _ in centres]
        for _, v in usable:
            held[nearest(v)[1]].append(v)
        centres = [tuple(sum(x) // len(h) for x in zip(*h)) if h else c for c, h in zip(centres, held)]
    return sorted((i, nearest(v)[1], clamp(nearest(v)[0])) for i, v in usable), [list(c) for c in centres]


def run(spark, rows, width, k, rounds=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found, centres = centroids.clustered(quantised(df, scale=64), width, k, rounds)
    return sorted(map(tuple, found.collect())), centres


@pytest.mark.parametrize("block, leaf", [(8192, 32), (16, 4), (7, 1)])
def test_equals_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(centroids, "BLOCK", block)
    monkeypatch.setattr(centroids, "LEAF", leaf)
    r = random.Random(4)
    near = [(i, [r.choice([-3, 0, 2]) + r.gauss(0, 0.1) for _ in range(3)]) for i in range(150)]
    ties = [(i, [float(r.randint(-1, 1)) for _ in range(3)]) for i in range(300, 360)]  # many equal vectors and distances
    odd = [(None, [1.0] * 3), (500, None), (501, [1.0, None, 1.0]), (502, [float("nan")] * 3), (503, [float("inf")] * 3), (504, [1.0]), (505, []), (3, [9.0] * 3), (3, near[3][1])]
    for rows in (near, ties, near + ties + odd):
        assert run(spark, rows, 3, 6) == brute(rows, 3, 6, 3)


def test_large_components(spark, monkeypatch):
    monkeypatch.setattr(centroids, "LEAF", 2)
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) * 10 ** r.randint(0, 17) for _ in range(4)]) for i in range(60)] + [(90, [1e300] * 4), (91, [-1e300, 1.0, 2.0, 0.0])]
    assert run(spark, rows, 4, 5) == brute(rows, 4, 5, 3)
    mid = [(i, [r.uniform(-1, 1) * 2**19 for _ in range(4)]) for i in range(60)]  # exact in 64 bits, not in doubles
    assert run(spark, mid, 4, 5) == brute(mid, 4, 5, 3)


def test_few_equal_and_no_vectors(spark):
    assert run(spark, [(1, None)], 3, 4) == ([], [])
    df = spark.createDataFrame([], SCHEMA)
    assert centroids.clustered(quantised(df))[0].count() == 0
    rows = [(i, [1.5, 2.5]) for i in range(40)]
    assert run(spark, rows, 2, 16) == brute(rows, 2, 16, 3)
    assert run(spark, rows[:1], 2, 16, 0) == ([(0, 0, 0)], [[96, 160]])


def test_trees_hold_counts_sums_and_boxes():
    points = np.random.default_rng(1).integers(-(2**40), 2**40, (500, 5))
    order, nodes = centroids.build(points)
    placed = points[order]
    assert sorted(order.tolist()) == list(range(500)) and (nodes["child"] >= 0).sum() > 10
    for i in range(len(nodes["start"])):
        held = placed[nodes["start"][i] : nodes["stop"][i]]
        assert (held.min(axis=0) == nodes["low"][i]).all() and (held.max(axis=0) == nodes["high"][i]).all()
        assert (nodes["upper_sum"][i] * 2**32 + nodes["lower_sum"][i] == held.sum(axis=0)).all()
        c = nodes["child"][i]
        if c >= 0:
            assert (nodes["start"][c], nodes["stop"][c]) == (nodes["start"][i], nodes["start"][c + 1]) and nodes["stop"][c + 1] == nodes["stop"][i]


def test_nodes_are_pruned_and_assigned_whole():
    r = np.random.default_rng(2)
    points = np.concatenate([r.integers(-9, 9, (400, 4)) + 1000 * k for k in range(3)])
    order, nodes = centroids.build(points)
    walk = centroids._Walk(points[order], nodes, [[1000 * k] * 4 for k in range(3)])
    whole, rows, _ = walk.parts()
    assert len(whole) >= 3 and len(rows) < 120
    tied = centroids._Walk(points[order], nodes, [[0] * 4, [0] * 4, [1000] * 4])  # equal centroids: never pruned by each other
    assert set(tied.assigned()[0].tolist()) == {0, 2}


def test_query_of_odd_rows_equals_sql(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(64)], "x", 1) for i in range(90)] + [(5, [0.5] * 64, "y", 2), (5, [0.5] * 64, "y", 2), (200, None, None, None), (201, [1.0] * 63, "", 0), (None, [1.0] * 64, "", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = centroids.op12_centroids(spark, str(tmp_path))
    want = con.sql(centroids.ORACLE_SQL["op12_centroids"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_query_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op12_centroids(spark, str(tmp_path))
    assert got.count() == 0 and got.columns[-1] == "centroid_sha256"
