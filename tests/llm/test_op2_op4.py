import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import topk, warc


LOW, HIGH = -(2**63), 2**63 - 1


def brute(rows, is_query, k):
    """By definition, over rows: ids may repeat; beyond a long, the nearest long."""
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, tuple(min(max(int(np.floor(256 * float(x))), LOW), HIGH) for x in v)))
    out = []
    for i in sorted({i for i, _ in usable if is_query(i)}):
        scores = sorted((-min(max(sum(a * b for a, b in zip(q, c)), LOW), HIGH), j) for own, q in usable if own == i for j, c in usable if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.fixture(autouse=True)
def batches(spark):
    """Small Arrow batches, so that cells span several."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("block, chunk", [(8192, 1024), (16, 5)])
def test_topk_equals_brute_force(spark, monkeypatch, block, chunk):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("QUERY_GROUP", 7 if block == 16 else 65536)):
        monkeypatch.setattr(topk, name, value)
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 9) for _ in range(8)]) for i in range(180)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [0.0] * 8), (305, [2.0]), (6, [9.0] * 8), (None, [1.0] * 8), (12, rows[12][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, length string")
    got = topk.top_k(topk.quantised(df), F.col("vec_id") % 6 == 0, 5).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 6 == 0, 5)


@pytest.mark.parametrize("block", [32768, 8])
def test_topk_of_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    r = random.Random(9)
    unit = [(i, [x / 2 for x in r.choice([(1, 1, 1, 1), (1, -1, 1, 1), (2, 0, 0, 0), (0, 0, -2, 0), (1, 1, -1, -1)])]) for i in range(60)]  # one length
    repeated = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (0, [0.5, 0.5]), (50, [1.0, 1.0]), (50, [1.0, 1.0])]
    large = [(i, [r.uniform(-1, 1) * 10 ** r.randint(5, 9) for _ in range(4)]) for i in range(100, 140)]  # products beyond 2 ** 53 and 2 ** 63
    close = [(i, [4e7 + i / 256, 1.0]) for i in range(200, 230)]  # scores that doubles can't tell apart
    beyond = [(300, [1e300, 1.0]), (301, [-1e300, 2.0]), (350, [1e18, 1e18]), (302, [0.0, 0.0])]
    for rows in (unit, repeated, large, close, beyond, unit + repeated + large + close + beyond):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, 5).collect()
        assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 50 == 0, 5)


def test_topk_of_repeated_rows_equals_sql(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (0, [0.5, 0.5]), (50, None), (50, [1.0, -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(topk.ORACLE_SQL["op2_topk"]).fetchall())
    assert sorted(map(tuple, topk.op2_topk(spark, str(tmp_path)).collect())) == want == brute(rows, lambda i: i % 50 == 0, 5)
    assert [x[2:] for x in want if x[0] == 0][:2] == [(1, 327680), (1, 196608)]


def test_topk_plans_hold_no_nested_loops(spark, capsys):
    vectors = topk.quantised(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, embedding array<double>"))
    seen = []

    def watched(write):
        def go(df, name):
            df.explain()
            seen.append(name)
            return write(df, name)

        return go

    with pytest.MonkeyPatch.context() as m:
        m.setattr(topk, "staged", watched(topk.staged))
        m.setattr(topk, "lasting", watched(topk.lasting))
        m.setattr(topk, "BLOCK", 8)
        topk.top_k(vectors, F.col("vec_id") % 50 == 0).count()
    assert "topk" in seen and "NestedLoop" not in capsys.readouterr().out


def test_topk_over_several_batches(spark):
    """More rows than an Arrow batch holds in one cell."""
    r = np.random.default_rng(2)
    m = r.standard_normal((3000, 6)) * r.uniform(0.2, 3, (3000, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>")
    got = topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0).collect()
    q = np.floor(256 * m).astype(np.int64)
    want = []
    for i in range(0, 3000, 50):
        s = q @ q[i]
        order = sorted((-int(s[j]), j) for j in range(3000) if j != i)[:5]
        want += [(i, k, j, -x) for k, (x, j) in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_of_few_and_large(spark):
    df = spark.createDataFrame([(0, [1e12, -1e12]), (50, [1e12, 1.0]), (51, [-3e11, 5e11])], "vec_id long, embedding array<double>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    small = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(topk.quantised(small), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("vec_id") == 0).count() == 0
    got = topk.top_k(topk.quantised(spark.createDataFrame([(i, [x / 1e6 for x in v]) for i, v in rows], df.schema)), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute([(i, [x / 1e6 for x in v]) for i, v in rows], lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("name, module, query", [("op2_topk", topk, topk.op2_topk), ("op4_warc", warc, warc.op4_warc)])
def test_queries_equal_sql(spark, sf, name, module, query):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(module.ORACLE_SQL[name])
    got = query(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_audit_finds_each_kind_of_damage(spark):
    rows = [(f"f{i % 3}", 1000 * i, 900, f"record {i}") for i in range(300)]
    left = spark.createDataFrame(rows, "file string, offset long, length long, record string")
    other = [(f, o, n, "rotten" if o == 7000 else r) for f, o, n, r in rows if o != 9000] + [("f9", 5, 3, "new")]
    right = spark.createDataFrame(other, left.schema)
    assert sorted((r.file, r.offset, r.status) for r in warc.audit(left, right).collect()) == [("f0", 9000, "missing"), ("f1", 7000, "corrupt"), ("f9", 5, "extra")]
    assert warc.audit(left, left.union(left)).count() == 0
    assert warc.audit(left, left.limit(0)).count() == 300
    assert warc.audit(left.limit(0), left.limit(0)).count() == 0


def test_archives_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", "é"), (2, "u", "é"), (None, "v", "x")], "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("hash", F.lit("x"))
    rows = warc.archived(pages).collect()
    assert len(rows) == 4 and all(len(r.record.encode()) == r.length for r in rows)
    assert warc.archived(pages.limit(0)).count() == 0
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file, []).append((r.offset, r.length))
    for held in by_file.values():  # gapless from 0
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
    assert warc.audit(warc.archived(pages), warc.placed(pages)).count() == 0


def test_files_of_one_id_are_cut(spark, tmp_path):
    """3,000 different pages with one id, 2,000 equal ones, and pages without id."""
    rows = [(7, f"u{i}", f"page {i}") for i in range(3000)] + [(300, "u", "same")] * 2000 + [(None, "n", f"page {i % 50}") for i in range(300)] + [(i, "u", "x") for i in range(1000, 1400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    placed = warc.placed(pages).collect()
    assert len(placed) == len(rows) == len({(r.file, r.offset) for r in placed})
    counts = {}
    for r in placed:
        if r.id == 7:
            counts[r.file] = counts.get(r.file, 0) + 1
    assert len(counts) > 8 and max(counts.values()) <= warc.FILE_RECORDS
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(warc.ORACLE_SQL["op4_warc"]).fetchall(), key=str)
    assert sorted(map(tuple, warc.op4_warc(spark, str(tmp_path)).collect()), key=str) == want and len(want) > 20


@pytest.mark.parametrize("files, levels", [(3, 1), (40, 2), (600, 3)])
def test_levels_of_buckets(spark, monkeypatch, files, levels):
    monkeypatch.setattr(warc, "FILES", 2)
    monkeypatch.setattr(warc, "DIGITS", 1)
    assert warc.bucket_levels(files) == levels
    left = spark.createDataFrame([(f"f{i}", 0, 9, f"r{i}", "x") for i in range(files)], "file string, offset long, length long, record string, b1 string")
    right = left.filter("file <> 'f1'").withColumn("record", F.when(F.col("file") == "f2", "bad").otherwise(F.col("record")))
    assert sorted((r.file, r.status) for r in warc.audit(left, right).collect()) == [("f1", "missing"), ("f2", "corrupt")]
