"""Readers, writers, the judge connector and the stream."""

import pytest
from pyspark.sql import functions as F

from pairlens.sources import connector as C
from pairlens.sources import tables as T
from pairlens.streaming import judgements


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, t string")
    T.write_table(df, f"{tmp_path}/dev.parquet")
    assert T.read_split(spark, str(tmp_path), "dev", columns=["id"]).columns == ["id"]
    with pytest.raises(T.MissingSplit):
        T.read_split(spark, str(tmp_path), "none")
    with pytest.raises(ValueError):
        T.read_split(spark, str(tmp_path), "dev", columns=["x"])
    T.write_csv(df, f"{tmp_path}/c")
    assert T.read_csv(spark, f"{tmp_path}/c", "id int, t string").count() == 2
    assert "| 1 | a\\|b |" in T.markdown(df, "x") and len(T.peek(df)) == 2
    with pytest.raises(ValueError):
        T.markdown(df, "x", limit=1)
    assert T.file_hashes(spark, f"{tmp_path}/dev.parquet/*.parquet").count() >= 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": {"c": "d"}}\n\n{broken\n{"a": 2}\n')
    rows = T.read_json_lines(spark, f"{tmp_path}/x.jsonl", "a int, b struct<c:string>").collect()
    assert sorted(r.a for r in rows) == [1, 2]
    with pytest.raises(Exception):
        T.read_json_lines(spark, f"{tmp_path}/x.jsonl", "a int", skip_malformed=False).collect()
    (tmp_path / "m.json").write_text('{\n "n_total": 3,\n "per_domain": {"x": {"n": 1}}\n}')
    assert T.read_metrics(spark, f"{tmp_path}/m.json").first().n_total == 3
    T.write_json_lines(spark.range(3), f"{tmp_path}/o")
    assert spark.read.json(f"{tmp_path}/o").count() == 3


def test_connector_resumes(spark):
    requests = spark.createDataFrame([(f"k{i % 3}", "s", f"prompt {i}") for i in range(6)], "request_key string, signature string, prompt string")

    def judge(prompt):
        if prompt.endswith("5"):
            raise OSError("busy")
        return prompt.upper()

    empty = spark.createDataFrame([], C.CACHE)
    _, calls = C.resumed(requests, empty, judge, retries=1, sleep=lambda s: None)
    done = calls.collect()
    assert sorted(r.response or "" for r in done) == ["", *(f"PROMPT {i}" for i in range(5))]
    cache = spark.createDataFrame([tuple(r) for r in done if r.response], C.CACHE)
    cached, rest = C.resumed(requests, cache, str.upper)
    assert cached.count() == 5 and [r.response for r in rest.collect()] == ["PROMPT 5"]
    full = cache.union(rest)
    assert C.resumed(requests, full, judge)[1].count() == 0
    assert C.signature(b=1, a="x") == C.signature(a="x", b=1)


def test_stream_scores_each_request_once(spark, tmp_path):
    raw = "### Checklist\n" + "\n".join(f"Q{i}: q" for i in range(1, 8)) + "\n### Item Verdicts\n" + "\n".join(f"Q{i}: A" for i in range(1, 8)) + "\n### Final\nWinner: A"
    rows = [("k1", "h1", "A", raw, "2024-01-01 00:00:00"), ("k1", "h1", "A", raw, "2024-01-01 00:00:05"), ("k2", "h2", "B", "B", "2024-01-01 00:01:00"), ("k3", "h3", "A", None, "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "request_key string, prompt_sha256 string, winner string, raw string, arrived string").withColumn("arrived", F.to_timestamp("arrived"))
    df.write.parquet(f"{tmp_path}/in")
    stream = judgements.scored(judgements.read_outputs(spark, f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("scores").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    got = {r.request_key: r for r in spark.sql("select * from scores").collect()}
    assert len(got) == spark.sql("select count(*) from scores").first()[0] == 3
    assert (got["k1"].predicted_winner, got["k1"].parse_ok, got["k1"].format_score) == ("A", True, 1.0)
    assert got["k2"].predicted_winner == "B" and got["k3"].predicted_winner is None
    assert judgements.rates(spark.table("scores")).agg(F.sum("n")).first()[0] == 3


def test_tasks_share_the_interval(spark):
    """Calls over four tasks, some of them repeated after a failure, never come closer than the interval."""
    import time

    from pairlens.sources import connector

    requests = spark.range(24).selectExpr("cast(id as string) as request_key", "'s' as signature", "cast(id as string) as prompt")
    seen = {}

    def judge(prompt):
        now = time.time()
        seen.setdefault(prompt, []).append(now)
        if int(prompt) % 6 == 0 and len(seen[prompt]) < 2:
            raise TimeoutError
        return ",".join(map(repr, seen[prompt]))

    for tasks in (1, 4):
        seen.clear()
        got = connector.called(requests, judge, min_interval=0.05, sleep=lambda s: None, tasks=tasks)
        assert got.rdd.getNumPartitions() == tasks
        times = sorted(float(t) for r in got.collect() for t in r.response.split(","))
        assert len(times) == 28 and min(b - a for a, b in zip(times, times[1:])) > 0.045


def test_slots():
    from pairlens.sources.connector import Slots

    clock = [100.0]
    slots = [Slots(100.0, i, 3, 0.5, lambda s: clock.__setitem__(0, clock[0] + s), lambda: clock[0]) for i in range(3)]
    starts = []
    for i in (0, 1, 2, 0, 2, 2, 1):
        slots[i].wait()
        starts.append(clock[0])
        if len(starts) == 4:
            clock[0] += 5  # a long call
    assert all(b - a >= 0.5 - 1e-9 for a, b in zip(starts, starts[1:])) and starts[:4] == [100.0, 100.5, 101.0, 101.5]
