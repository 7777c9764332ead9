import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from pairlens.operators import shardjobs
from pairlens.sources.versions import Conflict, Versions

ROWS = [(job, i, 10 + i % 7, 5 + i % 3) for job in ("a", "b") for i in range(40)]


@pytest.fixture
def requests(spark):
    return spark.createDataFrame(ROWS, "job string, request_id long, bytes long, tokens long").coalesce(1)


def send(job, shard, batch):
    return "validating"


def report(state, done):
    """Batches of shards for which ``done`` holds are completed, others have failed."""
    return state.read("shards").select("batch_id", F.when(done, "completed").otherwise("failed").alias("status"), F.lit(1).alias("at"))


def seen(state):
    return sorted(map(tuple, state.read("requests").collect())), sorted(map(tuple, state.read("shards").drop("first_id", "last_id").collect()))


STEPS = [
    lambda s, r: shardjobs.prepare(s, r, 100, 30),
    lambda s, r: shardjobs.submit(s, send),
    lambda s, r: shardjobs.poll(s, report(s, F.col("shard") < 2)),
    lambda s, r: shardjobs.reshard(s, 100, 15),
    lambda s, r: shardjobs.submit(s, send),
]


def test_prefix_stays_and_the_rest_is_packed_anew(spark, requests, tmp_path):
    state = Versions(spark, str(tmp_path))
    for step in STEPS[:3]:
        step(state, requests)
    before = {r.request_id: r.shard for r in state.read("requests").filter("job = 'a'").collect()}
    STEPS[3](state, requests)
    after = {r.request_id: r.shard for r in state.read("requests").filter("job = 'a'").collect()}
    assert set(after) == set(before) and all(after[i] == s for i, s in before.items() if s < 2) and max(after.values()) > max(before.values())
    rows = [r for r in state.read("shards").filter("job = 'a'").orderBy("shard").collect()]
    assert [r.shard for r in rows] == list(range(len(rows))) and [r.status for r in rows] == ["completed"] * 2 + ["prepared"] * (len(rows) - 2)
    assert all(r.tokens <= 15 and r.batch_id is None and r.target_tokens == 15 for r in rows[2:]) and sum(r.n_requests for r in rows) == 40
    # order of requests goes on over shards
    assert [after[i] for i in sorted(after)] == sorted(after.values())
    now = state.version()
    assert shardjobs.prepare(state, requests, 1000, 1000) == now
    shardjobs.reshard(state, 100, 15)  # nothing has a larger budget behind its prefix
    assert seen(state)[0] == sorted((j, i, b, t, s) for j, i, b, t, s in (tuple(r) for r in state.read("requests", now).collect()))


def test_a_stop_at_any_write_loses_nothing(spark, requests, tmp_path, monkeypatch):
    whole = Versions(spark, str(tmp_path / "whole"))
    wanted = []
    for step in STEPS:
        step(whole, requests)
        wanted.append(seen(whole))
    state = Versions(spark, str(tmp_path / "stopped"))
    write, create, stops = DataFrameWriter.parquet, state._files.create, 0

    class Stop(Exception):
        pass

    for step, want in zip(STEPS, wanted, strict=True):
        before = state.version()
        for at in range(20):
            left = [at]

            def counted(self, *a, **b):
                if not left[0]:
                    raise Stop
                left[0] -= 1
                return write(self, *a, **b)

            with monkeypatch.context() as m:
                m.setattr(DataFrameWriter, "parquet", counted)
                try:
                    step(state, requests)
                    break
                except Stop:
                    stops += 1
                    assert state.version() == before and (before is None or seen(state) == last)
        assert seen(state) == want
        last = want
    assert stops >= 10


def test_a_commit_that_was_cut_off_is_no_version(spark, requests, tmp_path):
    state = Versions(spark, str(tmp_path))
    first = STEPS[0](state, requests)
    (tmp_path / "commits" / f"{first + 1:08d}.json").write_text('{"requests": "x"')
    assert state.version() == first
    assert STEPS[1](state, requests) == first + 2 and state.read("shards").filter("batch_id is null").isEmpty()


def test_the_second_of_two_writers_fails(spark, requests, tmp_path):
    one, two = Versions(spark, str(tmp_path)), Versions(spark, str(tmp_path))
    first = STEPS[0](one, requests)
    one.commit({"shards": one.read("shards").limit(1)}, first)
    with pytest.raises(Conflict):
        two.commit({"shards": two.read("shards")}, first)
    taken = one.version()
    two.version = lambda: taken  # looked before the other committed
    one.commit({"shards": one.read("shards")}, taken)
    two._commits = lambda: one.__class__._commits(one)[:-1]
    with pytest.raises(Conflict):
        two.commit({"shards": one.read("shards")}, taken)
    with pytest.raises(FileNotFoundError):
        Versions(spark, str(tmp_path / "none")).read("shards")


def test_active_shards_make_a_job_wait(spark, requests, tmp_path):
    state = Versions(spark, str(tmp_path))
    for step in STEPS[:2]:
        step(state, requests)
    status = F.when(F.col("job") == "b", F.when(F.col("shard") == 3, "in_progress").otherwise("completed")).otherwise("expired")
    reports = state.read("shards").select("batch_id", status.alias("status"), F.lit(2).alias("at"))
    old = reports.select("batch_id", F.lit("failed").alias("status"), F.lit(1).alias("at"))
    shardjobs.poll(state, reports.union(old).union(spark.createDataFrame([("unknown", "failed", 9)], old.schema)))
    before = {tuple(r) for r in state.read("requests").filter("job = 'b'").collect()}
    shardjobs.reshard(state, 100, 15)
    assert {tuple(r) for r in state.read("requests").filter("job = 'b'").collect()} == before
    told = {r.job: r for r in shardjobs.summary(state).collect()}
    assert told["b"].done == 3 and told["b"].n_active == 1 and told["a"].done == 0 and told["a"].target_tokens == 15 and told["a"].n_requests == told["b"].n_requests == 40
    ids = [r.batch_id for r in state.read("shards").filter("batch_id is not null").collect()]
    assert len(set(ids)) == len(ids)


def test_finalize(spark, requests, tmp_path):
    state = Versions(spark, str(tmp_path))
    for step in STEPS[:3]:
        step(state, requests)
    outputs = spark.createDataFrame([("a", 1, " yes "), ("b", 2, None), ("c", 9, "unknown")], "job string, request_id long, text string")
    with pytest.raises(shardjobs.NotCompleted):
        shardjobs.finalize(state, outputs)
    shardjobs.poll(state, report(state, F.lit(True)))
    got = {(r.job, r.request_id): (r.text, r.missing) for r in shardjobs.finalize(state, outputs).collect()}
    assert len(got) == 80 and got["a", 1] == ("yes", False) and got["b", 2] == ("", False) and got["b", 3] == ("", True)
    with pytest.raises(ValueError):
        shardjobs.finalize(state, outputs.union(outputs))
