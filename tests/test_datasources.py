import json
import os
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.operators import exports
from pairlens.sources import eventfiles, hubcache


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(eventfiles.EventFiles)
    spark.dataSource.register(hubcache.HubCache)


def test_known_checksums():
    assert eventfiles.crc32c(b"123456789") == 0xE3069283 and eventfiles.crc32c(b"") == 0 and eventfiles.crc32c(b"\x00" * 32) == 0x8A9136AA


@pytest.mark.parametrize("step", [0, 1, 127, 128, 2**40, -1, -(2**63), 2**63 - 1])
def test_events_round_trip(step):
    raw = eventfiles.framed(eventfiles.event(1.5, step, "loss/é", 0.1))
    (data, wrong), = eventfiles.records(raw)
    assert wrong is None and list(eventfiles.scalars(data)) == [(1.5, step, "loss/é", struct.unpack("<f", struct.pack("<f", 0.1))[0])]


def test_written_files_are_read_by_several_tasks(spark, tmp_path):
    df = spark.range(50).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("tag"), F.col("id").alias("step"), (F.col("id") / 4).alias("value"), F.col("id").cast("double").alias("wall_time"))
    path = f"{tmp_path}/run"
    df.repartition(5).write.format("event_files").mode("append").save(path)
    assert len(os.listdir(path)) == 5 and all(n.startswith(eventfiles.PREFIX) for n in os.listdir(path))
    got = spark.read.format("event_files").load(path)
    assert got.rdd.getNumPartitions() == 5
    assert sorted((r.tag, r.step, r.value, r.wall_time) for r in got.collect()) == sorted(("ab"[i % 2], i, i / 4, float(i)) for i in range(50)) and got.filter("broken is not null").isEmpty()
    df.limit(3).coalesce(1).write.format("event_files").mode("overwrite").save(path)
    assert spark.read.format("event_files").load(path).count() == 3
    one = next(os.scandir(path)).path
    assert spark.read.format("event_files").load(one).count() == 3 and spark.read.format("event_files").load("file://" + one).count() == 3
    df.limit(0).write.format("event_files").mode("append").save(f"{tmp_path}/none")
    assert spark.read.format("event_files").load(f"{tmp_path}/none").count() == 0


def broken(raw, kind):
    size = len(raw)
    last = size - (size // 3)
    return {"length": raw[: last] + b"\xff" + raw[last + 1 :], "cut": raw[:-5], "data": raw[:-6] + bytes([raw[-6] ^ 1]) + raw[-5:], "head": raw + b"\x01\x02"}[kind]


@pytest.mark.parametrize("kind, said", [("length", "checksum of a length"), ("cut", "cut off in a record"), ("data", "checksum of a record"), ("head", "cut off in a length")])
def test_a_broken_record_ends_its_file(spark, tmp_path, kind, said):
    one = [eventfiles.framed(eventfiles.event(float(i), i, "t", i)) for i in range(3)]
    size = len(one[0])
    raw = b"".join(one)
    if kind == "length":
        raw = raw[:size * 2] + b"\xff" + raw[size * 2 + 1 :]
    else:
        raw = broken(raw, kind)
    for name, data in (("x", raw), ("y", b"".join(one)), ("z", eventfiles.framed(b"\x2a\xff"))):
        (tmp_path / f"{eventfiles.PREFIX}{name}").write_bytes(data)
    (tmp_path / "notes.txt").write_text("no event file")
    rows = sorted((r.file[-1], r.record, r.step, r.broken) for r in spark.read.format("event_files").load(str(tmp_path)).collect())
    good = 3 if kind == "head" else 2
    assert [r for r in rows if r[0] == "x"] == [("x", i, i, None) for i in range(good)] + [("x", good, None, said)]
    assert [r for r in rows if r[0] == "y"] == [("y", i, i, None) for i in range(3)] and [r for r in rows if r[0] == "z"] == [("z", 0, None, "not an event")]


def test_wide_keeps_the_latest(spark):
    rows = [("f", 1, 1.0, 5, "a", 1.0), ("f", 2, 3.0, 5, "a", 2.0), ("g", 0, 3.0, 5, "a", 9.0), ("f", 3, 2.0, 5, "b", 4.0), ("f", 4, 2.0, 6, "c", 4.0)]
    got = exports.latest_wide(spark.createDataFrame(rows, "file string, record long, wall_time double, step long, tag string, value double"), ["a", "b"]).collect()
    assert sorted(map(tuple, got), key=str) == [(5, 3.0, 2.0, 4.0), (6, 2.0, None, None)]


def test_missing_paths_and_columns(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("event_files").load(f"{tmp_path}/nowhere").count()
    with pytest.raises(Exception, match="wall_time"):
        spark.range(1).selectExpr("'t' as tag", "id as step", "1.0 as value").write.format("event_files").mode("append").save(str(tmp_path))


def hub(folder, features, splits):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/dataset_info.json", "w") as f:
        json.dump({"features": features, "splits": {k: {"name": k, "num_examples": 1} for k in splits}}, f)


def put(path, table):
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_stream(f, table.schema) as s:
        s.write_table(table)


def test_hub_layout(spark, tmp_path):
    value = lambda t: {"dtype": t, "_type": "Value"}
    hub(tmp_path, {"text": value("string"), "n": value("int32"), "label": {"names": ["x", "y"], "_type": "ClassLabel"}, "tags": {"feature": value("string"), "_type": "Sequence"}, "turns": [{"role": value("string"), "content": value("string")}], "pair": {"a": value("float64"), "b": value("bool")}}, ["train", "validation"])
    kind = pa.schema([("text", pa.large_string()), ("n", pa.int32()), ("label", pa.int64()), ("tags", pa.list_(pa.string())), ("turns", pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))), ("pair", pa.struct([("a", pa.float64()), ("b", pa.bool_())]))])
    row = lambda i: {"text": f"t{i}", "n": i, "label": i % 2, "tags": ["p", None], "turns": [{"role": "user", "content": str(i)}], "pair": {"a": i / 2, "b": None}}
    put(tmp_path / "help-steer-train-00000-of-00002.arrow", pa.Table.from_pylist([row(1), row(2)], kind))
    put(tmp_path / "help-steer-train-00001-of-00002.arrow", pa.Table.from_pylist([row(3)], kind))
    put(tmp_path / "help-steer-validation.arrow", pa.Table.from_pylist([row(9)], kind))
    df = spark.read.format("hub_cache").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and sorted((r.n, r.split) for r in df.collect()) == [(1, "train"), (2, "train"), (3, "train"), (9, "validation")]
    r = df.filter("n = 3").first()
    assert (r.text, r.label, r.tags, r.turns[0].content, r.pair.a, r.pair.b) == ("t3", 1, ["p", None], "3", 1.5, None)
    # files of other splits aren't read: a broken one doesn't matter
    (tmp_path / "help-steer-validation.arrow").write_bytes(b"broken")
    train = spark.read.format("hub_cache").option("splits", "train").load(str(tmp_path))
    assert train.rdd.getNumPartitions() == 2 and sorted(r.n for r in train.filter("n > 1").collect()) == [2, 3] and train.filter("split = 'test'").count() == 0 and train.count() == 3
    with pytest.raises(Exception, match="no files of other"):
        spark.read.format("hub_cache").option("splits", "train, other").load(str(tmp_path)).count()
    again = lambda: spark.read.format("hub_cache").load(str(tmp_path)).count()
    with pytest.raises(Exception):  # noqa: B017
        again()
    os.remove(tmp_path / "help-steer-train-00001-of-00002.arrow")
    with pytest.raises(Exception, match="1 of 2 files"):
        again()
    os.remove(tmp_path / "help-steer-train-00000-of-00002.arrow")
    with pytest.raises(Exception, match="no files of train"):
        again()


def test_hub_round_trip(spark, tmp_path):
    path = f"{tmp_path}/d"
    df = spark.range(10).selectExpr("id", "cast(id as string) as s", "array(named_struct('x', id, 'y', id / 2)) as l", "id % 2 = 0 as b")
    for split, rest in (("train", "id < 7"), ("test", "id >= 7")):
        df.filter(rest).repartition(2).write.format("hub_cache").options(split=split, name="n").mode("append").save(path)
    back = spark.read.format("hub_cache").load(path)
    assert sorted(map(tuple, back.drop("split").collect())) == sorted(map(tuple, df.collect())) and back.drop("split").schema.simpleString() == df.schema.simpleString()
    info = hubcache.info_of(path)
    assert info["splits"]["train"]["num_examples"] == 7 and sum(info["splits"]["test"]["shard_lengths"]) == 3
    with pytest.raises(Exception, match="there already"):
        df.write.format("hub_cache").options(split="train", name="n").mode("append").save(path)
    df.limit(2).coalesce(1).write.format("hub_cache").options(split="train", name="n").mode("overwrite").save(path)
    assert spark.read.format("hub_cache").load(path).filter("split = 'train'").count() == 2
    with pytest.raises(Exception, match="not a column"):
        df.withColumn("split", F.lit("x")).write.format("hub_cache").mode("append").save(path)
