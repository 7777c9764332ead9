"""Datasets of a hub in the layout of its local cache, as a Spark data source.

    spark.dataSource.register(HubCache)
    spark.read.format("hub_cache").option("splits", "train,validation").load(folder)
    df.write.format("hub_cache").option("split", "train").mode("append").save(folder)

A folder holds ``dataset_info.json`` and Arrow stream files, ``name-split.arrow`` or
``name-split-00000-of-00002.arrow``. Reading: the schema comes from the features of
the info, with the split as one more column; each file is a partition, and the
option ``splits`` leaves the files of other splits unread. (It isn't a pushed filter:
Spark 4.1 keeps what is pushed to a Python source in the relation, so that the next
query over the same DataFrame would lose rows.) Writing: one split at a time,
a file for each task, visible when all are done; the info gets the split's counts.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .eventfiles import place

INFO = "dataset_info.json"
_FILE = re.compile(r"(?P<name>.+?)-(?P<split>[A-Za-z0-9_.]+?)(?:-(?P<at>\d{5})-of-(?P<of>\d{5}))?\.arrow")
#: The format's names of types.
_KINDS = {
    "string": T.StringType(), "large_string": T.StringType(), "binary": T.BinaryType(), "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "timestamp[us]": T.TimestampNTZType(), "date32": T.DateType(),
}


class MissingSplit(FileNotFoundError):
    """The info counts files or rows that aren't there."""


def spark_type(feature: object) -> T.DataType:
    """The type of a feature: values, class labels, sequences, lists and structs."""
    if isinstance(feature, list):
        return T.ArrayType(spark_type(feature[0]))
    kind = feature.get("_type")
    if kind == "Value":
        return _KINDS[feature["dtype"]]
    if kind == "ClassLabel":
        return T.LongType()
    if kind in ("Sequence", "List", "LargeList"):
        return T.ArrayType(spark_type(feature["feature"]))
    if kind is None or isinstance(kind, dict):
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in feature.items()])
    raise ValueError(f"features of type {kind} aren't read")


def feature_of(kind: T.DataType) -> object:
    if isinstance(kind, T.ArrayType):
        return {"feature": feature_of(kind.elementType), "_type": "Sequence"}
    if isinstance(kind, T.StructType):
        return {f.name: feature_of(f.dataType) for f in kind}
    found = next((name for name, t in _KINDS.items() if t == kind), None)
    if found is None:
        raise ValueError(f"{kind.simpleString()} has no feature")
    return {"dtype": found, "_type": "Value"}


def info_of(path: str) -> dict:
    files, root = place(path)
    with files.open_input_stream(f"{root.rstrip('/')}/{INFO}") as stream:
        return json.loads(stream.read())


def shards(path: str) -> dict[str, list[str]]:
    """The files of each split, in order; raises where one of a numbered series is missing."""
    from pyarrow import fs

    files, root = place(path)
    found: dict[str, list[tuple[int, int, str]]] = {}
    for x in files.get_file_info(fs.FileSelector(root)):
        m = _FILE.fullmatch(x.base_name)
        if m:
            found.setdefault(m["split"], []).append((int(m["at"] or 0), int(m["of"] or 1), x.path))
    for split, held in found.items():
        if sorted(h[0] for h in held) != list(range(held[0][1])):
            raise MissingSplit(f"{split} has {len(held)} of {held[0][1]} files under {path}")
    return {split: [p for _, _, p in sorted(held)] for split, held in found.items()}


@dataclass
class Shard(InputPartition):
    split: str
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, wanted: set[str] | None):
        self.path, self.schema, self.wanted = path, schema, wanted

    def partitions(self) -> list[InputPartition]:
        found = shards(self.path)
        counted = info_of(self.path).get("splits") or {}
        for split in counted if self.wanted is None else self.wanted:
            if split not in found and counted.get(split, {"num_examples": 1}).get("num_examples"):
                raise MissingSplit(f"no files of {split} under {self.path}")
        out = [Shard(split, p) for split, paths in sorted(found.items()) if self.wanted is None or split in self.wanted for p in paths]
        return out or [Shard("", "")]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        files, _ = place(self.path)
        with files.open_input_stream(partition.path) as stream, pa.ipc.open_stream(stream) as batches:
            for batch in batches:
                columns = [pa.array([partition.split] * batch.num_rows, pa.string()) if f.name == "split" else batch.column(f.name).cast(f.type) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int
    size: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, name: str, split: str, schema: T.StructType, overwrite: bool):
        if "split" in schema.names:
            raise ValueError("the split is an option, not a column")
        self.path, self.name, self.split, self.schema, self.overwrite = path, name, split, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = place(self.path)
        files.create_dir(root)
        target, rows, size = f"{root.rstrip('/')}/_writing-{uuid.uuid4().hex}", 0, 0
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        with files.open_output_stream(target) as out, pa.ipc.new_stream(out, schema) as stream:
            for batch in iterator:
                stream.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema))
                rows, size = rows + batch.num_rows, size + batch.nbytes
        return Written(target, rows, size)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = place(self.path)
        root = root.rstrip("/")
        done = [m for m in messages if m]
        try:
            info = info_of(self.path)
        except FileNotFoundError:
            info = {"features": {}, "splits": {}}
        for old in shards(self.path).get(self.split, []):
            if not self.overwrite:
                raise FileExistsError(f"{self.split} is there already")
            files.delete_file(old)
        for i, m in enumerate(done):
            files.move(m.path, f"{root}/{self.name}-{self.split}-{i:05d}-of-{len(done):05d}.arrow")
        info["features"] = {f.name: feature_of(f.dataType) for f in self.schema}
        info.setdefault("splits", {})[self.split] = {"name": self.split, "num_bytes": sum(m.size for m in done), "num_examples": sum(m.rows for m in done), "shard_lengths": [m.rows for m in done]}
        with files.open_output_stream(f"{root}/{INFO}") as out:
            out.write(json.dumps(info, ensure_ascii=False).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = place(self.path)
        for m in filter(None, messages):
            files.delete_file(m.path)


class HubCache(DataSource):
    """A dataset of a hub's cache: a folder with its info and its splits' files."""

    @classmethod
    def name(cls) -> str:
        return "hub_cache"

    def schema(self) -> T.StructType:
        features = info_of(self.options["path"])["features"]
        return T.StructType([*(T.StructField(k, spark_type(v)) for k, v in features.items()), T.StructField("split", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        splits = self.options.get("splits")
        return _Reader(self.options["path"], schema, {x.strip() for x in splits.split(",")} if splits else None)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("name", "data"), self.options.get("split", "train"), schema, overwrite)
