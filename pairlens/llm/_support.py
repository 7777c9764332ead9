"""What the operators of this subpackage share: the shared folder, tables staged in it, worker caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1024
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of some rows, without copies: rows here are whole texts. Spark bounds a batch's bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master, an error on a cluster."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pairlens-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends here and any executor can be lost.

    The table goes with the scope it was staged in, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged inside are removed at the end, but for those taken out of the list by ``lasting``."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.pop()
        for path in paths:
            place, files = _place(spark, path)
            files.delete(place, True)


def drop(spark: SparkSession, paths: list[str], first: int, last: int) -> None:
    """Remove some of a scope's tables early."""
    for path in paths[first:last]:
        place, files = _place(spark, path)
        files.delete(place, True)
    del paths[first:last]


def lasting(df: DataFrame, name: str) -> DataFrame:
    """A staged table that outlives the innermost scope and belongs to the one around it."""
    out = staged(df, name)
    if _scopes:
        path = _scopes[-1].pop()
        if len(_scopes) > 1:
            _scopes[-2].append(path)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id) -> "F.Column":
    """Rows that no model may learn from: crc32 of the id as text divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker; functions pickled by value have fresh module globals per task."""
    name = "_pairlens_worker_cache"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))
