"""Readers and writers of splits, metrics and diagnostics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.schema import require_columns


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a file that is written and read again: in spark.checkpoint.dir, or a temporary folder on a local master. It goes when the application ends."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pairlens-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again: lineage ends here. It goes when the application ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class MissingSplit(FileNotFoundError):
    """There is no such split or tier."""


def read_split(spark: SparkSession, root: str, name: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A split or tier by name; columns are pruned at the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        df = reader.parquet(f"{root.rstrip('/')}/{name}.parquet")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingSplit(f"no split {name} under {root}") from e
        raise
    return require_columns(df, columns, name).select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, skip_malformed: bool = True) -> DataFrame:
    """JSON lines by schema; blank lines never count, malformed ones are skipped or raise."""
    if not skip_malformed:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    text = spark.read.text(path).filter(F.trim("value") != "")
    parsed = text.select(F.from_json("value", f"struct<{_struct(schema)},_bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def _struct(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric files, one JSON object each over many lines, with the file's name."""
    return spark.read.option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header; quoted values may hold quotes, doubled, and line ends."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def peek(df: DataFrame, n: int = 5) -> list[str]:
    """The first rows as JSON, for a look at a table."""
    return [r[0] for r in df.limit(n).select(F.to_json(F.struct(*df.columns))).collect()]


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A summary table as Markdown; raises beyond ``limit`` rows, since reports are for people."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{title} has more than {limit} rows")
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])
