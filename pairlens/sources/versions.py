"""A few tables that change together: each commit is a version, readers see the last whole one.

Tables are written as Parquet to new folders. A commit is one small file, created
only where there is none of its number: who comes second fails. What was written
without a commit is never read. A commit file that was cut off while it was written
is no version, and its number isn't used again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[tuple[int, dict | None]]:
        """Number and tables of each commit, in order; None for one that was cut off."""
        folder = self._path(f"{self.root}/commits")
        if not self._files.exists(folder):
            return []
        names = sorted(f.getPath().getName() for f in self._files.listStatus(folder) if f.getPath().getName().endswith(".json"))
        found = []
        for name in names:
            stream = self._files.open(self._path(folder, name))
            try:
                raw = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            found.append((int(name.removesuffix(".json")), json.loads(raw) if raw.endswith("\n") else None))
        return found

    def version(self) -> int | None:
        """The last whole version."""
        return max((n for n, tables in self._commits() if tables is not None), default=None)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        wanted = self.version() if version is None else version
        tables = dict(self._commits()).get(wanted)
        if not tables:
            raise FileNotFoundError(f"no version of {name} under {self.root}")
        return self.spark.read.parquet(tables[name])

    def commit(self, tables: dict[str, DataFrame], parent: int | None) -> int:
        """Write tables and make them, with the parent's others, the next version; ``parent`` is what they were made from."""
        commits = self._commits()
        if self.version() != parent:
            raise Conflict(f"version {self.version()} came after {parent}")
        held = dict(dict(commits).get(parent) or {})
        for name, df in tables.items():
            held[name] = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(held[name])
        number = commits[-1][0] + 1 if commits else 0
        try:
            stream = self._files.create(self._path(f"{self.root}/commits/{number:08d}.json"), False)
        except Exception as e:
            raise Conflict(f"version {number} is taken") from e
        try:
            stream.write(bytearray((json.dumps(held) + "\n").encode()))
        finally:
            stream.close()
        return number
