"""Greedy packing of ordered requests into shards under several budgets, in parallel within a job.

A request goes to a new shard when the current one would exceed any budget with it.
That is a chain: the start of a shard determines the start of the next. Requests are
range-partitioned by job and order, so that a job may lie in many partitions; the
part of a job in one partition is a segment.

* Within a segment the next start of every position follows from prefix sums, and
  from the last position to the first each position learns where the chain that
  starts there leaves the segment (its last start there) and after how many shards.
* Of each segment only two kinds of positions matter to others: those where a shard
  from an earlier segment can end, which lie within one budget of its beginning, and
  those whose shard ends in a later segment, within one budget of its end. A range
  lookup on prefix sums links the latter to the former: edges between segments.
* The chain of a job follows these edges. It is found by doubling: after r rounds
  the positions that 2 ** r edges reach are known, so that the number of rounds is
  the logarithm of the number of a job's segments.
* Each segment then gets its first start and shard number, and is cut on its own.

The driver holds a row for each segment of jobs that lie in several partitions, at
most two for each partition. No task holds more than a segment, or than the
positions within two budgets of a segment's ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.sources.tables import staged

from .windows import segments

_EDGE = "job long, part int, kind int, at long, limits array<long>, from_part int, from_at long, exit long, shards long"


class OverBudget(ValueError):
    """A single request exceeds a budget."""


def _next_starts(sums: np.ndarray, budgets: list[int]) -> np.ndarray:
    """For each position, the first one that its shard can't hold; the length where that lies beyond the end. ``sums``: a row of prefix sums for each budget, from 0."""
    n = sums.shape[1] - 1
    after = np.full(n, n, np.int64)
    for row, budget in zip(sums, budgets, strict=True):
        after = np.minimum(after, np.searchsorted(row, row[:n] + budget, side="right") - 1)
    return after


def _exits(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position as a start: the last start of its chain within the segment, and the number of starts until then."""
    n = len(after)
    exits, counts, nexts = list(range(n)), [1] * n, after.tolist()
    for i in range(n - 1, -1, -1):
        j = nexts[i]
        if j < n:
            exits[i], counts[i] = exits[j], counts[j] + 1
    return np.array(exits, np.int64), np.array(counts, np.int64)


def _sums(table: pa.Table, first: int, count: int) -> np.ndarray:
    out = np.zeros((count, table.num_rows + 1), np.int64)
    for i in range(count):
        np.cumsum(table.column(first + i).to_numpy(), out=out[i, 1:])
    return out


def _edges(placed: DataFrame, spans: dict[int, list[tuple]], budgets: list[int]) -> DataFrame:
    """job, part, at, from_part, from_at, exit, shards: from the last start of a segment to the chain in the segment where its shard ends.

    ``spans``: for each job in several partitions, its segments in order as (part, start sums, end sums).
    """
    held = placed.sparkSession.sparkContext.broadcast(spans)
    count = len(budgets)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in segments(batches, 2):
            part, job = table.column(0)[0].as_py(), table.column(1)[0].as_py()
            mine = held.value[job]
            place = next(i for i, s in enumerate(mine) if s[0] == part)
            base = np.array(mine[place][1])[:, None]
            sums = _sums(table, 2, count)
            n = table.num_rows
            after = _next_starts(sums, budgets)
            exits, shards = _exits(after)
            entries = np.flatnonzero((sums[:, :n] <= np.array(budgets)[:, None]).all(axis=0))
            rows = [(job, part, 0, int(j), (base[:, 0] + sums[:, j + 1]).tolist(), None, None, int(exits[j]), int(shards[j])) for j in entries]
            if not place:
                rows.append((job, part, 1, None, [-1] * count, -1, -1, None, None))
            for i in np.flatnonzero(after == n):
                limits = (base[:, 0] + sums[:, i] + budgets).tolist()
                target = next((s[0] for s in mine[place + 1 :] if any(e > x for e, x in zip(s[2], limits, strict=True))), None)
                if target is not None:
                    rows.append((job, target, 1, None, limits, part, int(i), None, None))
            yield pa.RecordBatch.from_pylist([dict(zip(("job", "part", "kind", "at", "limits", "from_part", "from_at", "exit", "shards"), r, strict=True)) for r in rows], schema=_ARROW)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in segments(batches, 2):
            rows = table.to_pylist()
            into = [r for r in rows if r["kind"] == 0]
            ends = np.array([r["limits"] for r in into], np.int64).reshape(-1, count)
            out = []
            for r in rows[len(into) :]:
                # the first request with which any sum exceeds its limit
                j = min(int(np.searchsorted(ends[:, d], r["limits"][d], side="right")) for d in range(count))
                out.append(r | {"at": into[j]["at"], "exit": into[j]["exit"], "shards": into[j]["shards"]})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    marks = placed.mapInArrow(marked, _EDGE).repartition("job", "part").sortWithinPartitions("job", "part", "kind", "at")
    return marks.mapInArrow(linked, _EDGE)


_ARROW = pa.schema(
    [("job", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("at", pa.int64()), ("limits", pa.list_(pa.int64())), ("from_part", pa.int32()), ("from_at", pa.int64()), ("exit", pa.int64()), ("shards", pa.int64())]
)


def _chain(edges: DataFrame, count: int) -> DataFrame:
    """The edges on the way from each job's start, by doubling."""
    edges = staged(edges, "edges")
    jump = edges.select("job", "from_part", "from_at", F.col("part").alias("to_part"), F.col("exit").alias("to_at"))
    seen = edges.filter("from_part = -1").select("job", "from_part", "from_at")
    for _ in range(max(1, math.ceil(math.log2(count + 1)))):
        step = seen.join(jump, ["job", "from_part", "from_at"]).select("job", F.col("to_part").alias("from_part"), F.col("to_at").alias("from_at"))
        seen = staged(seen.union(step).distinct(), "seen")
        far = jump.select("job", F.col("from_part").alias("to_part"), F.col("from_at").alias("to_at"), F.col("to_part").alias("far_part"), F.col("to_at").alias("far_at"))
        jump = staged(jump.join(far, ["job", "to_part", "to_at"]).select("job", "from_part", "from_at", F.col("far_part").alias("to_part"), F.col("far_at").alias("to_at")), "jump")
    return edges.join(seen, ["job", "from_part", "from_at"], "left_semi")


def packed(df: DataFrame, key: str, order: list[str], budgets: dict[str, int]) -> DataFrame:
    """The columns key, order and sizes with ``shard``, numbered from 0 in each job.

    ``budgets``: size column -> what a shard may hold of it. Sizes are integers, null
    ones 0. Raises OverBudget where one request alone exceeds a budget. Requests with
    equal order are told apart by their sizes. A null key is a job of its own.
    """
    sizes = list(budgets)
    limits = [budgets[c] for c in sizes]
    rows = df.select(key, *order, *(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in sizes))
    over = rows.filter(" or ".join(f"`{c}` > {budgets[c]}" for c in sizes)).limit(1).collect()
    if over:
        raise OverBudget(f"request {over[0][key]}, {', '.join(str(over[0][c]) for c in order)} exceeds the budget of a shard")
    place = [key, *order, *sizes]
    sorted_rows = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    ordered = sorted_rows.select(F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"), F.xxhash64(key).alias("_job"), *place)
    placed = staged(ordered, "ordered")

    # jobs in several partitions; at most two rows a partition
    parts = placed.groupBy("_job", "_part").agg(*(F.sum(c).alias(c) for c in sizes))
    several = parts.join(parts.groupBy("_job").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "_job").collect()
    spans: dict[int, list[tuple]] = {}
    for r in sorted(several, key=lambda r: (r["_job"], r["_part"])):
        held = spans.setdefault(r["_job"], [])
        start = held[-1][2] if held else [0] * len(sizes)
        held.append((r["_part"], start, [s + r[c] for s, c in zip(start, sizes, strict=True)]))
    dealt = placed.repartition("_part", "_job").sortWithinPartitions("_part", "_job", "_at")
    starts: dict[tuple[int, int], tuple[int, int]] = {}  # segment -> its first start (or a place beyond it) and the shards before
    if spans:
        inside = F.col("_job").isin([*spans])
        edges = _edges(dealt.filter(inside).select("_part", "_job", *sizes), spans, limits)
        into = {(r["job"], r["part"]): r for r in _chain(edges, max(map(len, spans.values()))).collect()}  # an edge for each segment at most
        for job, held in spans.items():
            shards = 0
            for part, _, _ in held:
                r = into.get((job, part))
                starts[job, part] = (r["at"] if r else 1 << 62, shards)
                shards += r["shards"] if r else 0
    begin = df.sparkSession.sparkContext.broadcast(starts)
    schema = T.StructType([*(dealt.schema[c] for c in place), T.StructField("shard", T.LongType())])
    at = 2 + len(place) - len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in segments(batches, 2):
            part, job = table.column(0)[0].as_py(), table.column(1)[0].as_py()
            entry, before = begin.value.get((job, part), (0, 0))
            after = _next_starts(_sums(table, at, len(sizes)), limits)
            cut = np.zeros(table.num_rows, np.int64)
            i = entry
            while i < len(after):
                cut[i] = 1
                i = int(after[i])
            out = table.drop_columns(["_part", "_job"]).append_column("shard", pa.array(before - 1 + np.cumsum(cut)))
            yield from out.combine_chunks().to_batches()

    return dealt.select("_part", "_job", *place).mapInArrow(run, schema)
