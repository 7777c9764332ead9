"""Centroid clustering by kd-tree filtering: exact integer k-means over whole vectors.

Components are quantised to floor(scale * x). Centroids start as the ``k`` vectors
with the smallest SHA-256 of their id; a round assigns every vector to its nearest
centroid (squared Euclidean distance, ties to the smaller number) and replaces
each centroid that has vectors by their componentwise floor(sum / count).

Each partition's vectors are put into kd-trees of at most BLOCK vectors, once, and
staged: nodes hold their count (as a range of the vectors, which lie in leaf
order), the integer sum of their vectors and the box around them. A round walks
the trees from their roots, level by level, with the centroids that are still
possible in each node. Of those, one near the middle of the box is the rival; a
centroid that is farther than the rival from every point of the box is pruned,
strictly, so that no tie is decided here. A node with one centroid left is
assigned whole, by its sum and count; in leaves with several, vectors are measured
exactly. A task sends k * (width + 1) sums, whatever it holds, and the driver
receives that many numbers a round. Equal vectors make a box that is a point, so
that groups of copies cost no more than a leaf.

Vectors that are null, hold a null or non-finite component or don't have exactly
``width`` components take no part, nor do rows without an id. Rows that repeat are
vectors of their own; those that share an id get a row each. Among starting vectors
of one id the smaller vector comes first. With fewer vectors than ``k`` there are
fewer centroids; an empty table gives no rows. Components, distances and inertias
beyond a long are the nearest long; comparisons are exact. Only the id and vector
columns are read, so that others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import lasting, scope, sliced, staged
from .topk import quantised

BLOCK = 8192
LEAF = 32
#: Components below this are measured in 64-bit integers, others in Python's.
SMALL = 1 << 26
_LONG = (1 << 63) - 1
_TREE = "ids array<long>, points binary, start binary, stop binary, child binary, low binary, high binary, upper_sum binary, lower_sum binary"


def build(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points in the leaves and the nodes of their kd-tree, parents before children.

    ``child`` is the first of a node's two children, -1 in leaves. Sums are of the
    components' upper and lower 32 bits, so that they don't overflow.
    """
    order = np.arange(len(points))
    start, stop, child = [0], [len(points)], [-1]
    low, high = [points.min(axis=0)], [points.max(axis=0)]
    at = 0
    while at < len(start):
        a, b = start[at], stop[at]
        spread = high[at].astype(float) - low[at]
        axis = int(spread.argmax())
        if b - a > LEAF and spread[axis] > 0:
            rows = order[a:b]
            half = (b - a) // 2
            order[a:b] = rows[np.argpartition(points[rows, axis], half)]
            child[at] = len(start)
            for x, y in ((a, a + half), (a + half, b)):
                held = points[order[x:y]]
                start.append(x), stop.append(y), child.append(-1)
                low.append(held.min(axis=0)), high.append(held.max(axis=0))
        at += 1
    placed = points[order]
    first, last = np.array(start), np.array(stop)
    sums = {}
    for name, part in (("upper_sum", placed >> 32), ("lower_sum", placed & 0xFFFFFFFF)):
        total = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(part, axis=0, out=total[1:])
        sums[name] = total[last] - total[first]
    return order, {"start": first, "stop": last, "child": np.array(child), "low": np.array(low), "high": np.array(high)} | sums


def trees(vectors: DataFrame, width: int) -> DataFrame:
    """One row for each kd-tree of at most BLOCK vectors of a partition of (vec_id, v)."""

    def packed(ids: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        order, nodes = build(points)
        cols = [pa.array([ids[order]], pa.list_(pa.int64())), pa.array([points[order].tobytes()], pa.binary())]
        names = ["start", "stop", "child", "low", "high", "upper_sum", "lower_sum"]
        return pa.RecordBatch.from_arrays(cols + [pa.array([nodes[x].astype(np.int64).tobytes()], pa.binary()) for x in names], names=["ids", "points", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0
        for batch in sliced(batches, BLOCK):
            while batch.num_rows:
                part = batch.slice(0, BLOCK - held)
                batch = batch.slice(part.num_rows)
                ids.append(part.column(0).to_numpy())
                points.append(part.column(1).flatten().to_numpy().reshape(-1, width))
                held += part.num_rows
                if held == BLOCK:
                    yield packed(np.concatenate(ids), np.concatenate(points))
                    ids, points, held = [], [], 0
        if held:
            yield packed(np.concatenate(ids), np.concatenate(points))

    return vectors.select("vec_id", "v").mapInArrow(run, _TREE)


class _Walk:
    """One tree under one list of centroids: who is nearest, exactly."""

    def __init__(self, points: np.ndarray, nodes: dict[str, np.ndarray], centroids: list[list[int]]):
        most = max(int(np.abs(points.astype(float)).max()), max(abs(x) for c in centroids for x in c))
        kind = np.int64 if most < SMALL else object
        self.fast = most * most * points.shape[1] < 1 << 52
        self.points, self.centroids = points.astype(kind, copy=False), np.array(centroids, kind)
        self.nodes = nodes | {x: nodes[x].astype(kind, copy=False) for x in ("low", "high", "upper_sum", "lower_sum")}
        self.squares = (self.centroids * self.centroids).sum(axis=1)

    def _products(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        if self.fast:
            return (rows.astype(float) @ others.astype(float).T).astype(np.int64)
        return rows @ others.T

    def _left(self, at: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """The centroids that no rival dominates strictly in the nodes' boxes."""
        low, high = self.nodes["low"][at], self.nodes["high"][at]
        middle = low.astype(float) / 2 + high.astype(float) / 2
        c = self.centroids.astype(float)
        away = np.where(alive, (c * c).sum(axis=1)[None, :] - 2 * middle @ c.T, np.inf)
        away[~np.isfinite(away) & alive] = np.finfo(float).max
        rival = away.argmin(axis=1)
        out = alive.copy()
        for k in range(len(self.centroids)):
            rows = np.flatnonzero(alive[:, k] & (rival != k))
            step = self.centroids[k][None, :] - self.centroids[rival[rows]]
            # the corner of the box that lies farthest towards k
            corner = np.where(step > 0, high[rows], low[rows])
            gap = self.squares[k] - self.squares[rival[rows]] - 2 * (corner * step).sum(axis=1)
            out[rows[(gap > 0).astype(bool)], k] = False
        return out

    def parts(self) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Nodes assigned whole, as (node, centroid), and the vectors of open leaves with the centroids that are left to each."""
        at, alive = np.zeros(1, np.int64), np.ones((1, len(self.centroids)), bool)
        whole: list[tuple[int, int]] = []
        rows, masks = [np.zeros(0, np.int64)], [np.zeros((0, len(self.centroids)), bool)]
        while len(at):
            alive = self._left(at, alive)
            one = alive.sum(axis=1) == 1
            whole += zip(at[one].tolist(), alive[one].argmax(axis=1).tolist(), strict=True)
            child = self.nodes["child"][at]
            leaf = ~one & (child < 0)
            for node, mask in zip(at[leaf], alive[leaf], strict=True):
                held = np.arange(self.nodes["start"][node], self.nodes["stop"][node])
                rows.append(held)
                masks.append(np.broadcast_to(mask, (len(held), len(mask))))
            down = ~one & (child >= 0)
            at, alive = np.concatenate([child[down], child[down] + 1]), np.concatenate([alive[down], alive[down]])
        return whole, np.concatenate(rows), np.concatenate(masks)

    def nearest(self, rows: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """The nearest of the centroids that are left, the smallest number among equals."""
        if not len(rows):
            return rows
        score = self.squares[None, :] - 2 * self._products(self.points[rows], self.centroids)
        best = np.where(alive, score, score.max() + 1)
        return np.array(best.argmin(axis=1), np.int64)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """The counts and the sums of the vectors of each centroid."""
        whole, rows, alive = self.parts()
        counts, totals = np.zeros(len(self.centroids), np.int64), np.zeros(self.centroids.shape, object)
        for node, k in whole:
            counts[k] += self.nodes["stop"][node] - self.nodes["start"][node]
            totals[k] += self.nodes["upper_sum"][node].astype(object) * (1 << 32) + self.nodes["lower_sum"][node].astype(object)
        near = self.nearest(rows, alive)
        for k in np.unique(near).tolist():
            held = self.points[rows[near == k]]
            counts[k] += len(held)
            totals[k] += held.sum(axis=0).astype(object)
        return counts, totals

    def assigned(self) -> tuple[np.ndarray, list[int]]:
        """The centroid of each vector and its squared distance."""
        whole, rows, alive = self.parts()
        out = np.zeros(len(self.points), np.int64)
        for node, k in whole:
            out[self.nodes["start"][node] : self.nodes["stop"][node]] = k
        out[rows] = self.nearest(rows, alive)
        away = self.points - self.centroids[out]
        return out, (away * away).sum(axis=1).tolist()


def _walks(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[tuple[pa.Array, _Walk]]:
    width = len(centroids[0])
    for batch in batches:
        for i in range(batch.num_rows):
            raw = {name: np.frombuffer(batch.column(name)[i].as_buffer(), np.int64) for name in batch.schema.names[1:]}
            nodes = {name: raw[name] if name in ("start", "stop", "child") else raw[name].reshape(-1, width) for name in raw}
            yield batch.column("ids").slice(i, 1).flatten(), _Walk(nodes.pop("points"), nodes, centroids)


def _moved(forest: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    width = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), object)
        for _, walk in _walks(batches, centroids):
            n, s = walk.sums()
            counts, totals = counts + n, totals + s
        k, at = np.nonzero(np.broadcast_to(counts[:, None] > 0, (len(centroids), width + 1)))
        every = np.concatenate([totals, counts[:, None].astype(object)], axis=1)
        values = pa.array([Decimal(int(x)) for x in every[k, at]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), values], names=["cluster", "at", "total"])

    found = forest.mapInArrow(run, "cluster int, at int, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("total").alias("total"))
    totals = {(r.cluster, r.at): int(r.total) for r in found.collect()}  # k * (width + 1) rows at most
    return [[totals[k, i] // totals[k, width] for i in range(width)] if (k, width) in totals else c for k, c in enumerate(centroids)]


def clustered(vectors: DataFrame, width: int = 64, k: int = 16, rounds: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance of each vector of ``width`` components among (vec_id, v), and the centroids."""
    spark = vectors.sparkSession
    with scope(spark):
        kept = vectors.filter(F.size("v") == width).select("vec_id", "v")
        first = kept.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256), "vec_id", "v").limit(k)
        centroids = [list(r.v) for r in first.collect()]  # k rows
        if not centroids:
            return lasting(kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), "clusters"), []
        forest = staged(trees(kept, width), "trees")
        for _ in range(rounds):
            centroids = _moved(forest, centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, walk in _walks(batches, centroids):
                cluster, distance = walk.assigned()
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array([min(x, _LONG) for x in distance], pa.int64())], names=["vec_id", "cluster", "distance"])

        return lasting(forest.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters"), centroids


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Every vector of 64 components with its cluster after three rounds, floor(64 * x) a component."""
    from ._support import table

    found, centroids = clustered(quantised(table(spark, sf_dir, "embeddings"), scale=64))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    inertia = {r.cluster: int(r.s) for r in sums}
    by_cluster = lambda values, kind: F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("cluster")).cast(kind) if values else F.lit(None).cast(kind)
    digests = {k: sha256(",".join(map(str, c)).encode()).hexdigest() for k, c in enumerate(centroids)}
    return found.select(
        "vec_id", "cluster", "distance",
        by_cluster({k: min(x, _LONG) for k, x in inertia.items()}, "long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), _LONG)).cast("long").alias("inertia"),
        by_cluster(digests, "string").alias("centroid_sha256"),
    )


def _round(i: int) -> str:
    """SQL of one assignment, a{i}, and of the centroids after it, c{i + 1}."""
    return f"""
a{i} as materialized (select r, vec_id, v, arg_min(c, d * 16 + c) as c, min(d) as d from (
  select r, vec_id, v, c, cast(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from k, c{i}) group by r, vec_id, v),
s{i} as (select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range(64)) as i from a{i}) group by c, i),
c{i + 1} as materialized (select o.c, coalesce(n.m, o.m) as m from c{i} o left join (
  select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as m from s{i} group by c) n on n.c = o.c)"""


ORACLE_SQL = {
    "op12_centroids": """
with k as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as v from embeddings
  where vec_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v as m from k order by c limit 16),"""
    + ",".join(_round(i) for i in range(4))
    + """
select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(m, ',')) as centroid_sha256 from a3 join c3 using (c)
"""
}
