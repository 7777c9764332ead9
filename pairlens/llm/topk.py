"""Exact top-k inner products: norm-sorted candidates, rotated partial sums, Cauchy-Schwarz bounds.

Components are quantised to floor(scale * x), so that scores are exact integers.
Candidates fall into bands of descending length, cut at quantiles of the length, a
band into blocks of about BLOCK; a block is a cell, and candidates go to it once
for each class of queries that needs its band. The queries travel: first all of
them to one block of the longest band, which gives each a bound, the k-th score
that it has at least. A query then goes to a band's blocks only if its length
times the band's greatest length reaches its bound. Queries are put into classes
by the length that they need, classes into groups of about QUERY_GROUP, so that a
cell's work is bounded and no weak query makes others' candidates travel. In a
cell, queries pass in chunks over candidate chunks by descending length; a query
leaves once its length times the chunk's greatest can't reach its bound. The
vectors are rotated by the singular vectors of all vectors, so that the first few
components hold most of the product; the partial sum plus the product of the
residual lengths bounds the rest, and only pairs that reach the bound are computed
in full, as integers. Bounds are kept a little below the integers they stand for,
and all comparisons that decide are between integers. Vectors of one length prune
nothing by their length; residuals still do.

Ties go to the smaller vec_id. Vectors that are null or hold a null or non-finite
component take no part, nor do rows without an id. Every row is a candidate, also
where ids repeat, but not for queries with its own id; rows of one query id are
ranked together. Shorter vectors are padded with zeros. Components and scores
beyond a long are the nearest long. A query with fewer candidates than k gets them
all; no queries or candidates give no rows. Only the named columns are read, so
that others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._support import lasting, scope, sliced, staged

#: Steps of length that pruning tells apart; not a limit on what is searched.
BANDS = 256
CLASSES = 16
BLOCK = 32768
QUERY_GROUP = 65536
CHUNK = 1024
HEAD = 0.25
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = 256) -> DataFrame:
    """vec_id, v (array<long>), length of each usable vector."""
    x = F.col(vector_col)
    usable = df.filter(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))))
    end = float(1 << 63)
    # beyond a long, the nearest long
    whole = lambda c: F.when(c >= end, F.lit(_HIGH)).when(c < -end, F.lit(_LOW)).otherwise(F.floor(c).cast("long"))
    rows = usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: whole(c.cast("double") * scale)).alias("v"))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A dense int64 matrix of an array<long> column, short rows padded with zeros."""
    out = np.zeros((len(column), width), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(column):
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, by descending singular value, from partial Gram matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in sliced(batches, 8 * CHUNK):
            m = _matrix(batch.column(0), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width), pa.int32()), pa.array(total.ravel())], names=["at", "x"])

    sums = vectors.select("v").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    gram = np.zeros(width * width)
    gram[sums.column("at").to_numpy()] = sums.column("x").to_numpy()
    values, turn = np.linalg.eigh(gram.reshape(width, width))
    return turn[:, np.argsort(-values)]


def _under(score: int) -> float:
    """A double that isn't above an integer."""
    return float(score) - abs(float(score)) * 2**-50


def _products(rows: np.ndarray, q: np.ndarray, most: float) -> list[int] | np.ndarray:
    """Exact inner products; ``most`` is a bound on them. Beyond a long: the nearest long."""
    if most < 1 << 52:
        return (rows.astype(float) @ q.astype(float)).astype(np.int64)
    if most < 1 << 62:
        return rows @ q
    exact = rows.astype(object) @ q.astype(object)
    return np.array([min(max(int(x), _LOW), _HIGH) for x in exact], np.int64)


class _Cell:
    """A block of candidates, by descending length, that queries pass."""

    def __init__(self, k: int, turn: np.ndarray):
        self.k, self.turn, self.head = k, turn, max(1, int(len(turn) * HEAD))
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.chunks: list[tuple] | None = None

    def candidates(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.parts.append((ids, v))

    def _start(self) -> None:
        ids, v = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros((0, len(self.turn)), np.int64))
        self.parts, self.chunks = [], []
        for at in range(0, len(ids), CHUNK):
            c = v[at : at + CHUNK]
            turned = c.astype(float) @ self.turn
            length = np.linalg.norm(turned, axis=1)
            self.chunks.append((ids[at : at + CHUNK], c, turned[:, : self.head], np.linalg.norm(turned[:, self.head :], axis=1), float(length.max()), float(np.abs(c.astype(float)).max())))

    def queries(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(query row, query id, candidate id, score) of the k best of each query, and of none that its bound rules out."""
        if self.chunks is None:
            self._start()
        bound = bound.copy()
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        turned = q.astype(float) @ self.turn
        near, rest, length = turned[:, : self.head], np.linalg.norm(turned[:, self.head :], axis=1), np.linalg.norm(turned, axis=1)
        largest = np.abs(q.astype(float)).max(axis=1, initial=0)
        live = np.arange(len(ids))
        for c_ids, c, c_near, c_rest, c_length, c_largest in self.chunks:
            slack = 1 + 1e-9 * length * c_length
            live = live[(length * c_length + slack >= bound)[live]]
            if not len(live):
                break
            hopes = near[live] @ c_near.T + rest[live][:, None] * c_rest + slack[live][:, None] >= bound[live][:, None]
            for hope, i in zip(hopes, live.tolist(), strict=True):
                at = np.flatnonzero(hope & (c_ids != ids[i]))
                if not len(at):
                    continue
                scores = _products(c[at], q[i], float(largest[i]) * c_largest * c.shape[1])
                if len(at) > self.k:
                    keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
                    at, scores = at[keep], scores[keep]
                best[i] = sorted(best[i] + [(-int(s), int(c_ids[j])) for s, j in zip(scores.tolist(), at.tolist(), strict=True)])[: self.k]
                if len(best[i]) == self.k:
                    bound[i] = max(bound[i], _under(-best[i][-1][0]))
        for i, found in enumerate(best):
            for s, v in found:
                yield int(rows[i]), int(ids[i]), v, -s


def _search(queries: DataFrame, candidates: DataFrame, k: int, turn: np.ndarray) -> DataFrame:
    """row, query_id, vec_id, score: the best of each query in each cell.

    queries: cell, row, vec_id, v, bound; candidates: cell, vec_id, v, length.
    """
    held = queries.sparkSession.sparkContext.broadcast(turn)
    width = len(turn)
    left = queries.select("cell", F.lit(1).alias("side"), "row", "vec_id", "v", F.lit(0.0).alias("length"), "bound")
    right = candidates.select("cell", F.lit(0).alias("side"), F.lit(0).cast("long").alias("row"), "vec_id", "v", "length", F.lit(0.0).alias("bound"))
    rows = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "side", F.desc("length"), "vec_id").select("cell", "side", "row", "vec_id", "v", "bound")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, work = None, None
        for batch in sliced(batches, CHUNK):
            cells, sides, row, ids, bounds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5))
            v = _matrix(batch.column(4), width)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if cells[a] != now:
                    now, work = cells[a], _Cell(k, held.value)
                if sides[a] == 0:
                    work.candidates(ids[a:b], v[a:b])
                else:
                    found = list(work.queries(row[a:b], ids[a:b], v[a:b], bounds[a:b]))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(4)], names=["row", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "row long, query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int, by: str) -> DataFrame:
    place = Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row with the other rows of ``quantised``."""
    with scope(vectors.sparkSession):
        vectors = staged(vectors, "vectors")
        vectors = staged(vectors.withColumn("row", F.monotonically_increasing_id()), "rows")
        empty = vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
        total, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        if not width or vectors.filter(is_query).isEmpty():
            return lasting(empty, "topk")
        turn = _rotation(vectors, width)
        bands = max(1, min(BANDS, -(-total // BLOCK)))
        cuts = sorted(set(vectors.approxQuantile("length", [i / bands for i in range(1, bands)], 0.2 / bands)), reverse=True) if bands > 1 else []
        # band 0 is the longest; a vector as long as a cut belongs above it
        band = sum((F.col("length") < c).cast("int") for c in cuts) if cuts else F.lit(0)
        banded = vectors.withColumn("band", band)
        stats = sorted(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect())  # at most BANDS rows
        blocks = [max(1, -(-s.n // BLOCK)) for s in stats]
        first = [sum(blocks[:i]) for i in range(len(stats))]
        of_band = lambda values: F.element_at(F.create_map(*(F.lit(x) for s, value in zip(stats, values, strict=True) for x in (s.band, value))), F.col("band"))
        candidates = banded.withColumn("block", of_band(first) + F.pmod(F.xxhash64("row"), of_band(blocks)).cast("int"))
        candidates = staged(candidates.select("block", "band", "vec_id", "v", "length"), "candidates")
        queries = vectors.filter(is_query).select("row", "vec_id", "v", "length")

        def groups(counted: int) -> int:
            return max(1, -(-counted // QUERY_GROUP))

        # one block of the longest vectors bounds every query
        deal = groups(queries.count())
        seeds = queries.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(deal))).withColumn("bound", F.lit(float("-inf")))
        top = candidates.filter("block = 0").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))))
        found = staged(_search(seeds, top, k, turn), "found")
        if sum(blocks) == 1:
            return lasting(_ranked(found, k, "query_id").select("query_id", "rank", "vec_id", "score"), "topk")

        # a double below the k-th score; minus infinity where there are fewer
        least = F.min("score").cast("double")
        bounds = found.groupBy("row").agg(F.when(F.count(F.lit(1)) == k, least - F.abs(least) * 2.0**-50).alias("bound"))
        bounded = queries.join(bounds, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        reach = F.when(F.col("bound") <= 0, F.lit(0.0)).otherwise((F.col("bound") - 1) / F.greatest("length", F.lit(1e-300)) * (1 - 1e-9))
        bounded = staged(bounded.withColumn("reach", reach), "queries")
        # classes cost candidates a copy each, so that there are no more than groups
        classes = min(CLASSES, deal)
        steps = sorted(set(bounded.approxQuantile("reach", [i / classes for i in range(1, classes)], 0.02))) if classes > 1 else []
        kind = sum((F.col("reach") >= x).cast("int") for x in steps) if steps else F.lit(0)
        classed = bounded.withColumn("kind", kind)
        kinds = classed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("least")).collect()  # at most CLASSES rows
        places = [(s.band, s.longest, x, x + n - 1) for s, x, n in zip(stats, first, blocks, strict=True)]
        of_kind = F.element_at(F.create_map(*(F.lit(x) for y in kinds for x in (y.kind, groups(y.n)))), F.col("kind"))
        lists = F.array(*(F.struct(F.lit(longest).alias("longest"), F.lit(a).alias("a"), F.lit(b).alias("b")) for _, longest, a, b in places))
        needed = F.flatten(F.transform(F.filter(lists, lambda s: s["longest"] >= F.col("reach")), lambda s: F.sequence(s["a"], s["b"])))
        cell = lambda group: F.xxhash64("block", "kind", group)
        sent = classed.withColumn("g", F.pmod(F.xxhash64("row"), of_kind)).withColumn("block", F.explode(F.filter(needed, lambda b: b > 0)))
        sent = sent.withColumn("cell", cell("g"))
        takers = F.array(*(F.struct(F.lit(y.kind).alias("kind"), F.lit(y.least).alias("least"), F.lit(groups(y.n)).cast("long").alias("groups")) for y in kinds))
        longest = of_band([s.longest for s in stats])
        open_to = candidates.filter("block > 0").withColumn("taker", F.explode(F.filter(takers, lambda y: longest >= y["least"])))
        open_to = open_to.withColumn("kind", F.col("taker.kind")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taker.groups") - 1))).withColumn("cell", cell("g"))
        more = _search(sent, open_to, k, turn)
        return lasting(_ranked(found.union(more), k, "query_id").select("query_id", "rank", "vec_id", "score"), "topk")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every vector whose id is divisible by 50."""
    from ._support import table

    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL = {
    "op2_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 5
"""
}
