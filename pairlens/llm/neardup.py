"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Words are runs of anything but the six ASCII white-space bytes, A-Z lower-cased;
a document's set is its distinct shingles of ``size`` words, or its whole word
sequence where it has fewer. Documents whose sets have a Jaccard similarity of
at least ``percent`` / 100 are linked, and each gets the smallest id that links
reach.

1. One pass over the texts gives each document the size and a 128-bit digest
   (BLAKE2b over the sorted shingle hashes) of its set, ORDERS keys and a sketch
   of one byte per minhash. Documents with equal sets are one class before
   anything else, whatever the number of copies.
2. The forest: each of ORDERS sorted orders of the signatures starts at its own
   minhash values and runs on through the others. Classes with a common prefix of
   DEPTH values are a region of an order; two with similarity 0.8 share no region
   of any order with probability (1 - 0.8 ** 4) ** 32 < 5e-8. Rows are put in
   order, and neighbours with their longest common prefix are candidates. The
   depth that a prefix needs adapts to its region: one value more for each
   doubling of the region beyond CROWD members. Each class keeps its neighbour
   with the longest prefix over all orders, so that no set is copied more than
   2 * ORDERS times, and these pairs are confirmed on full sets.
3. Regions that hold more than one component of these links are open. In them,
   neighbours of different components whose sketches agree in AGREE of 128 bytes
   (a true link misses that with probability below 1e-6) are the next candidates,
   the best one for each pair of components.
4. What is still open is settled inside tasks. In regions of up to CROWD members,
   members of different components are compared by their sketches; pairs that
   agree are confirmed on full sets. Of a crowded region, the members of its largest
   component are dealt to blocks, by members and by shingles, and the others to
   blocks of their own. Blocks of others meet pairwise, and each block of the
   largest component meets each block of others, in cells of bounded size; where
   few are outside the largest component, its members are copied once. A cell
   counts the common shingles of members of different components exactly, by
   blocked matrix products, and gives only the links that join components.

Never are all pairs of a group written. Sets are made only for classes in
regions, found through a bit map of bounded size, or by a join where more are
needed than the map has room for.

Null and empty texts and texts without words have an empty set: n_shingles 0,
own component, kept. Rows with a null id take no part in links; their component
is null and kept is false. Repeated rows get equal results. Rows that share an id
but not a text are linked each by its own text. Texts of any length count whole;
an empty table gives no rows. Only the id and text columns are read, so that other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import drop, fresh, lasting, scope, sliced, staged
from ._words import mix, utf8, word_hashes

DEPTH = 4
ORDERS = 32
VALUES = DEPTH * ORDERS
AGREE = 78
CROWD = 16
BLOCK = 1024
BLOCK_SHINGLES = 1 << 21
MAP_BITS = 1 << 16, 1 << 28
BITS_AN_ID = 16
TAIL = 8
PART_LINKS = 1 << 20
_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _PLUS = _SEEDS[:VALUES] | np.uint64(1), _SEEDS[VALUES:]
_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    out = words[: n - width + 1].copy()
    for i in range(1, width):
        out = mix(out * _STEPS[i % 3] + words[i : n - width + 1 + i])
    if width < size:
        out ^= np.uint64(width)
    return np.unique(out)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The set of each row of a text column, in order."""
    raw, offsets = utf8(column)
    held: list[np.ndarray] = []
    row = 0
    with np.errstate(over="ignore"):
        for first, rows, found in word_hashes(raw, offsets):
            last = int(rows[-1]) if len(rows) else first
            cuts = np.searchsorted(rows, np.arange(first, last + 2))
            for i in range(first, last + 1):
                while row < i:
                    yield _shingle_hashes(np.concatenate(held) if held else np.zeros(0, np.uint64), size)
                    held, row = [], row + 1
                held.append(found[cuts[i - first] : cuts[i - first + 1]])
        while row < len(offsets) - 1:
            yield _shingle_hashes(np.concatenate(held) if held else np.zeros(0, np.uint64), size)
            held, row = [], row + 1


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """VALUES minhash values of a set that isn't empty."""
    best = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 16) // VALUES)
    for at in range(0, len(shingles), step):
        part = shingles[at : at + step]
        np.minimum(best, ((part[:, None] * _TIMES) + _PLUS).min(axis=0), out=best)
    return best


def _order_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key per order of its first DEPTH values."""
    groups = values.reshape(ORDERS, DEPTH)
    key = np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(DEPTH):
        key = mix(key ^ groups[:, i])
    return key


def signatures(df: DataFrame, size: int) -> DataFrame:
    """doc_id, h, n_shingles, set_hi, set_lo, keys (one per order), sketch of each (doc_id, h, text) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in sliced(batches):
                sizes, hi, lo, keys, sketches = [], [], [], [], []
                for shingles in shingle_sets(batch.column(2), size):
                    sizes.append(len(shingles))
                    if not len(shingles):
                        hi.append(0), lo.append(0), keys.append(None), sketches.append(None)
                        continue
                    digest = np.frombuffer(blake2b(shingles.data, digest_size=16).digest(), np.int64)
                    hi.append(int(digest[0])), lo.append(int(digest[1]))
                    values = minhashes(shingles)
                    keys.append(_order_keys(values).view(np.int64))
                    sketches.append((mix(values) >> np.uint64(56)).astype(np.uint8).tobytes())
                cols = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "n_shingles", "set_hi", "set_lo", "keys", "sketch"])

    return df.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, n_shingles long, set_hi long, set_lo long, keys array<long>, sketch binary")


def _bit_map(ids: DataFrame, bits: int) -> bytes:
    """A map of a number of bits, with those of the hashed rows set."""
    at = ids.select(F.pmod(F.xxhash64("doc_id", "h"), F.lit(bits)).alias("at"))
    words = at.selectExpr("cast(at div 64 as int) as word", "shiftleft(1L, cast(at % 64 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def sets_of(df: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(c, shingles) of the rows of ``needed``: c, doc_id, h.

    A broadcast map of BITS_AN_ID bits a row, 32 MB at most, tells which texts to
    read. Where that isn't enough, texts and needed rows meet in a shuffled join.
    """
    needed = staged(needed, "needed")
    low, high = MAP_BITS
    wanted = BITS_AN_ID * needed.count()
    rows = df.filter("doc_id is not null")
    if wanted > high:
        marked, held = rows.join(needed.select("doc_id", "h"), ["doc_id", "h"], "left_semi").select("doc_id", "h", "text", F.lit(0).cast("long").alias("at")), None
    else:
        bits = max(low, 1 << wanted.bit_length())
        held = df.sparkSession.sparkContext.broadcast(_bit_map(needed, bits))
        marked = rows.select("doc_id", "h", "text", F.pmod(F.xxhash64("doc_id", "h"), F.lit(bits)).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint64) if held else np.full(1, 1, np.uint64)
        for batch in sliced(batches):
            at = batch.column(3).to_numpy()
            batch = batch.filter(pa.array((bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1))
            sets = [shingles.tobytes() for shingles in shingle_sets(batch.column(2), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["doc_id", "h", "shingles"])

    once = marked.mapInArrow(run, "doc_id long, h long, shingles binary").groupBy("doc_id", "h").agg(F.first("shingles").alias("shingles"))
    return once.join(needed, ["doc_id", "h"]).select("c", "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * common >= percent * (both - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("c").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("c").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (node, smallest node of its component) of a partition's links; PART_LINKS bounds them."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = top[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                top[max(a, b)] = min(a, b)
    nodes = [x for x in top if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(c, component): the smallest number that each linked one reaches.

    Links are dealt to partitions of about PART_LINKS, each of which makes stars of
    its own links' components. Where one partition holds them all, that is the
    result; else alternating stars join them. A round hangs every node's neighbours from the smallest one; rounds go on until
    nothing changes, which takes about the logarithm of the longest path. Each round's
    links are written to the shared folder and the ones before removed. Nodes with
    very many links are safe: minima are pre-aggregated, and joins are between written
    tables, which Spark can split at a hot key.
    """
    spark = links.sparkSession
    with scope(spark) as paths:
        links = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        parts = max(1, -(-links.count() // PART_LINKS))
        now = links.repartition(parts).mapInArrow(_stars, "a long, b long")
        if parts == 1:
            return lasting(now.select(F.col("a").alias("c"), F.col("b").alias("component")), "components")
        now = staged(now.distinct(), "stars")
        drop(spark, paths, 0, 1)
        before = None
        while True:
            old = len(paths)
            # large star: a node's larger neighbours go to its smallest neighbour
            both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = staged(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "low")
            large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            now = staged(large.distinct(), "large")
            # small star: a node's smaller neighbours, and itself, go to the smallest of them
            low = staged(now.groupBy("a").agg(F.min("b").alias("low")), "low")
            small = now.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("l")).select("l.*")
            now = staged(small.filter("a <> b").distinct(), "small")
            drop(spark, paths, old - 1, len(paths) - 1)
            state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == before:
                return lasting(now.select(F.col("a").alias("c"), F.col("b").alias("component")), "components")
            before = state


def _forest(crowd: DataFrame) -> DataFrame:
    """Each class's neighbour with the longest common prefix over all orders: pairs (a, b), a > b.

    Neighbours that partitions part aren't seen here: they are left to the later steps, which look at all open regions.
    """
    place = ["order", "key", "tail", "c"]
    rows = crowd.repartitionByRange(*place).sortWithinPartitions(*place).select(*place, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            last = batch.slice(batch.num_rows - 1) if batch.num_rows else last
            order, key, c, n = (table.column(i).to_numpy() for i in (0, 1, 3, 4))
            grid = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(len(c), TAIL)
            prefix = DEPTH + np.cumprod(grid[1:] == grid[:-1], axis=1).sum(axis=1)
            deep = DEPTH + np.minimum(TAIL, np.floor(np.log2(np.maximum(n[1:] / CROWD, 0.5))).astype(np.int64) + 1)
            near = (order[1:] == order[:-1]) & (key[1:] == key[:-1]) & (prefix >= deep)
            x, y, prefix = c[1:][near], c[:-1][near], prefix[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(x, y)), pa.array(np.append(y, x)), pa.array(np.append(prefix, prefix))], names=["a", "b", "prefix"])

    best = rows.mapInArrow(run, "a long, b long, prefix long").groupBy("a").agg(F.max(F.struct("prefix", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
    return best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _open_rows(crowd: DataFrame, settled: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the regions that hold more than one component, with their component and sketch."""
    rows = crowd.select("order", "key", "n", "total", "c").join(settled, "c", "left")
    rows = staged(rows.withColumn("component", F.coalesce("component", "c")), "rows")
    several = rows.groupBy("order", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return rows.join(staged(several.select("order", "key"), "several"), ["order", "key"]).join(classes.select("c", "sketch", "n_shingles"), "c")


def _tail(sketch, order, size: int):
    """The sketch bytes that follow an order's first DEPTH values."""
    return F.substring(F.concat(sketch, sketch), (F.pmod((order + 1) * DEPTH, F.lit(VALUES)) + 1).cast("int"), F.lit(size))


def _neighbours(rows: DataFrame) -> DataFrame:
    """Of each pair of components that are next to each other in an open region: the two members whose sketches agree best, in AGREE bytes or more.

    Pairs that batches or partitions part are left to the next step.
    """
    place = ["order", "key", "ahead", "c"]
    ahead = rows.withColumn("ahead", _tail(F.col("sketch"), F.col("order"), 16))
    sorted_rows = ahead.repartitionByRange(*place).sortWithinPartitions(*place).select("order", "key", "c", "component", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, key, ids, comps = (batch.column(i).to_numpy() for i in range(4))
            grid = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(ids), VALUES)
            agree = (grid[1:] == grid[:-1]).sum(axis=1)
            near = (order[1:] == order[:-1]) & (key[1:] == key[:-1]) & (comps[1:] != comps[:-1]) & (agree >= AGREE)
            x, y, p, q = ids[1:][near], ids[:-1][near], comps[1:][near], comps[:-1][near]
            cols = [np.minimum(p, q), np.maximum(p, q), agree[near].astype(np.int64), np.maximum(x, y), np.minimum(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["p", "q", "agree", "a", "b"])

    found = sorted_rows.mapInArrow(run, "p long, q long, agree long, a long, b long")
    return found.groupBy("p", "q").agg(F.max(F.struct("agree", "a", "b")).alias("m")).select("m.a", "m.b")


def _joined(settled: DataFrame, more: DataFrame) -> DataFrame:
    """The components of settled ones with more links."""
    more = staged(more, "links")
    if more.isEmpty():
        return settled
    return components(settled.select(F.col("c").alias("a"), F.col("component").alias("b")).union(more))


def _cells(rows: DataFrame) -> DataFrame:
    """cell, side, and the columns of each member of (order, key, c, component, n_shingles) rows, for each cell it goes to.

    Members of a region's largest component meet the others only; these meet each other too.
    """
    parts = rows.groupBy("order", "key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("t"))
    regions = parts.groupBy("order", "key").agg(F.max(F.struct("n", "t", "component")).alias("top"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    dealt = rows.join(staged(regions.filter("n > top.n"), "crowded"), ["order", "key"])
    blocks = lambda n, t: F.ceil(F.greatest(n / BLOCK, t / BLOCK_SHINGLES)).cast("int")
    most, rest = blocks(F.col("top.n"), F.col("top.t")), blocks(F.col("n") - F.col("top.n"), F.col("t") - F.col("top.t"))
    own = lambda count: F.pmod(F.xxhash64("c"), count).cast("int")
    spot = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    major = F.transform(F.sequence(F.lit(0), rest - 1), lambda x: spot(0, own(most), x, F.lit(1)))
    to_major = F.transform(F.sequence(F.lit(0), most - 1), lambda x: spot(0, x, own(rest), F.lit(0)))
    among = F.transform(F.sequence(F.lit(0), rest - 1), lambda x: spot(1, F.least(x, own(rest)), F.greatest(x, own(rest)), F.when(x == own(rest), 2).otherwise((own(rest) > x).cast("int"))))
    placed = dealt.select("order", "key", "c", "component", F.explode(F.when(F.col("component") == F.col("top.component"), major).otherwise(F.concat(to_major, among))).alias("s"))
    return placed.select(F.xxhash64("order", "key", "s.kind", "s.i", "s.j").alias("cell"), F.col("s.side").alias("side"), "c", "component")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Consecutive rows with the same first column, without it."""
    cell, held = None, []
    for batch in batches:
        for key, *rest in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if key != cell:
                if held:
                    yield held
                cell, held = key, []
            held.append(rest)
    if held:
        yield held


def _cell_links(cell: list, percent: int) -> Iterator[tuple[int, int]]:
    """Links between different components of a cell, a forest of them; rows: side, c, component, shingles.

    Rows of side 2 meet each other; rows of side 0 meet those of side 1 only. The
    largest component's members aren't compared with each other.
    """
    comps = np.array([r[2] for r in cell], np.int64)
    if (comps == comps[0]).all():
        return
    sides, ids = np.array([r[0] for r in cell], np.int8), np.array([r[1] for r in cell], np.int64)
    sizes = np.array([len(r[3]) // 8 for r in cell], np.int64)
    names, counts = np.unique(comps, return_counts=True)
    small = np.flatnonzero(comps != names[counts.argmax()])
    every = np.frombuffer(b"".join(r[3] for r in cell), np.uint64)
    owner = np.repeat(np.arange(len(cell)), sizes)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # shingles of one member only can't be common
    shared = times[column] > 1
    owner, column = owner[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(small), len(cell)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        low, high = np.searchsorted(column, [at, at + 2048])
        grid = np.zeros((len(cell), 2048), np.float32)
        grid[owner[low:high], column[low:high] - at] = 1
        common += grid[small] @ grid.T
    both = sizes[small][:, None] + sizes[None, :]
    linked = 100 * common.astype(np.int64) >= percent * (both - common.astype(np.int64))
    linked &= comps[small][:, None] != comps[None, :]
    linked &= (sides[small][:, None] == 2) & (sides[None, :] == 2) | (sides[small][:, None] != 2) & (sides[small][:, None] + sides[None, :] == 1)
    top = {c: c for c in names.tolist()}

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    for i, row in zip(small.tolist(), linked, strict=True):
        for j in np.flatnonzero(row).tolist():
            x, y = find(int(comps[i])), find(int(comps[j]))
            if x != y:
                top[x] = y
                yield max(int(ids[i]), int(ids[j])), min(int(ids[i]), int(ids[j]))


def _crowded(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components within crowded regions, counted exactly on full sets."""
    rows = _cells(rows).join(sets, "c").select("cell", "side", "c", "component", "shingles")
    rows = rows.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            pairs = list(_cell_links(cell, percent))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _promising(rows: DataFrame) -> DataFrame:
    """Pairs of different components within a small region whose sketches agree."""
    rows = rows.select(F.xxhash64("order", "key").alias("cell"), "c", "component", "sketch")
    rows = rows.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            ids, comps = np.array([r[0] for r in cell]), np.array([r[1] for r in cell])
            grid = np.frombuffer(b"".join(r[2] for r in cell), np.uint8).reshape(len(cell), VALUES)
            alike = ((grid[:, None] == grid[None, :]).sum(axis=2) >= AGREE) & (comps[:, None] != comps[None, :]) & (ids[:, None] > ids[None, :])
            x, y = np.nonzero(alike)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x], pa.int64()), pa.array(ids[y], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _rows(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, h (hash of the text), text; null texts are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, h, n_shingles, top_id, top_h of every row of ``_rows``: the row of its group with the smallest id and hash; nulls without id."""
    spark = docs.sparkSession
    with scope(spark):
        signed = staged(signatures(docs, size), "signatures")
        linkable = signed.filter("n_shingles > 0 and doc_id is not null")
        first = F.min(F.struct("doc_id", "h", "n_shingles", "keys", "sketch"))
        classes = linkable.groupBy("set_hi", "set_lo").agg(first.alias("m")).select("set_hi", "set_lo", "m.*")
        classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

        members = classes.select("c", "n_shingles", "sketch", F.posexplode("keys").alias("order", "key"))
        members = members.select("c", "n_shingles", "order", "key", _tail(F.col("sketch"), F.col("order"), TAIL).alias("tail"))
        regions = members.groupBy("order", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")).filter("n > 1")
        crowd = staged(members.drop("n_shingles").join(staged(regions, "regions"), ["order", "key"]), "crowd")

        needed = crowd.select("c").distinct().join(classes.select("c", "doc_id", "h"), "c")
        sets = staged(sets_of(docs, needed, size), "sets")
        settled = components(confirmed(staged(_forest(crowd), "forest"), sets, percent))

        # neighbours of different components, then whatever the regions still leave open
        near = staged(_neighbours(_open_rows(crowd, settled, classes)), "near")
        settled = _joined(settled, confirmed(near, sets, percent))
        left = staged(_open_rows(crowd, settled, classes), "left")
        few = staged(_promising(left.filter(F.col("n") <= CROWD)).distinct(), "promising")
        many = _crowded(left.filter(F.col("n") > CROWD).select("order", "key", "c", "component", "n_shingles"), sets, percent)
        settled = _joined(settled, confirmed(few, sets, percent).union(many))

        linked = settled.join(classes.select("c", "doc_id", "h"), "c")
        linked = linked.union(settled.select("component").distinct().join(classes.select(F.col("c").alias("component"), "doc_id", "h"), "component").select(F.col("component").alias("c"), "component", "doc_id", "h"))
        tops = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").alias("top_id"), F.col("h").alias("top_h"))).alias("top"))
        top = linked.select("c", "component").distinct().join(tops, "component").select("c", "top")
        named = staged(classes.select("c", "set_hi", "set_lo", "doc_id", "h").join(top, "c", "left").select("set_hi", "set_lo", F.coalesce("top", F.struct(F.col("doc_id").alias("top_id"), F.col("h").alias("top_h"))).alias("top")), "named")
        found = linkable.join(named, ["set_hi", "set_lo"]).select("doc_id", "h", "n_shingles", "top.*")
        # rows that link with nothing aren't joined: they all have one digest
        alone = signed.filter("n_shingles = 0 or doc_id is null")
        own = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c))
        return lasting(found.union(alone.select("doc_id", "h", "n_shingles", own("doc_id").alias("top_id"), own("h").alias("top_h"))), "groups")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; ids are integers. ``percent`` is at least 80."""
    found = _grouped(_rows(df, text_col, id_col), size, percent)
    kept = F.coalesce(F.col("doc_id") == F.col("top_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", F.col("top_id").alias("component_id"), kept.alias("kept"))


def op6_neardup(spark, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its group of near copies: four-word shingles, similarity 0.8."""
    from ._support import table

    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, whole, but one for each group of near copies: that with the smallest id.

    Rows that share an id but not a group stay, one each. Of rows with the same id
    and text one stays, that with the smallest hash of all columns. Rows with a
    null id stay.
    """
    rows = _rows(docs, text_col, id_col)
    kept = staged(_grouped(rows, size, percent).filter("doc_id = top_id and h = top_h").select("doc_id", "h").distinct(), "kept")
    k, h = fresh(docs, "k"), fresh(docs, "h")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({k: F.col(id_col).cast("long"), h: F.xxhash64(text)})
    one = keyed.join(kept.select(F.col("doc_id").alias(k), F.col("h").alias(h)), [k, h], "left_semi")
    one = one.groupBy(k, h).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return one.select("row.*").unionByName(docs.filter(F.col(id_col).isNull()))


#: The same by a join of all shingles; for tables of a few thousand documents.
ORACLE_SQL = {
    "op6_neardup": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) end) as g from w),
u as materialized (select doc_id, len(g) as n, unnest(g) as g from s),
f as materialized (select u.* from u where g in (select g from u group by g having count(*) > 1)),
p as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as c from f a join f b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as materialized (select x, y from p where 100 * c >= 80 * (nx + ny - c)),
e as materialized (select x, y from l union all select y, x from l),
r as (select doc_id as id, doc_id as top from documents union select e.y, r.top from r join e on e.x = r.id),
m as (select id, min(top) as top from r group by id)
select s.doc_id, cast(len(g) as bigint) as n_shingles, m.top as component_id, m.top = s.doc_id as kept from s join m on m.id = s.doc_id
"""
}
