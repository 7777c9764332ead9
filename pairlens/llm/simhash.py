"""SimHash near-duplicates by anchor points of a covering code.

Texts are lower-cased (A-Z) and cut into words at the six ASCII white-space bytes.
Every shingle of ``size`` words, joined by a space, repeats included, is hashed by
XXH64 with seed 42; a text of fewer words is one shingle. A fingerprint bit is 1 if
more than half the hashes have it. Fingerprints that differ in ``bits`` bits or
fewer are linked, and each document gets the smallest id that links reach.

1. Documents with equal fingerprints are one class before anything else, whatever
   the number of copies.
2. The anchors are the words of a covering code: the product of two perfect binary
   codes of 23 bits, each of covering radius RADIUS, over 46 of the 64 bits; 2 ** 24
   anchors. The nearest anchor is a fingerprint's home.
3. A fingerprint visits every anchor within the covering radius plus the threshold:
   if x differs from y in e of a part's bits, y is at most RADIUS + e bits from
   x's home there, and the e of the parts add up to ``bits`` at most. That is some
   60 anchors of 2 ** 24. A map of the anchors that are anyone's home, one bit
   each, 2 MB for any number of documents, is sent to the executors, and only these
   anchors are visited.
4. At each anchor the fingerprints at home there are compared, bit by bit, with all
   that visit it. Every link is seen at the home of both its ends. Anchors with more
   than BLOCK rows are dealt in blocks of homes by blocks of visitors, so that no
   task holds more; a task gives only those links that join its components.
5. Links become components as in the other near-duplicate operator.

Null and empty texts and texts without words have the fingerprint zero and are
linked like any other. Rows with a null id get their fingerprint, but take no part
in links; their component is null. Repeated rows get equal results; rows that share
an id but not a text have each their own fingerprint. Texts of any length count
whole, some megabytes at a time; an empty table gives no rows. Only the id and text
columns are read, so that others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import lasting, scope, sliced, staged
from .neardup import components
from .runs import words_of

SEED = 42
#: The perfect binary code of 23 bits: 12 free bits, divisible by this polynomial over GF(2).
LENGTH, FREE, POLYNOMIAL, RADIUS = 23, 12, 0b110001110101, 3
ANCHORS = 1 << 2 * FREE
BLOCK = 4096
CHUNK = 1024
HASHES = 1 << 16


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, some at a time."""
    held: list[bytes] = []
    seen = 0
    for part in words_of(text.lower()):
        held += part
        seen += len(part)
        # pieces may be anything from no word on
        for at in range(0, len(held) - size + 1, HASHES):
            words = held[at : at + HASHES + size - 1]
            line = b" ".join(words)
            ends = list(accumulate(map(len, words)))
            spans = [(end - len(w) + i, ends[i + size - 1] + i + size - 1) for i, (w, end) in enumerate(zip(words, ends[: len(words) - size + 1], strict=False))]
            yield np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], np.uint64)
        held = held[max(0, len(held) - size + 1) :]
    if 0 < seen < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, from the lowest."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cut = len(bits) // 255 * 255  # sums of 255 bits fit in a byte
    return bits[:cut].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[cut:].sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size):
        counts += _set_bits(hashes)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, size: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each (doc_id, text) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", size) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=4)
def code(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code as tables: the syndrome of every word, and for each syndrome the error patterns that lead
    to an anchor within RADIUS + bits, with their excess over RADIUS (127 in places left over)."""
    of_bit = []
    for i in range(LENGTH):
        rest = 1 << i
        for at in range(LENGTH - 1, LENGTH - FREE - 1, -1):
            if rest >> at & 1:
                rest ^= POLYNOMIAL << (at - (LENGTH - FREE))
        of_bit.append(rest)
    syndrome = np.zeros(1, np.int16)
    for s in of_bit:
        syndrome = np.concatenate([syndrome, syndrome ^ np.int16(s)])
    patterns = np.array([(sum(1 << i for i in held), max(0, n - RADIUS)) for n in range(RADIUS + bits + 1) for held in combinations(range(LENGTH), n)], np.int32)
    by = np.argsort(syndrome[patterns[:, 0]], kind="stable")
    patterns, key = patterns[by], syndrome[patterns[by, 0]].astype(np.int64)
    slot = np.arange(len(key)) - np.searchsorted(key, key)
    pattern, excess = np.zeros((1 << LENGTH - FREE, slot.max() + 1), np.int32), np.full((1 << LENGTH - FREE, slot.max() + 1), 127, np.int16)
    pattern[key, slot], excess[key, slot] = patterns[:, 0], patterns[:, 1]
    return syndrome, pattern, excess


def anchors(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors within the covering radius plus ``bits`` of unsigned fingerprints: row, anchor, whether it is its home."""
    syndrome, pattern, excess = code(bits)
    mask = np.uint64((1 << LENGTH) - 1)
    low, high = (fps & mask).astype(np.int64), (fps >> np.uint64(LENGTH) & mask).astype(np.int64)
    s, t = syndrome[low], syndrome[high]
    over = excess[s][:, :, None] + excess[t][:, None, :]
    row, x, y = np.nonzero(over <= bits)
    # the upper bits of an anchor name it
    first = (low[row] ^ pattern[s[row], x]) >> (LENGTH - FREE)
    second = (high[row] ^ pattern[t[row], y]) >> (LENGTH - FREE)
    return row, first << FREE | second, over[row, x, y] == 0


def _homes(classes: DataFrame) -> bytes:
    """A map of the anchors that are a fingerprint's home: one bit for each of the ANCHORS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8 * CHUNK):
            _, anchor, _ = anchors(batch.column(0).to_numpy().view(np.uint64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(anchor // 64, pa.int32()), pa.array(np.left_shift(np.uint64(1), (anchor % 64).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    words = classes.select("fp").mapInArrow(run, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # ANCHORS / 64 rows at most
    out = np.zeros(ANCHORS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def visits(classes: DataFrame, bits: int) -> DataFrame:
    """anchor, fp, home: the anchors within reach of each fingerprint that are home to one."""
    held = classes.sparkSession.sparkContext.broadcast(_homes(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes = np.frombuffer(held.value, np.uint64)
        for batch in sliced(batches, CHUNK):
            fps = batch.column(0).to_numpy()
            row, anchor, home = anchors(fps.view(np.uint64), bits)
            used = homes[anchor // 64] >> (anchor % 64).astype(np.uint64) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([pa.array(anchor[used], pa.int32()), pa.array(fps[row[used]]), pa.array(home[used])], names=["anchor", "fp", "home"])

    return classes.select("fp").mapInArrow(run, "anchor int, fp long, home boolean")


def _cells(rows: DataFrame) -> DataFrame:
    """cell, fp, side: an anchor's homes (side 0) and visitors (side 1), in blocks of each where there are many."""
    sizes = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("homes")).filter("n > 1")
    dealt = rows.join(staged(sizes, "sizes"), "anchor")
    h, v = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("homes", "n"))
    own = lambda blocks: F.pmod(F.xxhash64("fp"), blocks).cast("int")
    spot = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    visitor = F.transform(F.sequence(F.lit(0), h - 1), lambda i: spot(i, own(v), 1))
    home = F.transform(F.sequence(F.lit(0), v - 1), lambda j: spot(own(h), j, 0))
    spots = F.when(F.col("home"), F.concat(visitor, home)).otherwise(visitor)
    placed = dealt.select("anchor", "fp", F.explode(spots).alias("s"))
    return placed.select(F.xxhash64("anchor", "s.i", "s.j").alias("cell"), "fp", F.col("s.side").alias("side"))


def _links(homes: np.ndarray, visitors: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links between a cell's homes and its visitors, enough of them to join its components."""
    every = np.unique(np.append(homes, visitors))
    label = np.arange(len(every))
    at, of = np.searchsorted(every, homes), np.searchsorted(every, visitors)
    for start in range(0, len(homes), CHUNK):
        near = np.bitwise_count(homes[start : start + CHUNK, None] ^ visitors[None, :]) <= bits
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            mine, held = at[start + i], of[near[i]]
            labels, first = np.unique(label[held], return_index=True)
            other = labels != label[mine]
            if not other.any():
                continue
            for x in every[held[first[other]]].tolist():
                yield int(every[mine]), x
            label[np.isin(label, labels[other])] = label[mine]


def links(classes: DataFrame, bits: int) -> DataFrame:
    """(a, b): linked fingerprints, as many as join the components of each cell."""
    rows = _cells(staged(visits(classes, bits), "visits"))
    rows = rows.repartition("cell").sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def finished() -> pa.RecordBatch:
            fps, sides = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            found = np.array(list(_links(fps[sides == 0], fps[sides == 1], bits)), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            cell, fp, side = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if b > a and cell[a] != now:
                    if parts:
                        yield finished()
                    now, parts = cell[a], []
                parts.append((fp[a:b].view(np.uint64), side[a:b]))
        if parts:
            yield finished()

    return rows.mapInArrow(run, "a long, b long")


def near_fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row; ids are integers."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scope(df.sparkSession):
        signed = staged(fingerprints(docs, size), "fingerprints")
        classes = staged(signed.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "fp_classes")
        settled = components(links(classes, bits))
        ends = settled.select(F.col("c").alias("fp"), "component").union(settled.select(F.col("component").alias("fp"), "component").distinct())
        linked = staged(ends.join(classes, "fp"), "linked")
        tops = linked.groupBy("component").agg(F.min("first").alias("top"))
        top = linked.join(tops, "component").select("fp", "top")
        named = staged(classes.join(top, "fp", "left").select("fp", F.coalesce("top", "first").alias("component_id")), "named")
        found = signed.filter("doc_id is not null").join(named, "fp").select("doc_id", "fp", "component_id")
        return lasting(found.union(signed.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long"))), "simhash")


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over three-word shingles and the smallest id of its group within two bits."""
    from ._support import table

    found = near_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
