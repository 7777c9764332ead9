"""Periodic runs of words by longest previous factors.

A run is a stretch of consecutive words with smallest period q, of at least
``least`` words and ``times`` * q (2 or more times), that no neighbouring word extends keeping the
period. Words are what stands between the six ASCII white-space bytes.

1. The words of a document are numbered as they first occur. Suffixes are sorted by
   prefix doubling, many documents at once, whose suffixes don't mix; a step sorts
   only the positions whose names aren't unique yet. The names of every step, one
   for each stretch of 2 ** i words, stay: equal names are equal stretches, so that
   a common extension of two positions, to either side, is found by halving steps.
2. Suffix array and LCP give the longest previous factor of each position, and an
   earlier place of it: positions leave a linked list of the suffix array from the
   last to the first, the larger of the two LCPs around each is its own.
3. Longest previous factors cut the document into LZ blocks.
4. Main's extensions: runs that touch a boundary between blocks are found there, by
   extending to both sides for each period up to the two blocks' length by ``times`` - 1. A run
   that touches boundaries touches one at which its period is in this range: a
   block that starts in the run's second period or later reaches the run's end.
   The periods tried are no more than the words.
5. All other runs lie within a block, and are copies of runs of its earlier place.
   Runs are kept in buckets by their start; blocks are passed in order, and copy
   the buckets of their earlier place, also where that place overlaps the block.

A run repeats a stretch of least - least / times words or more, so that of two
blocks around a boundary that it needs one has half of that. Documents whose LCPs
don't reach this have no runs and stop after step 1.

Documents pass in chunks of about CHUNK words; a longer document is a chunk of its
own and takes about 200 bytes a word. Null and empty texts and texts without words
have no runs and an empty collapsed text. Rows without an id, with repeated ids or
repeated texts each get their own result; an empty table gives no rows. Extra
columns may have any names: only the id and the text are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import sliced

CHUNK = 1 << 18
PIECE = 1 << 22
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of some megabytes each."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        if gap is None:
            break
        yield text[at : gap.start()].split()
        at = gap.end()
    yield text[at:].split()


class Factors:
    """Suffix array, LCP and names of all stretches of 2 ** i words of some documents, laid one after the other."""

    def __init__(self, ids: np.ndarray, lengths: list[int]):
        n = len(ids)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        end = self.bounds[1:][doc]
        name = self.bounds[doc] + ids  # documents' names don't mix
        order = np.argsort(name, kind="stable")
        name = self._starts(name[order])[np.argsort(order, kind="stable")]
        self.names = [np.append(name, -1).astype(np.int32)]
        sorted_by, step = order, 1
        open_at = self._shared(order, name)
        while len(open_at):
            after = np.minimum(open_at + step, n)
            key = name[open_at] * (n + 1) + np.where(after < end[open_at], self.names[-1][after].astype(np.int64) + 1, 0)
            by = np.argsort(key, kind="stable")
            key, held = key[by], open_at[by]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            old = name[held]
            first = np.ones(len(key), bool)
            first[1:] = old[1:] != old[:-1]
            at = np.arange(len(key))
            inside = at - np.maximum.accumulate(np.where(first, at, 0))  # place in the old name's group
            sorted_by[old + inside] = held
            place = np.maximum.accumulate(np.where(new, at, 0))
            name = name.copy()
            name[held] = old + inside[place]
            self.names.append(np.append(name, -1).astype(np.int32))
            single = new & np.append(new[1:], True)
            open_at, step = held[~single], 2 * step
        self.order = sorted_by
        self.lcp = np.zeros(n, np.int64)
        if n > 1:
            near = doc[sorted_by[1:]] == doc[sorted_by[:-1]]
            self.lcp[1:][near] = self.forward(np.minimum(sorted_by[1:], sorted_by[:-1])[near], np.maximum(sorted_by[1:], sorted_by[:-1])[near])

    @staticmethod
    def _starts(keys: np.ndarray) -> np.ndarray:
        """For sorted keys, the place where each one's group starts."""
        at = np.arange(len(keys))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return np.maximum.accumulate(np.where(new, at, 0)) if len(keys) else at

    @staticmethod
    def _shared(order: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The positions, in order, whose name another one has."""
        same = name[order][1:] == name[order][:-1]
        return order[np.append(same, False) | np.append(False, same)] if len(order) else order

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i < j on are equal."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            step = (self.names[level][i] == self.names[level][j]).astype(np.int64) << level
            i, j, total = i + step, j + step, total + step
        return total

    def backward(self, i: np.ndarray, j: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many words up to i < j are equal, down to ``first``."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            size = 1 << level
            fits = i - size + 1 >= first
            step = (fits & (self.names[level][np.where(fits, i - size + 1, -1)] == self.names[level][np.where(fits, j - size + 1, -1)])).astype(np.int64) << level
            i, j, total = i - step, j - step, total + step
        return total


def previous_factors(order: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """The longest previous factor of each position and an earlier place of it, from a document's suffix array and LCP."""
    n = len(order)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    lcp = [*lcp, 0]
    lcp[0] = 0
    before, after = list(range(-1, n)), list(range(1, n + 2))
    longest, place = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        p, q = before[r], after[r]
        x, y = lcp[r], lcp[q] if q <= n else 0
        if x >= y:
            longest[i], low = x, y
            if x:
                place[i] = order[p]
        else:
            longest[i], low, place[i] = y, x, order[q]
        lcp[q] = low
        before[q] = p
        if p >= 0:
            after[p] = q
    return longest, place


def blocks(longest: list[int], place: list[int]) -> tuple[list[int], list[int]]:
    """LZ blocks: their starts, with the end of the last, and an earlier place of each."""
    starts, sources, at = [0], [], 0
    while at < len(longest):
        sources.append(place[at])
        at += max(1, longest[at])
        starts.append(at)
    return starts, sources


def touching(factors: Factors, cuts: np.ndarray, periods: np.ndarray, first: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """Main's extensions: the runs (start, end, period) that touch a boundary, for each boundary's greatest period."""
    total = int(periods.sum())
    which = np.repeat(np.arange(len(cuts)), periods)
    q = np.arange(total) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    b, low, end = cuts[which], first[which], factors.bounds[np.searchsorted(factors.bounds, first[which], side="right")]
    found = []
    # the run holds a whole period to the right of the boundary, or to the left of it
    for i, j in ((b, b + q), (b - q, b)):
        ok = (i >= low) & (j <= end)
        p, i, j = q[ok], i[ok], j[ok]
        start, stop = i - factors.backward(i - 1, j - 1, low[ok]), j + factors.forward(i, j)
        ok = stop - start >= np.maximum(least, times * p)
        found.append(np.stack([start[ok], stop[ok], p[ok]]))
    start, stop, p = np.concatenate(found, axis=1)
    if not len(start):
        return []
    by = np.lexsort((p, stop, start))
    start, stop, p = start[by], stop[by], p[by]
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])  # the smallest period of each stretch
    return list(zip(start[once].tolist(), stop[once].tolist(), p[once].tolist(), strict=True))


def copied(found: list[tuple[int, int, int]], starts: list[int], sources: list[int], least: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period): those that touch boundaries and their copies within blocks, by start and period."""
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for start, stop, p in found:
        buckets[start].append((stop, p))
    places = sorted(buckets)
    fresh: list[int] = []
    for a, b, source in zip(starts, starts[1:], sources, strict=False):
        if b - a < least + 2 or not buckets:
            continue
        shift = a - source
        if fresh:
            places, fresh = sorted({*places, *fresh}), []
        # starts in (source, source + b - a); where the place overlaps the block, copies are copied on
        todo = [s for s in places if source < s < source + b - a]
        at = 0
        while at < len(todo):
            s = todo[at]
            at += 1
            new = [(stop + shift, p) for stop, p in buckets[s] if stop + shift < b and (stop + shift, p) not in buckets[s + shift]] if s + shift < b else []
            if new:
                buckets[s + shift] += new
                fresh.append(s + shift)
                if s + shift < source + b - a:
                    todo.append(s + shift)
    return sorted((s, stop - s, p) for s, held in buckets.items() for stop, p in held)


def runs_of(ids: np.ndarray, lengths: list[int], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each of some documents; ids number the words of each from 0."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    if not len(ids):
        return out
    factors = Factors(ids, lengths)
    need = least - least // times + 1  # of the two blocks around a boundary
    cuts, periods, firsts, held = [], [], [], []
    for d, length in enumerate(lengths):
        a = int(factors.bounds[d])
        lcp = factors.lcp[a : a + length]
        if not length or 2 * int(lcp.max()) < need:
            continue
        starts, sources = blocks(*previous_factors((factors.order[a : a + length] - a).tolist(), lcp.tolist()))
        size = np.diff(np.array([0, *starts, length]))
        around = size[:-1] + size[1:]
        near = np.flatnonzero(around >= need)
        cuts.append(a + np.array(starts)[near])
        periods.append(around[near] // (times - 1))
        firsts.append(np.full(len(near), a))
        held.append((d, starts, sources))
    if not held:
        return out
    by_doc: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    owner = {int(factors.bounds[d]): d for d, _, _ in held}
    cut, period, first = np.concatenate(cuts), np.concatenate(periods), np.concatenate(firsts)
    step = np.cumsum(period) // CHUNK  # bounds what is extended at a time
    for part in np.split(np.arange(len(cut)), np.flatnonzero(np.diff(step)) + 1):
        for start, stop, p in touching(factors, cut[part], period[part], first[part], least, times):
            a = int(factors.bounds[np.searchsorted(factors.bounds, start, side="right") - 1])
            by_doc[owner[a]].append((start - a, stop - a, p))
    for d, starts, sources in held:
        best: dict[tuple[int, int], int] = {}
        for start, stop, p in by_doc[d]:
            best[start, stop] = min(p, best.get((start, stop), p))
        out[d] = copied([(s, e, p) for (s, e), p in best.items()], starts, sources, least)
    return out


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words but those that a run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        edge[start + p] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start and period) and collapsed of every row: the words joined by
    one space, without those that a run holds after its first period."""

    def finished(docs: list[tuple[object, list[bytes]]], ids: list[np.ndarray]) -> pa.RecordBatch:
        every = runs_of(np.concatenate(ids) if ids else np.zeros(0, np.int64), [len(w) for _, w in docs], least, times)
        text = [b" ".join(_kept(w, r) if r else w).decode() for (_, w), r in zip(docs, every, strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in every], kind)
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), runs, pa.array(text, pa.string())], names=["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, ids, held = [], [], 0
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers: dict[bytes, int] = {}
                words: list[bytes] = []
                for part in words_of(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    words += part
                # a word's number is the place where it first stands
                found = np.fromiter(map(numbers.setdefault, words, count()), np.int64, len(words))
                docs.append((doc_id, words))
                ids.append(found)
                held += len(words)
                if held >= CHUNK or len(docs) >= 4096:
                    yield finished(docs, ids)
                    docs, ids, held = [], [], 0
        yield finished(docs, ids)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: F.Column, text: F.Column) -> F.Column:
    """The text, or for a tenth of the ids its words with a periodic end: from word a on, the next p words over and over."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def ended(words: F.Column) -> F.Column:
        n = F.size(words).cast("long")
        bound = F.array(F.struct(words.alias("words"), (g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p")))
        # a lambda's argument, so that it is made once and not for each word
        return F.array_join(F.get(F.transform(bound, lambda x: F.transform(x["words"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["words"], (x["a"] + (i - x["a"]) % x["p"]).cast("int"))))), F.lit(0)), " ")

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    has_words = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")) > 0
    return F.when((h % 10 == 0) & has_words, F.get(F.transform(F.array(words), ended), F.lit(0))).otherwise(text)


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every document after a periodic end is planted in a tenth of them: 24 words and three periods at least."""
    from ._support import table

    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    # a strictly greater ratio of length and period wins, so that of equal ones the first stays
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda m, r: F.when(r["length"] * m["period"] > m["length"] * r["period"], r).otherwise(m))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
