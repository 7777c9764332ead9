"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. From a
bounded sample of labelled documents, each of whose texts counts once however
often it was copied, every token gets the log-odds of being in a toxic document
and not in another; it counts once a document. Word ends vary, so the Dirichlet
prior is nested: beginnings of four characters have a prior of PRIOR documents
shared out as the two classes are, beginnings of six one shared out as their four
characters are, whole tokens one shared out as their six are. A token that the
sample holds in fewer than SEEN documents takes the log-odds of its longest known
beginning, one without any 0. Every token of a text then scores its own log-odds,
positive or negative, less COST, the price of a longer passage.

A linear scan finds all maximal-scoring segments of each whole text: the disjoint
passages whose score no extension or cut improves. By extreme-value theory a
passage of score S in a text of n tokens is expected E = K n exp(-lambda S) times
by chance; lambda solves sum p exp(lambda s) = 1 over the tokens' rates in other
documents. Passages with E below SIGNIFICANT are reported. The best passage's
-ln E and the sum over significant passages are calibrated to a probability by a
logistic fit, in which each half of the sample is scored by what was learned from
the other half.

Texts of any length are scored whole. Empty and null texts have no passage and
score as such. Equal texts and repeated rows score equally. With no labels of one
of the two classes every score is 0; an empty table gives no rows. Only ids and
texts are read of documents, so that other columns may have any names; labels are
read of the sample only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import labelled_texts, without_copies
from ._support import fresh, held_out, scope, sliced, staged
from ._words import chunks, hashes, utf8, words

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
PRIOR = 50.0
SEEN = 3
COST = 1.0
LEVELS = {"word": 0, "six": 6, "four": 4}
SIGNIFICANT = 0.05
K = 0.1
FOLDS = 2
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
PASSAGE = "struct<start:int,end:int,score:double,e:double>"


@dataclass
class Model:
    """Sorted token hashes and log-odds of each level, lambda, and the calibration."""

    levels: dict[str, tuple[np.ndarray, np.ndarray]]
    rate: float
    weights: tuple[float, float, float] | None


def _tokens(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row of each token, hashes of each level) of whole rows, in order."""
    raw, offsets = utf8(column)
    rows: list[np.ndarray] = [np.zeros(0, np.int64)]
    found: dict[str, list[np.ndarray]] = {name: [np.zeros(0, np.uint64)] for name in LEVELS}
    for first, last, start, end in chunks(raw, offsets):
        marks = np.clip(offsets[first : last + 1], start, end) - start
        codes, starts, ends, row = words(raw[start:end], marks, _SEPARATORS)
        lead = (codes & 0xC0) != 0x80
        characters = np.flatnonzero(lead)
        number = np.cumsum(lead)[starts] - 1
        places = np.append(characters, np.full(8, len(codes)))
        rows.append(row + first)
        for name, size in LEVELS.items():
            found[name].append(hashes(codes, starts, np.minimum(ends, places[number + size]) if size else ends))
    return np.concatenate(rows), {name: np.concatenate(x) for name, x in found.items()}


def token_counts(sample: DataFrame) -> DataFrame:
    """word, six, four (hashes) and c00, c01, c10, c11: the number of documents of each fold and label that hold the word.

    A word counts once a document, so that one that repeats it hundreds of times has one vote.
    """
    names = [f"c{fold}{label}" for fold in range(FOLDS) for label in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            group = batch.column(1).to_numpy().astype(np.int64) * 2 + (batch.column(2).to_numpy() > 0)
            rows, found = _tokens(batch.column(0))
            order = np.lexsort((found["word"], rows))
            rows, found = rows[order], {name: x[order] for name, x in found.items()}
            once = np.append(True, (rows[1:] != rows[:-1]) | (found["word"][1:] != found["word"][:-1]))[: len(rows)]
            rows, found = rows[once], {name: x[once] for name, x in found.items()}
            _, at, inverse = np.unique(found["word"], return_index=True, return_inverse=True)
            cells = np.bincount(inverse * len(names) + group[rows], minlength=len(at) * len(names)).reshape(len(at), len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[name][at].view(np.int64)) for name in LEVELS), *(pa.array(x) for x in cells.T)], names=[*LEVELS, *names])

    counts = sample.select("text", "fold", "label").mapInArrow(run, ", ".join(f"{n} long" for n in [*LEVELS, *names]))
    return counts.groupBy("word").agg(F.min("six").alias("six"), F.min("four").alias("four"), *(F.sum(n).alias(n) for n in names))


def _tables(counts: DataFrame) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Totals of the four counts, and (hash, hash of the level above, counts) of each level's entries in SEEN documents or more, sorted by hash.

    The sample's bound bounds what is collected.
    """
    names = [c for c in counts.columns if c not in LEVELS]
    total = np.array([float(x or 0) for x in counts.agg(*(F.sum(n) for n in names)).first()])
    enough = sum((F.col(n) for n in names), F.lit(0)) >= SEEN
    tables = {}
    for name, above in (("four", "four"), ("six", "four"), ("word", "six")):
        sums = counts if name == "word" else counts.groupBy(name).agg(F.min(above).alias("above"), *(F.sum(n).alias(n) for n in names))
        rows = sums.withColumn("above", F.col(above)) if name == "word" else sums
        rows = rows.filter(enough).select(name, "above", *names).toArrow()
        keys, parents = (rows.column(c).to_numpy().view(np.uint64) for c in (name, "above"))
        order = np.argsort(keys)
        tables[name] = keys[order], parents[order], np.column_stack([rows.column(n).to_numpy() for n in names]).reshape(len(keys), len(names))[order]
    return total, tables


def _learn_tokens(total: np.ndarray, tables: dict, folds: tuple[int, ...]) -> Model | None:
    """Nested log-odds from the counts of some folds."""
    n0, n1 = (sum(total[2 * f + label] for f in folds) for label in (0, 1))
    if not n0 or not n1:
        return None
    base = math.log(n1 / n0)
    levels: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    mass: dict[str, np.ndarray] = {}
    above: tuple[np.ndarray, np.ndarray] | None = None
    rates, scores = [], []
    for name in ("four", "six", "word"):
        keys, parents, counts = tables[name]
        c0, c1 = (sum(counts[:, 2 * f + label] for f in folds).astype(float) for label in (0, 1))
        known = c0 + c1 >= SEEN
        keys, parents, c0, c1 = keys[known], parents[known], c0[known], c1[known]
        if above is None:
            prior = np.zeros(len(keys))
        else:
            at = np.searchsorted(above[0], parents)  # what is above a known entry is known
            prior = above[1][at]
            mass[parent] = mass[parent] - np.bincount(at, c0, len(above[0]))
        share = 1 / (1 + np.exp(-(prior + base)))
        odds = np.log((c1 + PRIOR * share) / (c0 + PRIOR * (1 - share))) - base
        if above is not None:
            odds = np.where(keys == parents, prior, odds)  # a token no longer than its beginning
        levels[name] = above = keys, odds
        mass[name], parent = c0, name
    for name, (_, odds) in levels.items():
        rates.append(np.maximum(mass[name], 0) / n0)
        scores.append(odds - COST)
    rest = max(0.0, 1 - sum(float(r.sum()) for r in rates))
    return Model(levels, _rate(np.append(np.concatenate(rates), rest), np.append(np.concatenate(scores), -COST)), None)


def _rate(p: np.ndarray, s: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1; 1, its value for exact log-likelihood ratios, where there is none."""
    if (p * s).sum() >= 0 or not (s > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float((p * np.exp(x * s)).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def token_scores(model: Model, found: dict[str, np.ndarray]) -> np.ndarray:
    """The score of each token."""
    _, at, inverse = np.unique(found["word"], return_index=True, return_inverse=True)
    scores = np.zeros(len(at))
    for level in ("four", "six", "word"):
        keys, values = model.levels[level]
        if len(keys) and len(at):
            wanted = found[level][at]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            scores = np.where(keys[place] == wanted, values[place], scores)
    return scores[inverse] - COST


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time.

    Each candidate holds the sum before it, l, and up to its end, r. A new one
    looks for the last candidate with a smaller l; unless that one's r is as
    large, they join and the search goes on. Each candidate remembers where its
    own search ended, so that candidates passed once aren't passed again.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    places = np.flatnonzero(scores > 0)
    held: list[tuple[int, int, float, float, int]] = []
    for place, before, after in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist(), strict=True):
        start, j = place, len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= after:
                held.append((start, place + 1, before, after, j))
                break
            start, _, before, _, above = held[j]
            del held[j:]
            j = above
    return [(start, end, after - before) for start, end, before, after, _ in held]


def _features(found: list[tuple[int, int, float]], tokens: int, rate: float) -> tuple[float, float, list[tuple[int, int, float, float]]]:
    base = math.log(K * max(1, tokens))
    bits = [rate * s - base for _, _, s in found]
    passages = [(a, b, s, math.exp(min(700.0, -x))) for (a, b, s), x in zip(found, bits, strict=True) if math.exp(min(700.0, -x)) < SIGNIFICANT]
    return max(bits, default=-base), math.log1p(sum(x for x in bits if x > -math.log(SIGNIFICANT))), passages


def _segments(model: Model, column: pa.Array) -> Iterator[tuple[float, float, list]]:
    """The two features and the significant passages of each row."""
    rows, found = _tokens(column)
    scores = token_scores(model, found)
    cuts = np.searchsorted(rows, np.arange(len(column) + 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield _features(maximal_segments(scores[a:b]), int(b - a), model.rate)


def _scored(df: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The columns of ``df`` and three more, whose names come second: both features and the passages of each row's text."""
    held = df.sparkSession.sparkContext.broadcast(asdict(model))  # executors may not be able to import the class
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e", pa.float64())]))
    more = [fresh(df, c) for c in ("best", "total", "passages")]
    kinds = (T.DoubleType(), T.DoubleType(), T._parse_datatype_string(f"array<{PASSAGE}>"))
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, kind) for c, kind in zip(more, kinds, strict=True))])
    names, place = schema.names, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**held.value)
        for batch in sliced(batches):
            out = list(_segments(model, batch.column(place)))
            passages = [[dict(zip(("start", "end", "score", "e"), p, strict=True)) for p in x[2]] for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64()), pa.array(passages, passage)], names=names)

    return df.mapInArrow(run, schema), more


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Weights of a ridge logistic regression, the last for the constant.

    Newton steps on standardised features, halved until the loss falls, so that
    separable classes don't make them run away.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = ridge * len(y) * np.append(np.ones(x.shape[1]), 1e-3)

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float((np.logaddexp(0, t) - y * t).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        gradient = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if size <= 1e-6 or np.abs(step).max() < 1e-10:
            break
    slope = w[:-1] / scale
    return np.append(slope, w[-1] - float((slope * mean).sum()))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model of at most ``sample`` labelled documents, or None where they don't hold both classes.

    The calibration is fitted on scores that each half of the sample gets from the other one's tokens.
    """
    with scope(docs.sparkSession):
        texts = staged(labelled_texts(docs, labels, column, sample), "toxicity-sample")
        fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
        texts = staged(without_copies(texts).select("doc_id", fold.alias("fold"), (F.col("label") > 0).cast("int").alias("label"), "text"), "toxicity-once")
        total, tables = _tables(staged(token_counts(texts), "toxicity-counts"))
        model = _learn_tokens(total, tables, tuple(range(FOLDS)))
        if model is None:
            return None
        parts = []
        for fold in range(FOLDS):
            other = _learn_tokens(total, tables, tuple(f for f in range(FOLDS) if f != fold))
            # too few labels for halves: these rows are scored by the whole
            scored, (best, sums, _) = _scored(texts.filter(F.col("fold") == fold).select("label", "text"), other or model)
            parts.append(scored.select("label", F.col(best).alias("best"), F.col(sums).alias("sums")).toArrow())
        x = np.concatenate([np.column_stack([rows.column("best").to_numpy(), rows.column("sums").to_numpy()]) for rows in parts])
        model.weights = tuple(logistic(x, np.concatenate([rows.column("label").to_numpy() for rows in parts]).astype(float)).tolist())
    return model


def _value(model: Model, best: str, total: str) -> F.Column:
    a, b, c = model.weights
    return 1 / (1 + F.exp(-(F.col(best) * a + F.col(total) * b + c)))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted, passages (token positions, score, expected count by chance) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(f"array<{PASSAGE}>").alias("passages"))
    scored, (best, total, passages) = _scored(rows, model)
    out = scored.select("doc_id", _value(model, best, total).alias("score"), F.col(passages).alias("passages"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that aren't predicted to be toxic. No shuffle."""
    if model is None:
        return docs
    scored, (best, total, _) = _scored(docs, model, text_col)
    return scored.filter(_value(model, best, total) < 0.5).select(*docs.columns)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    from ._support import table

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
