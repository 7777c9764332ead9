"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are n-grams of two kinds: its byte trigrams, hashed to TRIGRAMS
places, and the bigrams of its words' recency, which is how far back the same word
last stood, in powers of two (0: nowhere before). Counts are damped and weighted
by inverse document frequencies over all documents; each kind is scaled to unit
length, recency then to RECENCY_SHARE. A truncated singular value decomposition
of the bounded labelled sample gives the latent axes. The sample's vectors are
broadcast; every document's cosine with each of them is computed exactly, in
blocks, and the NEIGHBOURS nearest vote with their label, weighted by similarity.
The score is the share of the vote for label 1.

Texts are counted whole, whatever their length. Empty and null texts have a zero
vector and score the sample's share of label 1. Equal texts and repeated rows
score equally; cosines are rounded to 2 ** -20, and ties between neighbours go to
the sample's order, which is that of ids. With no labelled rows every score is 1;
an empty table gives no rows. Only ids and texts are read of documents, so that
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import labelled_texts
from ._support import fresh, held_out, sliced
from ._words import utf8, word_hashes

SAMPLE = 4096
TRIGRAMS = 4096
CLASSES = 16
WIDTH = TRIGRAMS + CLASSES * CLASSES
RECENCY_SHARE = 0.5
AXES = 64
NEIGHBOURS = 15
POWER = 4
THRESHOLD = 0.3
BLOCK = 256
PIECE = 1 << 21


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float


def _trigrams(raw: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Add the byte trigrams of each row to ``out``; the pieces that bound memory overlap by two bytes."""
    bits = np.uint32(32 - (TRIGRAMS.bit_length() - 1))
    for at in range(0, max(0, len(raw) - 2), PIECE):
        code = raw[at : at + PIECE + 2].astype(np.uint32)
        gram = (code[:-2] * np.uint32(0x01000193) ^ code[1:-1]) * np.uint32(0x01000193) ^ code[2:]
        gram = (gram * np.uint32(0x9E3779B1)) >> bits
        place = at + np.arange(len(gram))
        owner = np.searchsorted(offsets, place, side="right") - 1
        inside = place + 3 <= offsets[owner + 1]
        first, last = int(owner[0]), int(owner[-1]) + 1
        flat = (owner[inside] - first) * TRIGRAMS + gram[inside]
        out[first:last] += np.bincount(flat, minlength=(last - first) * TRIGRAMS).reshape(last - first, TRIGRAMS)


def _recency(raw: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Add the bigrams of each row's recency classes to ``out``."""
    found = [(rows, keys) for _, rows, keys in word_hashes(raw, offsets)]
    if not found:
        return
    rows, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(rows) < 2:
        return
    order = np.lexsort((keys, rows))  # stable: places of a word ascend
    again = (rows[order][1:] == rows[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    kinds = np.zeros(len(rows), np.int64)
    back = (order[1:] - order[:-1])[again]
    kinds[order[1:][again]] = np.minimum(CLASSES - 1, 1 + np.ceil(np.log2(back)).astype(np.int64))
    pairs = rows[1:] == rows[:-1]
    flat = rows[1:][pairs] * CLASSES * CLASSES + kinds[:-1][pairs] * CLASSES + kinds[1:][pairs]
    out += np.bincount(flat, minlength=out.size).reshape(out.shape)


def term_counts(column: pa.Array) -> np.ndarray:
    """A row of WIDTH counts for each row of a text column."""
    raw, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    _trigrams(raw, offsets, out[:, :TRIGRAMS])
    _recency(raw, offsets, out[:, TRIGRAMS:])
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted counts; each kind of terms scaled to its length."""
    out = np.sqrt(counts) * idf
    for part, share in ((slice(0, TRIGRAMS), 1), (slice(TRIGRAMS, None), RECENCY_SHARE)):
        size = np.linalg.norm(out[:, part], axis=1, keepdims=True)
        out[:, part] *= np.where(size > 0, share / np.where(size > 0, size, 1), 0)
    return out


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents and, of each term, the number that hold it; over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(WIDTH, np.int64), 0
        for batch in sliced(batches, BLOCK):
            total += np.count_nonzero(term_counts(batch.column(0)), axis=0)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WIDTH), pa.int32()), pa.array(np.append(rows, total), pa.int64())], names=["term", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(WIDTH + 1, np.int64)
    out[sums.column("term").to_numpy() + 1] = sums.column("n").to_numpy()
    return int(out[0]), out[1:]


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model of at most ``sample`` labelled documents and all documents' term frequencies; None without labelled rows.

    Only the places and counts that aren't zero go to the driver.
    """
    texts = labelled_texts(docs, labels, column, sample).select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK):
            counts = term_counts(batch.column(2))
            terms = [np.flatnonzero(x) for x in counts]
            held = [pa.array([t.astype(np.uint16).tobytes() for t in terms], pa.binary()), pa.array([x[t].tobytes() for x, t in zip(counts, terms, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *held], names=["doc_id", "label", "terms", "counts"])

    schema = T.StructType([*texts.schema.fields[:2], T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    rows = texts.mapInArrow(run, schema).toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    counts = np.zeros((rows.num_rows, WIDTH), np.float32)
    for x, terms, held in zip(counts, rows.column("terms").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        x[np.frombuffer(terms, np.uint16)] = np.frombuffer(held, np.float32)
    n, frequencies = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + frequencies)) + 0.1).astype(np.float32)
    return learn(counts, rows.column("label").to_numpy() > 0, idf)


def learn(counts: np.ndarray, labels: np.ndarray, idf: np.ndarray) -> Model:
    matrix = _weighted(counts, idf)
    # randomised truncated SVD from a fixed start
    basis = np.random.default_rng(0).standard_normal((matrix.shape[1], AXES + 8)).astype(np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    _, _, turn = np.linalg.svd(matrix @ basis, full_matrices=False)
    axes = (basis @ turn.T)[:, :AXES].astype(np.float32)
    return Model(idf, axes, _unit(matrix @ axes), labels.astype(np.float32), float(labels.mean()))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(size > 0, size, 1)).astype(np.float32)


def _nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row, ties to the smaller place."""
    nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosines, nearest, axis=1).min(axis=1)
    for i in np.flatnonzero((cosines >= least[:, None]).sum(axis=1) > k).tolist():
        equal = np.flatnonzero(cosines[i] == least[i])
        above = np.flatnonzero(cosines[i] > least[i])
        nearest[i] = np.append(above, equal[: k - len(above)])
    return np.sort(nearest, axis=1)


def vote(model: Model, counts: np.ndarray) -> np.ndarray:
    """The score of each row of term counts."""
    out = np.full(len(counts), model.share)
    for at in range(0, len(counts), BLOCK):
        block = _unit(_weighted(counts[at : at + BLOCK], model.idf) @ model.axes)
        cosines = np.round(block @ model.vectors.T * 2**20)
        nearest = _nearest(cosines, min(NEIGHBOURS, cosines.shape[1]))
        weights = np.maximum(np.take_along_axis(cosines, nearest, axis=1).astype(np.float64) / 2**20, 0) ** POWER
        total = weights.sum(axis=1)
        share = (weights * model.labels[nearest]).sum(axis=1) / np.where(total > 0, total, 1)
        out[at : at + BLOCK] = np.where(total > 0, np.clip(share, 0, 1), model.share)
    return out


def _scored(df: DataFrame, model: Model, score_col: str, text_col: str = "text") -> DataFrame:
    """The columns of ``df`` and the score of each row's text."""
    held = df.sparkSession.sparkContext.broadcast(asdict(model))  # executors may not be able to import the class
    schema = T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType(), False)])
    names, place = schema.names, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**held.value)
        for batch in sliced(batches, BLOCK):
            scores = vote(model, term_counts(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return df.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    return _scored(rows, model, "score").select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_junk(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose score reaches THRESHOLD. No shuffle."""
    if model is None:
        return docs
    score_col = fresh(docs, "score")
    return _scored(docs, model, score_col, text_col).filter(F.col(score_col) >= THRESHOLD).select(*docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    from ._support import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "score", "predicted")
