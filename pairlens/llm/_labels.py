"""Bounded, reproducible samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._support import held_out, sliced, staged
from ._words import mix
from .neardup import shingle_sets

KEYS = 6
_TURNS = mix(np.arange(1, KEYS + 1, dtype=np.uint64))


def labelled_sample(labels: DataFrame, column: str, size: int) -> DataFrame:
    """(doc_id, label) of at most ``size`` rows that may be learned from: those with the smallest hashes of their ids.

    Held-out ids, null ids and null labels are left out. An id with several labels counts with the largest.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out("doc_id"))
    once = usable.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, size: int) -> DataFrame:
    """(doc_id, label, text) of the documents in the sample, one row an id; the sample's size bounds what is broadcast and what comes out.

    Where an id has several texts its smallest one is learned from.
    """
    sample = F.broadcast(labelled_sample(labels, column, size))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def without_copies(texts: DataFrame) -> DataFrame:
    """The sample's rows but for later copies and near copies, so that a text that was copied hundreds of times has one vote.

    A row goes if one of its KEYS minhashes over three-word shingles is that of a row
    with a smaller id: a near copy shares one almost surely, an unrelated text none.
    Rows without words stay. The sample is bounded, and so is this.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys = [[int(x) for x in mix(s[:, None] ^ _TURNS).min(axis=0).view(np.int64)] if len(s) else [] for s in shingle_sets(batch.column(1), 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "keys"])

    schema = T.StructType([texts.schema["doc_id"], T.StructField("keys", T.ArrayType(T.LongType()))])
    keyed = staged(texts.select("doc_id", "text").mapInArrow(run, schema).select("doc_id", F.posexplode("keys").alias("turn", "key")), "sample-keys")
    first = keyed.groupBy("turn", "key").agg(F.min("doc_id").alias("first"))
    copies = keyed.join(first, ["turn", "key"]).filter("doc_id > first").select("doc_id").distinct()
    return texts.join(copies, "doc_id", "left_anti")
