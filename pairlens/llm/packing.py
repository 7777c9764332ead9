"""Best-fit packing of tokenized documents, certified by dual-feasible functions.

A document's ids are those of the tokenizer file, then a closing id. Documents
longer than a sequence are cut into whole pieces; the first may be shorter. The
pieces are dealt to groups of about GROUP, each packed by best-fit decreasing.
Lower bounds from dual-feasible functions certify a group whose number of bins
they reach. Groups with a gap give up the pieces of bins that aren't full; these
are dealt again among fewer groups and repacked, and the new packing replaces the
old one if it has fewer bins. This ends when every group is certified or a round
brings no gain.

The ids are those of the ``tokenizers`` library. They are made by tiktoken from
the same file's vocabulary: its ids are its merge ranks, which each worker checks
merge by merge before it starts; the ids are equal then and take a third of the
time. A file of another kind is encoded by ``tokenizers`` itself. Strings of
special tokens are ordinary text.

Null texts are empty ones: one piece, the closing id. Rows may repeat and ids may
be null: rows travel through the packing and are never joined. Texts of any length
are encoded whole, in chunks. An empty table gives no rows. Only the id and text
columns are read, so that others may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._support import sliced, staged, worker_cache
from .bpe import encode_chunk, safe_chunks

CAPACITY = 2048
GROUP = 16384
#: What a tokenizer file says that splits by the shared pattern and merges bytes only.
SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_are_ranks(spec: dict) -> bool:
    """Whether a tokenizer file is a byte-level vocabulary whose ids are the 256 bytes and then the merges in their order."""
    model, vocab = spec["model"], spec["model"]["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    plain = all(spec["pre_tokenizer"].get(k) == v for k, v in SPLIT.items()) and all(model.get(k) == v for k, v in PLAIN.items()) and spec["normalizer"] is None
    return plain and len(vocab) == 256 + len(merges) and all(vocab.get(left + right) == 256 + i for i, (left, right) in enumerate(merges))


def load_encoder(path: str):
    """A function from text to ids, kept for the life of the process."""
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    cache = worker_cache()
    if ("encoder", path) in cache:
        return cache["encoder", path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    slow = lambda text: library.encode(text, add_special_tokens=False).ids
    cache["encoder", path] = (lambda chunk: encode_chunk(encoding, chunk)) if ids_are_ranks(spec) else slow
    return cache["encoder", path]


def ids_of(encode, text: str, closing: int = 0) -> np.ndarray:
    parts = [np.asarray(encode(chunk), dtype="<u4") for chunk in safe_chunks(text)]
    return np.concatenate([*parts, np.asarray([closing], dtype="<u4")])


def pieces(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, closing: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces; with ``ids`` also the packed ids."""
    path = path or tokenizer_file()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "token_ids"][: 6 if ids else 5]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(path)
        for batch in sliced(batches):
            rows, out = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = ids_of(encode, text or "", closing)
                first = (len(found) - 1) % capacity + 1
                for piece, end in enumerate(range(first, len(found) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    raw = found[start:end].tobytes()
                    rows.append(row)
                    out.append((piece, start, end - start, zlib.crc32(raw), raw))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols[: len(names) - 1], kinds, strict=False))], names=names)

    fields = T._parse_datatype_string("piece int, start long, length long, ids_crc32 long, token_ids binary").fields[: len(names) - 1]
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *fields])
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of bins that no packing can go below; counts[s] items have size s, up to ``capacity``.

    The best of two families of dual-feasible functions: one that takes sizes over
    capacity - e as whole bins and drops those below e, for every e up to half;
    and one that rounds sizes to multiples of 1 / k, for k up to 32.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    e = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = volume[capacity - e] - np.where(e > 0, volume[np.maximum(e - 1, 0)], 0)
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 33):
        whole = sizes * (k + 1) % capacity == 0
        weight = np.where(whole, sizes * k, sizes * (k + 1) // capacity * capacity)
        best = max(best, -(-int((counts * weight).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: (bin, offset) of each item and each bin's free room. Ties by position."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    rooms = 0  # bit r is set where some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = room - size
        if free[b]:
            by_room[free[b]].append(b)
            rooms |= 1 << free[b]
    return bins, offsets, free


def _packed(rows: DataFrame, number: int, first: int, groups: int, capacity: int) -> DataFrame:
    """Deal rows to groups, numbered from ``first``, and pack each; adds sequence_id, offset, room, spare (bins over the group's bound)."""
    if first + groups > 1 << 35:
        raise ValueError("too many groups")
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(groups)))
    base = list(rows.columns)

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, free = best_fit(lengths, capacity)
        spare = len(free) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        group = table.column("g")[0].as_py()
        out = table.drop_columns(["g"])
        out = out.append_column("sequence_id", pa.array(bins + ((first + group) << 28)))
        out = out.append_column("offset", pa.array(offsets))
        out = out.append_column("room", pa.array(np.asarray(free, np.int64)[bins]))
        return out.append_column("spare", pa.array(np.full(len(bins), spare, np.int64)))

    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("sequence_id long, offset long, room long, spare long").fields])
    return dealt.groupBy("g").applyInArrow(pack, schema).select(*base, "sequence_id", "offset", "room", "spare")


def pack(rows: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP, rounds: int | None = None) -> DataFrame:
    """The rows, each with a ``length`` of 1 to ``capacity``, and their sequence_id and offset; ``rounds`` bounds the packings of a row, None doesn't."""
    columns = list(rows.columns)
    rows = staged(rows, "pieces")
    # whole pieces fill a sequence each
    done = rows.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    first = 0

    def packed(rows: DataFrame, number: int) -> DataFrame:
        nonlocal first
        groups = max(1, -(-rows.count() // group_size))
        out = staged(_packed(rows, number, first, groups, capacity), "packed")
        first += groups
        return out

    now = packed(rows.filter(F.col("length") < capacity), 0)
    number = 1
    while rounds is None or number < rounds:
        open_rows = (F.col("spare") > 0) & (F.col("room") > 0)
        before = now.filter(open_rows).agg(F.count_distinct("sequence_id")).first()[0]
        if not before:
            break
        again = packed(now.filter(open_rows).select(*columns), number)
        if again.agg(F.count_distinct("sequence_id")).first()[0] >= before:
            break
        done = done.unionByName(now.filter(~open_rows).select(*columns, "sequence_id", "offset"))
        now = again
        number += 1
    return done.unionByName(now.select(*columns, "sequence_id", "offset"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    from ._support import table

    return pack(pieces(table(spark, sf_dir, "documents")))
