"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text is cut into chunks at safe boundaries before it is encoded, so that
memory is bounded by the chunk and not by the text. A boundary is safe where a
character that isn't white space is followed by a space or a newline: in the
split pattern white space only begins a match, no alternative looks back, and
the one that looks ahead does so from white space, so that no match and no
lookahead crosses it. A chunk without such a place is extended to the next one. The
library's pattern search overflows on runs of more than about a million white-space
characters; runs of RUN and more are encoded apart, as the one match that all but
their last character are (or all, where the text ends).

Null texts encode as empty ones: no ids and no bytes. Rows with the same text
get the same ids. Empty tables give empty results. Only the id and text columns
are read, so extra columns can have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._support import sliced, worker_cache

CHUNK_CHARS = 1 << 16
RUN = 1 << 17
_SAFE = re.compile(r"\S(?=[ \n])")
#: What \s matches in the library's patterns, the Unicode property White_Space.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoding(path: str, pattern: str | None = None):
    """A tiktoken Encoding without special tokens, kept for the life of the process."""
    import base64

    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    cache = worker_cache()
    key = ("encoding", path, pattern)
    if key not in cache:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        cache[key] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return cache[key]


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Cut a text into pieces of about ``size`` characters that encode separately to the same ids."""
    at, end = 0, len(text)
    while end - at > size:
        found = _SAFE.search(text, at + size - 1)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def _as_one_match(encoding, text: str) -> list[int]:
    """The ids of a text that is one match of the pattern."""
    import tiktoken

    cache = worker_cache()
    key = ("whole", encoding.name)
    if key not in cache:
        ranks = {encoding.decode_single_token_bytes(i): i for i in range(encoding.n_vocab)}
        cache[key] = tiktoken.Encoding(f"{encoding.name}-whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return cache[key].encode_ordinary(text)


def encode_chunk(encoding, chunk: str, run: int = RUN) -> list[int]:
    """The ids of a chunk; ``run``, 2 or more, is the length from which runs of white space are encoded apart."""
    if len(chunk) < run:
        return encoding.encode_ordinary(chunk)
    ids: list[int] = []
    at = 0
    for found in re.finditer(f"[{_WHITE}]{{{run},}}", chunk):
        # the last character of a run that text follows belongs to what follows
        end = found.end() if found.end() == len(chunk) else found.end() - 1
        ids += encoding.encode_ordinary(chunk[at : found.start()])
        ids += _as_one_match(encoding, chunk[found.start() : end])
        at = end
    return ids + encoding.encode_ordinary(chunk[at:])


def encode_text(encoding, text: str, size: int = CHUNK_CHARS) -> np.ndarray:
    """The ids of a whole text as little-endian unsigned 32-bit integers."""
    parts = [np.asarray(encode_chunk(encoding, chunk), dtype="<u4") for chunk in safe_chunks(text, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode_ids(encoding, ids: bytes) -> bytes:
    """The raw bytes of ids; they may be cut anywhere, so they need not be UTF-8."""
    return encoding.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def _columns(df: DataFrame, id_col: str, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *more])


def encode(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", ranks: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and ``token_ids`` (binary, 4 bytes an id); with ``decoded`` also ``decoded``, the bytes that the ids stand for."""
    path = ranks or rank_file()
    fields = [T.StructField("token_ids", T.BinaryType(), False)] + [T.StructField("decoded", T.BinaryType(), False)] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        for batch in sliced(batches):
            ids = [encode_text(encoding, text or "").tobytes() for text in batch.column(1).to_pylist()]
            out = [batch.column(0), pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array([decode_ids(encoding, x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "token_ids", "decoded"][: len(out)])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _columns(df, id_col, *fields))


def decode(df: DataFrame, ids_col: str = "token_ids", id_col: str = "doc_id", ranks: str | None = None) -> DataFrame:
    """doc_id and ``decoded``: the bytes of a column of packed ids; null ids decode to no bytes."""
    path = ranks or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        for batch in sliced(batches):
            raw = [decode_ids(encoding, ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, _columns(df, id_col, T.StructField("decoded", T.BinaryType(), False)))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of both."""
    from ._support import table

    return encode(table(spark, sf_dir, "documents"), decoded=True).select(
        "doc_id",
        F.expr("length(token_ids) div 4").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
