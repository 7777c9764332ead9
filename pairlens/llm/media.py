"""Media columns: interleaved document sequences with payloads resolved by digest.

HTML is parsed into an ordered array of structs, text or media reference, each
with its position and caption. Media are stored as lossless 8-bit grey images
(binary PGM, 64 samples a row) and are found by the SHA-256 digest of their
samples, one row of features per digest, so that a reference resolves by an
equi-join on the digest and positions and captions stay with their reference.

References are those of images, videos, their posters, audio, sources and embedded
files, of any address: ``src``, or what pages that load late put into ``data-src`` and
its like or into ``srcset``, of which the largest candidate counts. The sources of one
picture are forms of one image and one item, the image's own address first. Objects,
frames and drawings aren't read.

A payload is the UTF-8 text padded with zero bytes to a positive multiple of 64;
null is stored as empty text. Equal payloads have one digest and equal stored
forms. References of any address are items; those without a stored payload keep
their row with null media columns. Null html has no items. Rows may repeat and ids
may be null: rows are never joined on ids. Texts and pages of any length are read
whole; empty tables give no rows. Only the named columns are read, so that others
may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._html import BLOCK, attributes, scan
from ._support import fresh, sliced, staged

WIDTH = 64
SCHEME = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string,src:string>"


def store(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a positive multiple of 64: a binary PGM image."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def load(stored: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a stored image."""
    magic, size, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a whole 8-bit PGM image")
    return width, height, samples


def feature(width: int, height: int, samples: bytes) -> str:
    """Shape, mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    levels = np.arange(256)
    mean = int((counts * levels).sum()) / len(samples)
    deviation = math.sqrt(max(0.0, int((counts * levels * levels).sum()) / len(samples) - mean * mean))
    return f"{width}x{height} mean={mean:.4f} dev={deviation:.4f} entropy={abs(float((share * np.log2(share)).sum())):.4f}"


def padded(text: F.Column) -> F.Column:
    """Bytes of a text, padded with zero bytes to a positive multiple of 64."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = F.greatest(F.lit(WIDTH), F.ceil(F.octet_length(raw) / WIDTH) * WIDTH).cast("int")
    return F.rpad(raw, size, F.lit(b"\x00"))


def store_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``media`` (the stored form) and ``n_bytes`` (the unpadded length) of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = [x or b"" for x in batch.column(0).to_pylist()]
            media = [store(x + bytes(-len(x) % WIDTH if x else WIDTH)) for x in raw]
            yield pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), pa.array(map(len, raw), pa.int64())], names=["media", "n_bytes"])

    return df.select(F.col(text_col).cast("string").cast("binary").alias("raw")).mapInArrow(run, "media binary, n_bytes long")


def read_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Read stored media back: digest and checksums of the samples, digest of the stored form, a feature string."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for stored in batch.column(len(names)).to_pylist():
                width, height, samples = load(stored)
                out.append((hashlib.sha256(samples).hexdigest(), len(samples), zlib.crc32(samples[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(width, height, samples)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[f.name for f in schema])

    schema = T.StructType([*(df.schema[n] for n in names), *T._parse_datatype_string("digest string, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string")])
    return df.select(*names, F.col(media_col)).mapInArrow(run, schema)


def media_table(media: DataFrame) -> DataFrame:
    """One row per digest of what read_media gives."""
    rest = [c for c in media.columns if c != "digest"]
    return media.groupBy("digest").agg(F.min(F.struct(*rest)).alias("m")).select("digest", *(F.col(f"m.{c}").alias(c) for c in rest))


#: Where pages that load late keep an address.
LATE = ("data-src", "data-original", "data-lazy-src", "data-url")
_CANDIDATE = re.compile(r"[\s,]*(\S+)([^,]*)")
_SIZE = re.compile(r"\s*([0-9]+(?:\.[0-9]+)?)[wx]\s*")


def largest(srcset: str) -> str:
    """The address of the largest candidate of a srcset, of equal ones the first."""
    best, most, at = "", -1.0, 0
    while found := _CANDIDATE.match(srcset, at):
        at = found.end()
        address, size = found[1], 1.0
        if address.endswith(","):  # no size follows
            address, at = address.rstrip(","), found.end(1)
        elif told := _SIZE.fullmatch(found[2]):
            size = float(told[1])
        if address and size > most:
            best, most = address, size
    return best


def address(has: dict[str, str]) -> str:
    """The address of a reference's attributes; one that holds the data itself, a placeholder, only where there is no other."""
    own = has.get("src", "").strip()
    if own and not own.lower().startswith("data:"):
        return own
    late = next((has[x].strip() for x in LATE if has.get(x, "").strip()), "")
    return late or largest(has.get("srcset", "")) or largest(has.get("data-srcset", "")) or own


def interleaved(html: str | None) -> list[tuple[int, str, str | None, str | None, str | None, str | None]]:
    """(position, kind, text, digest, caption, src) of the text blocks and media references of a document, in order.

    A reference's digest is the one that its address names (``sha256:…``), null for any
    other address. A caption is the figcaption of the figure around a reference,
    else its alt text.
    """
    items: list[list] = []
    parts: list[str] = []
    figure: list[int] | None = None
    captioned = False

    def flush() -> None:
        nonlocal captioned
        text = " ".join("".join(parts).split())
        parts.clear()
        if not text:
            return
        if captioned and figure is not None:
            if figure:
                for i in figure:
                    items[i][4] = text
            else:
                figure_captions.append(text)
        else:
            items.append([len(items), "text", text, None, None, None])

    figure_captions: list[str] = []
    picture: str | None = None  # the first source's address of the picture around

    def refer(src: str, alt: str | None) -> None:
        flush()
        caption = figure_captions[-1] if figure is not None and figure_captions else alt or None
        digest = src[len(SCHEME) :].lower() if src.lower().startswith(SCHEME) else None
        items.append([len(items), "media", None, digest, caption, src])
        if figure is not None:
            figure.append(len(items) - 1)

    for kind, name, rest in scan(html or ""):
        if kind == "text":
            parts.append(unescape(rest))
        elif name in ("img", "video", "audio", "source", "embed"):
            has = attributes(rest) if kind == "open" else {}
            if name == "video" and has.get("poster", "").strip():
                refer(has["poster"].strip(), None)
            src = address(has)
            if name == "source" and picture is not None:
                picture = picture or src
                continue
            if name == "img":
                src, picture = src or picture or "", None if picture is None else ""
            if src:
                refer(src, has.get("alt"))
        elif name == "picture":
            if kind == "close" and picture:
                refer(picture, None)
            picture = "" if kind == "open" else None
        elif name == "br":
            parts.append("\n")
        elif name in BLOCK:
            flush()
            if name == "figure":
                figure, captioned = ([] if kind == "open" else None), False
                figure_captions.clear()
            elif name == "figcaption":
                captioned = kind == "open"
    flush()
    return [tuple(x) for x in items]


def parse(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep`` and ``items``: the interleaved sequence of each row's html; null html has no items."""
    names = list(keep)
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("src", pa.string())])
    fields = [f.name for f in item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            items = [[dict(zip(fields, x, strict=True)) for x in interleaved(html)] for html in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(items, pa.list_(item))], names=[*names, "items"])

    schema = T.StructType([*(df.schema[n] for n in names), T.StructField("items", T._parse_datatype_string(f"array<{ITEM}>"))])
    return df.select(*names, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)


def resolve(parsed: DataFrame, media: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per item with the media columns of its digest; ``media`` has unique digests. Text items have nulls there."""
    long = parsed.select(*keep, F.explode("items").alias("item")).select(*keep, "item.*")
    # items without a digest match nothing; they are dealt by their contents, not all to one task
    key = fresh(long.join(media.limit(0), "digest", "left"), "key")
    long = long.withColumn(key, F.coalesce("digest", F.xxhash64("text", "src").cast("string")))
    return long.join(media.withColumnRenamed("digest", key), key, "left").drop(key)


def document_html(text: F.Column, caption: F.Column) -> F.Column:
    """A document of a whole text and a figure that refers to the text's payload."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body, note = (escaped(F.coalesce(c.cast("string"), F.lit(""))) for c in (text, caption))
    return F.concat(F.lit("<article><p>"), body, F.lit(f'</p><figure><img src="{SCHEME}'), F.sha2(padded(text), 256), F.lit('"><figcaption>'), note, F.lit("</figcaption></figure></article>"))


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text as the payload of its figure: stored, read back, and resolved by digest.

    The stored form is written and read again before features are computed. The
    join on digests carries what was read from a payload; payloads aren't shuffled.
    """
    from ._support import table

    docs = table(spark, sf_dir, "documents")
    stored = staged(store_texts(docs).select("media"), "stored")
    media = staged(media_table(read_media(stored)), "media")
    # payloads that are equal once padded may come from texts of different lengths: n_bytes stays with the document
    n_bytes = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    parsed = parse(docs.select("doc_id", n_bytes.alias("n_bytes"), document_html(F.col("text"), F.col("source")).alias("html")), keep=("doc_id", "n_bytes"))
    parsed = parsed.withColumn("n_items", F.size("items"))
    found = resolve(parsed, media, keep=("doc_id", "n_bytes", "n_items")).filter("kind = 'media'")
    return found.select("doc_id", "n_bytes", "payload_bytes", F.col("digest").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items")
