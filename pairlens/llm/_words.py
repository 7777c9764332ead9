"""Vectorised word hashing over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: The low 0 to 8 bytes of a lane.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LANES = 8
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    marks = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[marks[0] : marks[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, marks - (marks[0] if len(marks) else 0)


def chunks(raw: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Cut rows into pieces of about ``size`` bytes: (first row, last row + 1, first byte, last byte + 1).

    A long row is cut where white space follows, so that no word is cut; its pieces have the same row number.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        start = int(offsets[row])
        end_row = int(np.searchsorted(offsets, start + size, side="right")) - 1
        if end_row > row:
            yield row, end_row, start, int(offsets[end_row])
            row = end_row
            continue
        stop = int(offsets[row + 1])
        while stop - start > size:
            at, step = start + size, 4096
            while at < stop:
                found = np.flatnonzero(_SPACE[raw[at : min(stop, at + step)]])
                if len(found):
                    at += int(found[0])
                    break
                at = min(stop, at + step)
            yield row, row + 1, start, at
            start = at
        if start < stop or stop == offsets[row]:
            yield row, row + 1, start, stop
        row += 1


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends, row of each word) of one chunk; ``offsets`` are the rows' bounds in ``raw``."""
    codes = _LOWER[raw] if lower else raw
    gap = separators[raw]
    before = np.empty_like(gap)
    before[0:1] = True
    before[1:] = gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before[inner] = True
    starts = np.flatnonzero(~gap & before)
    after = np.empty_like(gap)
    after[-1:] = True
    after[:-1] = gap[1:]
    after[inner - 1] = True
    ends = np.flatnonzero(~gap & after) + 1
    return codes, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, wherever in the chunk they are.

    Up to LANES lanes of eight bytes are mixed in one after the other, each by a
    bijection, beginning with the length; longer spans are hashed by XXH3.
    """
    import xxhash

    held = np.zeros(len(codes) + 8, np.uint8)
    held[: len(codes)] = codes
    lanes = np.ndarray(len(codes) + 1, "<u8", held, strides=(1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * _SEED + _SEED)
        live = np.flatnonzero((size > 0) & (size <= 8 * LANES))
        for at in range(0, 8 * LANES, 8):
            out[live] = mix((out[live] ^ (lanes[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)])) + _SEED)
            live = live[size[live] > at + 8]
            if not len(live):
                break
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(held[starts[i] : ends[i]].data)
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each word, hash of each word) of lower-cased white-space words, chunk by chunk in row order."""
    for first, last, start, end in chunks(raw, offsets):
        marks = np.clip(offsets[first : last + 1], start, end) - start
        codes, starts, ends, rows = words(raw[start:end], marks)
        yield first, rows + first, hashes(codes, starts, ends)
