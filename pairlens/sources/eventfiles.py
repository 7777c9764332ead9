"""Scalar event files as a Spark data source: records framed by length and masked CRC-32C, events as protocol buffers.

    spark.dataSource.register(EventFiles)
    spark.read.format("event_files").load(folder)
    df.write.format("event_files").mode("append").save(folder)

Reading: a partition for each file; columns file, record (its number in the file),
wall_time, step, tag, value, broken. A record whose length or checksum doesn't hold
ends its file with one row that says what is broken and has no other values: what
follows it can't be framed. Events without scalars give no rows. Writing: tag, step,
value and wall_time, a file for each task, visible only when all tasks are done.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PREFIX = "events.out.tfevents."
SCHEMA = "file string, record long, wall_time double, step long, tag string, value float, broken string"
#: Fixed values of the format: the polynomial of CRC-32C, reflected, the mask's constant, and the version's text.
CASTAGNOLI, MASK, VERSION = 0x82F63B78, 0xA282EAD8, b"brain.Event:2"


def _table() -> tuple[int, ...]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (CASTAGNOLI if x & 1 else 0)
        out.append(x)
    return tuple(out)


_CRC = _table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = crc >> 8 ^ _CRC[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return length + struct.pack("<I", masked(length)) + data + struct.pack("<I", masked(data))


def records(raw: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """The records of a file; at a broken one, None and what is wrong, and no more."""
    at = 0
    while at < len(raw):
        if len(raw) - at < 12:
            yield None, "cut off in a length"
            return
        size, check = struct.unpack_from("<QI", raw, at)
        if masked(raw[at : at + 8]) != check:
            yield None, "checksum of a length"
            return
        data = raw[at + 12 : at + 12 + size]
        if len(data) < size or len(raw) < at + 16 + size:
            yield None, "cut off in a record"
            return
        if masked(data) != struct.unpack_from("<I", raw, at + 12 + size)[0]:
            yield None, "checksum of a record"
            return
        yield data, None
        at += 16 + size


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _delimited(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message's fields; varints as integers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if size is None or at + size > len(data):
            raise ValueError("not a message")
        yield key >> 3, data[at : at + size]
        at += size


def event(wall_time: float, step: int, tag: str, value: float) -> bytes:
    scalar = _delimited(1, tag.encode()) + b"\x15" + struct.pack("<f", value)
    return b"\x09" + struct.pack("<d", wall_time) + b"\x10" + _varint(step) + _delimited(5, _delimited(1, scalar))


def scalars(data: bytes) -> Iterator[tuple[float, int, str, float]]:
    """wall_time, step, tag, value of each scalar of an event; step is signed."""
    wall_time, step, found = 0.0, 0, []
    for number, value in fields(data):
        if number == 1:
            wall_time = struct.unpack("<d", value)[0]
        elif number == 2:
            step = value - (1 << 64) if value >> 63 else value
        elif number == 5:
            for inner, item in fields(value):
                held = dict(fields(item)) if inner == 1 else {}
                if 2 in held:
                    found.append((held.get(1, b"").decode(), struct.unpack("<f", held[2])[0]))
    for tag, value in found:
        yield wall_time, step, tag, value


def place(path: str):
    """The file system of a path or address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = place(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root))
        return [File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name.startswith(PREFIX)]

    def read(self, partition: File) -> Iterator[tuple]:
        files, _ = place(self.path)
        with files.open_input_stream(partition.path) as stream:
            raw = stream.read()
        name = partition.path.rsplit("/", 1)[-1]
        for i, (data, wrong) in enumerate(records(raw)):
            try:
                rows = [] if data is None else list(scalars(data))
            except (ValueError, IndexError, struct.error, UnicodeDecodeError, AttributeError, TypeError):
                wrong = "not an event"
            if wrong:
                yield name, i, None, None, None, None, wrong
                return
            for row in rows:
                yield name, i, *row, None


@dataclass
class Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        missing = {"tag", "step", "value", "wall_time"} - set(names)
        if missing:
            raise ValueError(f"event files need the columns {', '.join(sorted(missing))}")
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator) -> Written:
        files, root = place(self.path)
        files.create_dir(root)
        target = f"{root.rstrip('/')}/_writing-{self.run}-{uuid.uuid4().hex}"
        with files.open_output_stream(target) as out:
            out.write(framed(b"\x09" + struct.pack("<d", 0.0) + _delimited(3, VERSION)))
            for row in iterator:
                out.write(framed(event(float(row["wall_time"]), int(row["step"]), row["tag"], float(row["value"]))))
        return Written(target)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = place(self.path)
        if self.overwrite:
            for old in _Reader(self.path).partitions():
                files.delete_file(old.path)
        for i, message in enumerate(m for m in messages if m):
            folder = message.path.rsplit("/", 1)[0]
            files.move(message.path, f"{folder}/{PREFIX}{self.run}.{i:05d}")

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = place(self.path)
        for message in filter(None, messages):
            files.delete_file(message.path)


class EventFiles(DataSource):
    """Scalar event files of a folder, or one file."""

    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names, overwrite)
