"""Data sources: containers of sections, rank files, id files, framed records and archive streams.

``register(spark)`` makes them known; ``spark.read.format(name).load(path)`` reads a file or a folder,
``df.write.format(name).mode(...).save(path)`` writes under the commit of ``files.StagedWriter``.
Files are planned by their sizes: small ones are read together, containers that are large by ranges
of their sections.
"""

from __future__ import annotations

import base64
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..kernels.vocab import PackError
from . import packs
from .files import StagedWriter, listed, store_of

#: Bytes that a task reads, and files that it opens, at most, where files can be dealt out.
TASK_BYTES, TASK_FILES = 32 << 20, 4096


@dataclass
class Ranges(InputPartition):
    """Files of a task: path, first section and the one behind the last (-1: all of them)."""

    files: list[tuple[str, int, int]]

    def __init__(self, files):
        super().__init__(0)
        self.files = files


def _dealt(pieces: list[tuple[tuple[str, int, int], int]], tasks: int) -> list[Ranges]:
    """Pieces with their sizes, in order, dealt to tasks of about one size; at least ``tasks`` where there are as many pieces."""
    total = sum(n for _, n in pieces)
    most = max(1, min(TASK_BYTES, -(-total // max(1, tasks))))
    few = max(1, min(TASK_FILES, -(-len(pieces) // max(1, tasks))))
    out, held, size = [], [], 0
    for piece, n in pieces:
        if held and (size + n > most or len(held) >= few):
            out.append(Ranges(held))
            held, size = [], 0
        held.append(piece)
        size += n
    return [*out, Ranges(held)] if held else out


class _Source(DataSource):
    """A format of files: options path, pathGlobFilter, tasks (at least so many, if there is enough to read)."""

    def tasks(self) -> int:
        return int(self.options.get("tasks", os.cpu_count() or 8))

    def files(self) -> list[tuple[str, int]]:
        return listed(self.options["path"], self.options.get("pathGlobFilter"))


class _FileReader(DataSourceReader):
    """Reads whole files, several in a task; ``rows(path, data)`` of the format gives a file's rows."""

    def __init__(self, source: _Source, rows):
        self.path, self.rows, self.tasks = source.options["path"], rows, source.tasks()
        self.glob = source.options.get("pathGlobFilter")

    def partitions(self) -> list[Ranges]:
        return _dealt([((p, 0, -1), n) for p, n in listed(self.path, self.glob)], self.tasks)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = store_of(self.path)
        for path, _, _ in partition.files:
            with store.open_input_stream(path) as f:
                yield from self.rows(path, f.read())


# --- containers -----------------------------------------------------------------------------------


class PackSource(_Source):
    """``glyphline_pack``: one row for each section of the containers of a file or a folder.

    A filter on ``kind`` (= or in) is pushed if the format was made known by ``register``: then only
    directories and the bodies of those kinds are read. Option verify: the whole file is read and its hash compared (default false: the header and the
    layout of the directory alone). Option status: a bad container is one row with section -1 and its
    status, instead of an error.
    """

    @classmethod
    def name(cls) -> str:
        return "glyphline_pack"

    def schema(self) -> str:
        return "path string, status int, section int, kind int, magic string, length bigint, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _PackReader(self)


def _directory(f, size: int) -> list[tuple[int, int, int]]:
    """(kind, offset, length) of each section, from the container's first bytes."""
    head = f.read(packs.HEADER)
    if len(head) < packs.HEADER or head[:8] != packs.MAGIC:
        raise PackError("not a container")
    major, _, header, flags = struct.unpack_from("<4H", head, 8)
    total, count, entry, algorithm, directory, _, _ = struct.unpack_from("<QIHHQII", head, 16)
    if (major, header, flags, entry, algorithm, directory) != (1, packs.HEADER, 0, packs.ENTRY, 1, packs.HEADER) or any(head[80:]):
        raise PackError("bad header")
    if total != size or not 0 < count <= 1024 or packs.HEADER + packs.ENTRY * count > total:
        raise PackError("bad length")
    rows, at, out = f.read(packs.ENTRY * count), packs.HEADER + packs.ENTRY * count, []
    for k in range(count):
        kind, zero, offset, length, _, _, align, reserved = struct.unpack_from("<IIQQIHBB", rows, packs.ENTRY * k)
        if zero or reserved or align > 12 or offset != -(-at // 8) * 8 or offset + length > total:
            raise PackError(f"section {k} is out of place")
        at = offset + length
        out.append((kind, offset, length))
    if at != total:
        raise PackError("bad sections")
    return out


class _PackReader(DataSourceReader):
    def __init__(self, source: PackSource):
        self.path, self.glob, self.tasks = source.options["path"], source.options.get("pathGlobFilter"), source.tasks()
        self.verify, self.status = (source.options.get(o, "false").lower() == "true" for o in ("verify", "status"))
        self.kinds: frozenset[int] | None = None

    def partitions(self) -> list[Ranges]:
        """Small containers together, those beyond a task's bytes by ranges of wanted sections."""
        store, _ = store_of(self.path)
        pieces = []
        for path, size in listed(self.path, self.glob):
            if size <= TASK_BYTES or self.verify:
                pieces.append(((path, 0, -1), size))
                continue
            try:
                with store.open_input_file(path) as f:
                    sections = _directory(f, size)
            except PackError:  # the task says what is wrong
                pieces.append(((path, 0, -1), 0))
                continue
            for k, (kind, _, length) in enumerate(sections):
                if self.kinds is None or kind in self.kinds:
                    pieces.append(((path, k, k + 1), length))
        return _dealt(pieces, self.tasks)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = store_of(self.path)
        for path, first, last in partition.files:
            try:
                with store.open_input_file(path) as f:
                    if self.verify:
                        packs.scan(f.read())
                        f.seek(0)
                    sections = _directory(f, f.size())
                    for k, (kind, offset, length) in enumerate(sections):
                        if first <= k and (last < 0 or k < last) and (self.kinds is None or kind in self.kinds):
                            f.seek(offset)
                            body = f.read(length)
                            yield path, 0, k, kind, body[:4].decode("ascii", "replace"), length, body
            except PackError as e:
                if not self.status:
                    raise
                if self.kinds is None:
                    yield path, e.status, -1, None, None, None, None


class _PushedPackReader(_PackReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = None
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                wanted = frozenset([f.value])
            elif isinstance(f, In) and f.attribute == ("kind",):
                wanted = frozenset(f.value)
            if wanted is None:
                yield f
            else:
                self.kinds = wanted if self.kinds is None else self.kinds & wanted


class PushedPackSource(PackSource):
    """``PackSource`` for sessions that push filters to sources in Python, as ``register`` sets them up."""

    def reader(self, schema) -> DataSourceReader:
        return _PushedPackReader(self)


# --- rank files, id files, records ----------------------------------------------------------------


def _rank_rows(path: str, data: bytes) -> Iterator[tuple]:
    for line in data.splitlines():
        if line.strip():
            try:
                surface, rank = line.split()
                yield base64.b64decode(surface, validate=True), int(rank)
            except ValueError as e:
                raise PackError(f"bad line {line!r} in {path}") from e


class RankSource(_Source):
    """``glyphline_ranks``: (surface binary, rank bigint), a line of each; files are cut by tasks, in their order of ranks if the rows are."""

    @classmethod
    def name(cls) -> str:
        return "glyphline_ranks"

    def schema(self) -> str:
        return "surface binary, rank bigint"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self, _rank_rows)

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return _RankWriter(self.options["path"], overwrite)


class _RankWriter(StagedWriter):
    def parts(self, batches, task):
        lines = []
        for batch in batches:
            for surface, rank in zip(batch.column("surface").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                if not surface or rank is None or rank < 0:
                    raise ValueError("a rank or surface is missing")
                lines.append(f"{base64.b64encode(surface).decode()} {rank}\n")
        if lines:
            yield f"part-{task:05d}.tiktoken", "".join(lines).encode(), len(lines)


def _id_rows(path: str, data: bytes) -> Iterator[tuple]:
    yield path, packs.unpack_u32(data)


class IdSource(_Source):
    """``glyphline_ids``: (path string, ids array<bigint>), a file of little-endian 32-bit integers for each row."""

    @classmethod
    def name(cls) -> str:
        return "glyphline_ids"

    def schema(self) -> str:
        return "path string, ids array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self, _id_rows)

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return _IdWriter(self.options["path"], overwrite)


class _IdWriter(StagedWriter):
    def parts(self, batches, task):
        import numpy as np

        for batch in batches:
            for name, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                values = np.array(ids or [], np.int64)
                if not name or (values < 0).any() or (values >= 1 << 32).any():
                    raise ValueError("a name is missing or an id is out of range")
                yield name, values.astype("<u4").tobytes(), 1


def _whole_rows(path: str, data: bytes) -> Iterator[tuple]:
    yield path, data


class FileSource(_Source):
    """``glyphline_files``: (path string, content binary), a file for each row, as containers are."""

    @classmethod
    def name(cls) -> str:
        return "glyphline_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self, _whole_rows)

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return _FileWriter(self.options["path"], overwrite)


class _FileWriter(StagedWriter):
    def parts(self, batches, task):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or content is None:
                    raise ValueError("a name or content is missing")
                yield name, content, 1


_FRAME = struct.Struct("<II")


def _record_rows(path: str, data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        if at + _FRAME.size > len(data):
            raise PackError(f"{path} ends within a frame")
        size, crc = _FRAME.unpack_from(data, at)
        record = data[at + _FRAME.size : at + _FRAME.size + size]
        if len(record) != size or zlib.crc32(record) != crc:
            raise PackError(f"bad record in {path}", 12)
        yield (record,)
        at += _FRAME.size + size


class RecordSource(_Source):
    """``glyphline_records``: (record binary), framed by size and CRC-32; a task writes a file of its records."""

    @classmethod
    def name(cls) -> str:
        return "glyphline_records"

    def schema(self) -> str:
        return "record binary"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self, _record_rows)

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return _RecordWriter(self.options["path"], overwrite)


class _RecordWriter(StagedWriter):
    #: Bytes of a file, but for its last record.
    MOST = 64 << 20

    def parts(self, batches, task):
        held, size, number = [], 0, 0
        for batch in batches:
            for record in batch.column("record").to_pylist():
                if record is None:
                    raise ValueError("a record is missing")
                held += (_FRAME.pack(len(record), zlib.crc32(record)), record)
                size += len(record)
                if size >= self.MOST:
                    yield f"part-{task:05d}-{number:04d}.rec", b"".join(held), len(held) // 2
                    held, size, number = [], 0, number + 1
        if held:
            yield f"part-{task:05d}-{number:04d}.rec", b"".join(held), len(held) // 2


# --- archive streams ------------------------------------------------------------------------------

# Layout of an archive stream, header and payload of version 2.
ARCHIVE_MAGIC, ARCHIVE_VERSION, PAYLOAD_VERSION = 0x31434D5A, 1, 2
ARCHIVE_HEAD = struct.Struct("<4I2QI4x")
STORED, DEFLATED = 0, 1
# End of fixed values.


def write_archive(entries: Iterable[tuple[str, bool, int, bytes]], root: str = "", level: int = 6) -> bytes:
    """A stream of entries (path, folder, time, content) behind a header with sizes and a CRC-32 of what is packed."""
    rows, count = [], 0
    for path, folder, time, content in entries:
        name = path.encode()
        rows += (struct.pack("<II", int(folder), len(name)), name, struct.pack("<QQ", len(content), time), content)
        count += 1
    name = root.encode()
    payload = struct.pack("<III", ARCHIVE_MAGIC, PAYLOAD_VERSION, len(name)) + name + struct.pack("<I", count) + b"".join(rows)
    packed = zlib.compress(payload, level) if level else payload
    return ARCHIVE_HEAD.pack(ARCHIVE_MAGIC, ARCHIVE_VERSION, DEFLATED if level else STORED, level, len(payload), len(packed), zlib.crc32(packed)) + packed


def read_archive(data: bytes) -> tuple[str, list[tuple[str, bool, int, bytes]]]:
    """(root, entries) of a stream; PackError with status 12 for what is damaged, 10 for another way of packing."""
    if len(data) < ARCHIVE_HEAD.size:
        raise PackError("not an archive")
    magic, version, algorithm, _, size, packed_size, crc = ARCHIVE_HEAD.unpack_from(data)
    packed = data[ARCHIVE_HEAD.size :]
    if (magic, version) != (ARCHIVE_MAGIC, ARCHIVE_VERSION):
        raise PackError("not an archive")
    if algorithm not in (STORED, DEFLATED):
        raise PackError("the archive is packed in another way", 10)
    if packed_size != len(packed) or zlib.crc32(packed) != crc:
        raise PackError("the archive is damaged", 12)
    unpack = zlib.decompressobj()
    payload = packed if algorithm == STORED else unpack.decompress(packed, size + 1)
    if len(payload) != size:
        raise PackError("the archive has another size", 12)
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(payload):
            raise PackError("the archive ends within an entry", 12)
        at += n
        return payload[at - n : at]

    magic, version, n = struct.unpack("<III", take(12))
    if (magic, version) != (ARCHIVE_MAGIC, PAYLOAD_VERSION):
        raise PackError("bad payload", 12)
    try:
        root, out = take(n).decode(), []
        for _ in range(struct.unpack("<I", take(4))[0]):
            folder, n = struct.unpack("<II", take(8))
            path = take(n).decode()
            length, time = struct.unpack("<QQ", take(16))
            out.append((path, bool(folder), time, take(length)))
    except UnicodeDecodeError as e:
        raise PackError("bad path", 12) from e
    if at != len(payload):
        raise PackError("bytes behind the last entry", 12)
    return root, out


def _archive_rows(path: str, data: bytes) -> Iterator[tuple]:
    root, entries = read_archive(data)
    for k, (name, folder, time, content) in enumerate(entries):
        yield path, root, k, name, folder, time, len(content), zlib.crc32(content), content


class ArchiveSource(_Source):
    """``glyphline_archive``: the entries of archive streams; written rows of one task are one stream.

    Rows to write have path, folder, time and content; option root is the stream's root name, level
    that of packing (0: stored).
    """

    @classmethod
    def name(cls) -> str:
        return "glyphline_archive"

    def schema(self) -> str:
        return "archive string, root string, entry int, path string, folder boolean, time bigint, size bigint, crc32 bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self, _archive_rows)

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return _ArchiveWriter(self.options["path"], overwrite, self.options.get("root", ""), int(self.options.get("level", "6")))


class _ArchiveWriter(StagedWriter):
    #: Bytes of content of a stream, but for its last entry.
    MOST = 256 << 20

    def __init__(self, path: str, overwrite: bool, root: str, level: int):
        super().__init__(path, overwrite)
        self.root, self.level = root, level

    def parts(self, batches, task):
        held, size, number = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "folder", "time", "content")), strict=True):
                path, folder, time, content = row
                if not path:
                    raise ValueError("a path is missing")
                held.append((path, bool(folder), time or 0, content or b""))
                size += len(content or b"")
                if size >= self.MOST:
                    yield self._part(task, number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield self._part(task, number, held)

    def _part(self, task: int, number: int, held: list) -> tuple[str, bytes, int]:
        return f"part-{task:05d}-{number:04d}.mzc", write_archive(held, self.root, self.level), len(held)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let filters be pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PushedPackSource, RankSource, IdSource, FileSource, RecordSource, ArchiveSource):
        spark.dataSource.register(source)
