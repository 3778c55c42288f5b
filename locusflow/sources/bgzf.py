"""BGZF: gzip members of at most 64 KiB with their size in the header, addressed by virtual offsets.

A virtual offset is the place of a member in the file, shifted by 16, plus a place in its plain bytes.
Files are opened through pyarrow's file systems, so any place they reach will do.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT, BATCH = 32 << 20, 4 << 20  # bytes of a partition (packed) and of a batch (plain)
MEMBER = re.compile(rb"\x1f\x8b\x08\x04.{6}\x06\x00BC\x02\x00(..)", re.S)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path or URI."""
    uri = re.sub(r"^file:/(?!/)", "file:///", path)
    if "://" not in uri and not uri.startswith("/"):
        from os.path import abspath

        uri = abspath(uri)
    return fs.FileSystem.from_uri(uri)


def open_file(path: str):
    """A seekable file for a path or URI."""
    try:
        system, name = place(path)
        return system.open_input_file(name)
    except FileNotFoundError:
        raise
    except OSError as e:
        raise OSError(f"cannot open {path}: {e}") from e


class BgzfReader:
    """Sequential bytes from a virtual offset on."""

    def __init__(self, file, offset: int = 0) -> None:
        self.file = file
        self.next, self.data, self.at = offset >> 16, b"", 0
        self.block = self.next
        if offset & 0xFFFF:
            self._load()
            self.at = offset & 0xFFFF

    def _load(self) -> bool:
        """The next member that has bytes; False at the end."""
        while True:
            self.file.seek(self.next)
            head = self.file.read(18)
            if len(head) < 18:
                self.block, self.data, self.at = self.next, b"", 0
                return False
            magic, extra = head[:4], struct.unpack_from("<H", head, 10)[0]
            if magic != b"\x1f\x8b\x08\x04":
                raise OSError("not a BGZF file")
            fields = head[12:] + self.file.read(max(0, extra - 6))
            at = size = 0
            while at + 4 <= extra:
                kind, length = fields[at : at + 2], struct.unpack_from("<H", fields, at + 2)[0]
                if kind == b"BC":
                    size = struct.unpack_from("<H", fields, at + 4)[0] + 1
                at += 4 + length
            if not size:
                raise OSError("a gzip member without a BGZF size")
            body = self.file.read(size - 12 - extra)
            self.block, self.next = self.next, self.next + size
            self.data, self.at = zlib.decompress(body[:-8], -15), 0
            if self.data:
                return True

    def blocks(self) -> Iterator[tuple[int, bytes, int]]:
        """Each member from here on: its place in the file, its plain bytes, and how many of them come before the
        reader's offset (in the first)."""
        if self.at or self.data:
            yield self.block, self.data, self.at
        while self._load():
            yield self.block, self.data, 0

    def tell(self) -> int:
        if self.at >= len(self.data):
            return self.next << 16
        return self.block << 16 | self.at

    def where(self) -> int:
        """The virtual offset of the next byte, in the member that has it; of the file's end, if there is none."""
        if self.at >= len(self.data) and not self._load():
            return self.next << 16
        return self.block << 16 | self.at

    def read(self, size: int) -> bytes:
        out = []
        while size > 0:
            if self.at >= len(self.data) and not self._load():
                break
            piece = self.data[self.at : self.at + size]
            self.at += len(piece)
            size -= len(piece)
            out.append(piece)
        return out[0] if len(out) == 1 else b"".join(out)

    def lines(self) -> Iterator[tuple[int, bytes]]:
        """Each line from here on, and the virtual offset of its first byte."""
        rest, start = b"", None
        for block, data, at in self.blocks():
            if start is None:
                start = block << 16 | at
            while (end := data.find(b"\n", at)) >= 0:
                yield start, rest + data[at:end]
                rest, at = b"", end + 1
                start = block << 16 | at
            rest += data[at:]
            if not rest:
                start = None  # the next line begins with the next member
        if rest:
            yield start, rest


def member_from(file, offset: int, size: int) -> int:
    """Where the first BGZF member with bytes at a place of the file or behind it begins (the size, if none does)."""
    step = 1 << 17  # two members at most
    while offset < size:
        file.seek(offset)
        data = file.read(step)
        for found in MEMBER.finditer(data):
            at = offset + found.start()
            length = int.from_bytes(found[1], "little") + 1
            file.seek(at + length - 4)
            tail = file.read(22)
            if (at + length == size or MEMBER.match(tail[4:])) and tail[:4] != bytes(4):
                return at  # what follows it is a member as well, and it has bytes
        offset += max(1, len(data) - 17)
    return size


def compress(data: bytes, size: int = 60_000) -> bytes:
    """BGZF bytes of plain bytes, with the empty member that ends a file."""
    out = []
    for k in [*range(0, len(data), size), None]:
        plain = b"" if k is None else data[k : k + size]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(plain) + deflate.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(plain), len(plain)))
    return b"".join(out)


class BgzfLines(DataSource):
    """Lines of a BGZF text file (column value), or those that begin in a run of virtual offsets."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(dict(self.options))


class LinePartition(InputPartition):
    def __init__(self, begin: int, end: int) -> None:
        self.begin, self.end = begin, end


class _LineReader(DataSourceReader):
    """Partitions of SPLIT bytes. Each seeks its first member, skips to the first line that begins there, and reads
    the line that begins at its end, as the next one skips that."""

    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.begin = int(options.get("begin", 0))
        self.end = int(options["end"]) if "end" in options else None

    def partitions(self) -> list[LinePartition]:
        with open_file(self.path) as file:
            size = file.size()
        end = size << 16 if self.end is None else self.end
        cuts = range((self.begin >> 16) + self.split, (end >> 16) + (1 if end & 0xFFFF else 0), self.split)
        edges = [self.begin, *(x << 16 for x in cuts), end]
        return [LinePartition(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, partition: LinePartition) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as file:
            size = file.size()
            first = partition.begin == self.begin
            begin = partition.begin if first else member_from(file, partition.begin >> 16, size) << 16
            end = partition.end
            last = end == (size << 16 if self.end is None else self.end)
            if not last:
                end = member_from(file, end >> 16, size) << 16
            if begin >= end:
                return
            skip, held, n = not first, [], 0
            for start, line in BgzfReader(file, begin).lines():
                if skip:
                    skip = False
                    continue
                if start >= end and (last or start > end):
                    break
                held.append(line)
                n += len(line)
                if n > BATCH:
                    yield _lines(held)
                    held, n = [], 0
            if held:
                yield _lines(held)


def _lines(held: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x.decode() for x in held], pa.string())], names=["value"])


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(BgzfLines)
