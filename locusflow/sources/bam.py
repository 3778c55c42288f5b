"""BAM files as a Python data source.

``spark.read.format("bam").option("contig", ..).option("start", ..).option("stop", ..).load(path)``

The region is an option, not a pushed filter: Spark 4.1.2 keeps what a Python source's ``pushFilters`` has chosen with the
table, so a second scan of the same DataFrame, with other filters or none, would lose rows.

With an index (.bai or .csi) beside the file, partitions are runs of virtual offsets at which records are
known to begin, of about ``split`` packed bytes, and a region reads only those that can hold its records. Without
one, the file is cut at any place and each task finds its first record (``boundaries``). A task decodes a chunk of records at a time
into Arrow columns. ``unplaced`` = true gives the reads without a contig only, from behind the index's last chunk.
``columns`` (comma-separated) leaves the others undecoded (null). Rows carry ``file_offset``,
the virtual offset of their record, which restores the order of the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.alignments import ALIGNMENTS, CIGAR_OPS, ON_REFERENCE
from .bgzf import BgzfReader, open_file
from .boundaries import BamShape, first_record, ranges
from .tags import Tags

_LETTERS = "=ACMGRSVTWYHKDBN"
_PAIRS = np.frombuffer("".join(a + b for a in _LETTERS for b in _LETTERS).encode(), np.uint8).reshape(256, 2)
_OPS = np.frombuffer(CIGAR_OPS.encode().ljust(16, b"?"), np.uint8)
_ON_REFERENCE = np.array([c in ON_REFERENCE for c in CIGAR_OPS.ljust(16, "?")])
#: The fixed part of a record, behind its size.
_FIXED = np.dtype(
    [
        ("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"),
        ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("length", "<i4"),
    ]
)
LOST = "records cannot be told apart where the file is cut: write an index"
CHUNK, SPLIT = 8 << 20, 32 << 20  # plain bytes decoded at a time, packed bytes of a partition


class Header(NamedTuple):
    text: str
    names: list[str]
    lengths: list[int]

    def to_dict(self) -> dict:
        """HD, SQ, RG and PG lines; LN as a number."""
        found: dict = {}
        for line in self.text.splitlines():
            kind, *fields = line.split("\t")
            if kind not in ("@HD", "@SQ", "@RG", "@PG"):
                continue
            row = {f[:2]: int(f[3:]) if f[:2] == "LN" else f[3:] for f in fields if f[2:3] == ":"}
            if kind == "@HD":
                found["HD"] = row
            else:
                found.setdefault(kind[1:], []).append(row)
        if "SQ" not in found:
            found["SQ"] = [{"SN": n, "LN": k} for n, k in zip(self.names, self.lengths)]
        return found


def read_header(reader: BgzfReader) -> Header:
    if reader.read(4) != b"BAM\1":
        raise OSError("not a BAM file")
    text = reader.read(struct.unpack("<i", reader.read(4))[0]).rstrip(b"\0").decode()
    names, lengths = [], []
    for _ in range(struct.unpack("<i", reader.read(4))[0]):
        size = struct.unpack("<i", reader.read(4))[0]
        names.append(reader.read(size)[:-1].decode())
        lengths.append(struct.unpack("<i", reader.read(4))[0])
    return Header(text, names, lengths)


def header_of(path: str) -> Header:
    with open_file(path) as file:
        return read_header(BgzfReader(file))


def _within(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, .. for each length, one after another, and the offsets of each (one more at the end)."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths), offsets


def _slices(raw: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many slices, one after another, and their offsets."""
    k, offsets = _within(lengths)
    return raw[np.repeat(at, lengths) + k], offsets


def _texts(data: np.ndarray, offsets: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    valid = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    buffers = [valid, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, buffers)


def _cigars(raw: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of packed operations: their bytes and offsets."""
    packed, _ = _slices(raw, at, 4 * counts)
    ops = packed.view("<u4")
    value = (ops >> 4).astype(np.int64)
    digits = np.ones(len(ops), np.int64)
    for k in range(1, 9):
        digits += value >= 10**k
    ends = np.cumsum(digits + 1)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    out[ends - 1] = _OPS[ops & 15]
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        out[ends[has] - 2 - k] = ord("0") + value[has] // 10**k % 10
    return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


def _long_cigars(
    raw: np.ndarray, at_ops: np.ndarray, n_ops: np.ndarray, l_seq: np.ndarray, at_tags: np.ndarray, ends: np.ndarray
) -> dict[int, tuple[int, int]]:
    """Of reads with more operations than a record's field can count: place and number of those in their tag CG. Their
    records hold two instead, which clip the whole read and skip the whole span."""
    two = np.flatnonzero((n_ops == 2) & (l_seq > 0))
    if not len(two):
        return {}
    ops = raw[at_ops[two][:, None] + np.arange(8)].reshape(-1).view("<u4").reshape(-1, 2).astype(np.int64)
    some = two[(ops[:, 0] == l_seq[two] << 4 | 4) & (ops[:, 1] & 15 == 3)]
    tags = Tags(raw, at_tags[some], ends[some])
    tags.take((tags.name == int.from_bytes(b"CG")) & np.isin(tags.sub, list(b"iI")))
    return {int(some[r]): (int(a), int(c)) for r, a, c in zip(tags.row, tags.at, tags.n)}


def decode(raw: np.ndarray, at: np.ndarray, offsets: np.ndarray, names: list[str], want: frozenset[str]) -> pa.RecordBatch:
    """The rows of the records that begin at ``at`` (their sizes) in plain bytes; columns not wanted are null."""
    form = to_arrow_schema(ALIGNMENTS)
    n = len(at)
    fixed = raw[at[:, None] + np.arange(_FIXED.itemsize)].reshape(-1).view(_FIXED) if n else np.zeros(0, _FIXED)
    l_name, n_ops, l_seq = (fixed[c].astype(np.int64) for c in ("l_name", "n_ops", "l_seq"))
    at_ops = at + _FIXED.itemsize + l_name
    at_seq = at_ops + 4 * n_ops
    at_qual = at_seq + (l_seq + 1) // 2
    long = _long_cigars(raw, at_ops, n_ops, l_seq, at_qual + l_seq, at + 4 + fixed["size"])
    for k, (place, count) in long.items():
        at_ops[k], n_ops[k] = place, count
    mapped = (n_ops > 0) & (fixed["flag"] & 4 == 0)
    placed = fixed["ref"] >= 0
    columns: dict[str, pa.Array] = {
        "flag": pa.array(fixed["flag"].astype(np.int32)),
        "reference_id": pa.array(fixed["ref"].astype(np.int32)),
        "reference_name": pa.array(names, pa.string()).take(pa.array(np.where(placed, fixed["ref"], 0), mask=~placed)),
        "reference_start": pa.array(fixed["pos"].astype(np.int64)),
        "mapping_quality": pa.array(fixed["mapq"].astype(np.int32)),
        "next_reference_id": pa.array(fixed["next_ref"].astype(np.int32)),
        "next_reference_start": pa.array(fixed["next_pos"].astype(np.int64)),
        "template_length": pa.array(fixed["length"].astype(np.int32)),
        "file_offset": pa.array(offsets),
    }
    if "query_name" in want:
        columns["query_name"] = _texts(*_slices(raw, at + _FIXED.itemsize, l_name - 1))
    if "cigar" in want:
        columns["cigar"] = _texts(*_cigars(raw, at_ops, np.where(mapped, n_ops, 0)), ~mapped)
    if "span_end" in want:
        packed, edges = _slices(raw, at_ops, 4 * np.where(mapped, n_ops, 0))
        ops = packed.view("<u4")
        taken = np.append(0, np.cumsum(np.where(_ON_REFERENCE[ops & 15], ops >> 4, 0).astype(np.int64)))[edges // 4]
        columns["span_end"] = pa.array(fixed["pos"] + np.maximum(1, np.diff(taken)))
    if "query_sequence" in want:
        packed, _ = _slices(raw, at_seq, (l_seq + 1) // 2)
        letters = _PAIRS[packed].reshape(-1)
        odd = np.flatnonzero(l_seq & 1)
        if len(odd):  # the half byte behind an odd number of letters
            letters = np.delete(letters, np.cumsum(l_seq + (l_seq & 1))[odd] - 1)
        columns["query_sequence"] = _texts(letters, np.concatenate([[0], np.cumsum(l_seq)]))
    if "query_qualities" in want:
        first = raw[np.minimum(at_qual, len(raw) - 1)] if n else raw[:0]
        numbers, ends = _slices(raw, at_qual, np.where((l_seq > 0) & (first != 255), l_seq, 0))
        columns["query_qualities"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(numbers.view(np.int8)))
    if "tags" in want:
        tags = Tags(raw, at_qual + l_seq, at + 4 + fixed["size"])
        tags.drop_repeated()
        if long:
            tags.take((tags.name != int.from_bytes(b"CG")) | ~np.isin(tags.row, list(long)))
        columns["tags"] = tags.column(n, form.field("tags").type)
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in form], schema=form
    )


class Index(NamedTuple):
    """What an index says: names of the contigs, if it holds them; for each, its bins (number to chunks of virtual
    offsets) and the least offset of records that reach into each window; and how bins divide positions."""

    names: list[str]
    bins: list[dict[int, list[tuple[int, int]]]]
    windows: list[list[int]]
    shift: int = 14
    depth: int = 5

    def splits(self) -> list[int]:
        """Offsets at which records begin, ascending."""
        found = {c[0] for bins in self.bins for chunks in bins.values() for c in chunks}
        return sorted(found.union(v for line in self.windows for v in line if v))

    def span(self, contig: int, start: int, stop: int | None) -> tuple[int, int] | None:
        """A run of offsets that holds all records of a contig that overlap [start, stop); None if there are none."""
        if contig >= len(self.bins):
            return None
        bins, line = self.bins[contig], self.windows[contig]
        top = 1 << self.shift + 3 * self.depth
        low, high = min(start, top - 1), min(top if stop is None else max(stop, start + 1), top) - 1
        chunks, first = [], 0
        for level in range(self.depth + 1):
            size = self.shift + 3 * (self.depth - level)
            a, b = first + (low >> size), first + (high >> size)
            chunks += [c for number, c in bins.items() if a <= number <= b]
            first += 1 << 3 * level
        chunks = [c for some in chunks for c in some]
        # an empty window before the region's may stand between records that reach over it
        reach = max(line[: (low >> self.shift) + 1], default=0) if line and low >> self.shift < len(line) else 0
        chunks = [c for c in chunks if c[1] > reach]
        if not chunks:
            return None
        return max(reach, min(c[0] for c in chunks)), max(c[1] for c in chunks)


def cut(begin: int, end: int | None, splits: list[int], size: int) -> list[tuple[int, int | None]]:
    """Runs of offsets of at least so many packed bytes, cut where records begin."""
    edges = [begin]
    for x in splits:
        if (x >> 16) - (edges[-1] >> 16) >= size and (end is None or x < end):
            edges.append(x)
    edges.append(end)
    return list(zip(edges, edges[1:]))


def read_index(path: str) -> Index | None:
    """The .bai, .tbi or .csi index beside a file."""
    for name in (path + ".bai", path.rsplit(".", 1)[0] + ".bai", path + ".tbi", path + ".csi"):
        try:
            with open_file(name) as file:
                data = file.read()
        except FileNotFoundError:
            continue
        if data[:2] == b"\x1f\x8b":
            data = _inflated(data)
        if data[:4] == b"BAI\1":
            return _bins_and_windows(data, 8, struct.unpack_from("<i", data, 4)[0], [])
        if data[:4] == b"TBI\1":
            size = struct.unpack_from("<i", data, 32)[0]
            return _bins_and_windows(data, 36 + size, struct.unpack_from("<i", data, 4)[0], _listed(data[36 : 36 + size]))
        return _csi(data)
    return None


def _inflated(data: bytes) -> bytes:
    import zlib

    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def _listed(names: bytes) -> list[str]:
    return [x.decode() for x in names.split(b"\0")[:-1]]


def _bins_and_windows(data: bytes, at: int, n: int, names: list[str]) -> Index:
    """The common part of .bai and .tbi."""
    every, windows = [], []
    for _ in range(n):
        count, at = struct.unpack_from("<i", data, at)[0], at + 4
        bins = {}
        for _ in range(count):
            number, chunks = struct.unpack_from("<Ii", data, at)
            pairs = struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)
            if number != 37450:  # that one has counts
                bins[number] = list(zip(pairs[::2], pairs[1::2]))
            at += 8 + 16 * chunks
        size = struct.unpack_from("<i", data, at)[0]
        windows.append(list(struct.unpack_from(f"<{size}Q", data, at + 4)))
        every.append(bins)
        at += 4 + 8 * size
    return Index(names, every, windows)


def _csi(data: bytes) -> Index:
    if data[:4] != b"CSI\1":
        raise OSError("not an index")
    shift, depth, extra = struct.unpack_from("<iii", data, 4)
    names = _listed(data[44 : 16 + extra]) if extra >= 28 else []
    n, at = struct.unpack_from("<i", data, 16 + extra)[0], 20 + extra
    every, windows = [], []
    first, beyond = ((1 << 3 * depth) - 1) // 7, ((1 << 3 * depth + 3) - 1) // 7
    for _ in range(n):
        count, at = struct.unpack_from("<i", data, at)[0], at + 4
        bins, line = {}, {}
        for _ in range(count):
            number, least, chunks = struct.unpack_from("<IQi", data, at)
            pairs = struct.unpack_from(f"<{2 * chunks}Q", data, at + 16)
            if number < beyond:
                bins[number] = list(zip(pairs[::2], pairs[1::2]))
            if first <= number < beyond and least:
                line[number - first] = least
            at += 16 + 16 * chunks
        every.append(bins)
        # a bin's offset is the least of records that reach into it: as in a linear index
        windows.append([line.get(k, 0) for k in range(max(line, default=-1) + 1)])
    return Index(names, every, windows, shift, depth)


class BamPartition(InputPartition):
    """Virtual offsets at which records begin; or, if ``found`` is false, places of the file, anywhere."""

    def __init__(self, begin: int, end: int | None, found: bool = True) -> None:
        self.begin, self.end, self.found = begin, end, found


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return ALIGNMENTS

    def reader(self, schema) -> DataSourceReader:
        return BamReader(dict(self.options))


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        chosen = options.get("columns")
        self.want = frozenset(c.strip() for c in chosen.split(",")) if chosen else frozenset(ALIGNMENTS.names)
        self.split = int(options.get("split", SPLIT))
        self.contig = options.get("contig")
        self.start = int(options["start"]) if "start" in options else 0
        self.stop = int(options["stop"]) if "stop" in options else None
        self.unplaced = options.get("unplaced", "false").lower() == "true"

    def partitions(self) -> list[BamPartition]:
        with open_file(self.path) as file:
            reader = BgzfReader(file)
            header = read_header(reader)
            begin, end = reader.tell(), None
            size = file.size()
        index = read_index(self.path)
        if index is None:
            return [BamPartition(a, b, False) for a, b in ranges(size, self.split)]
        if self.unplaced:  # they stand behind all others
            begin = max([begin, *(c[1] for bins in index.bins for chunks in bins.values() for c in chunks)])
        elif self.contig is not None:
            if self.contig not in header.names:
                raise ValueError(f"unknown contig: {self.contig}")
            begin, end = index.span(header.names.index(self.contig), self.start, self.stop) or (begin, begin)
        return [BamPartition(a, b) for a, b in cut(begin, end, index.splits(), self.split)]

    def read(self, partition: BamPartition) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as file:
            reader = BgzfReader(file)
            names = read_header(reader).names
            begin, end = partition.begin, partition.end
            if not partition.found:
                shape, first, size = BamShape(len(names)), reader.tell(), file.size()
                begin, end = (first_record(file, shape, first, x, size) for x in (begin, end))
                if begin > end:
                    raise OSError(LOST)
                if begin == end:
                    return
                end = None if end == size << 16 else end
            contig = names.index(self.contig) if self.contig in names else None
            for raw, at, offsets in records(BgzfReader(file, begin), end, not partition.found):
                ended = False
                if contig is not None and len(at):
                    place = raw[at[:, None] + np.arange(4, 12)].reshape(-1).view("<i4").reshape(-1, 2)
                    ref, pos = place[:, 0], place[:, 1]
                    past = (ref > contig) | (ref < 0) | ((ref == contig) & (pos >= self.stop) if self.stop is not None else False)
                    ended = partition.found and bool(past.any())  # an indexed file is sorted
                    keep = (ref == contig) & ~past
                    at, offsets = at[keep], offsets[keep]
                if self.unplaced and len(at):
                    keep = raw[at[:, None] + np.arange(4, 8)].reshape(-1).view("<i4") < 0
                    at, offsets = at[keep], offsets[keep]
                if len(at):
                    yield decode(raw, at, offsets, names, self.want)
                if ended:
                    return


def records(
    reader: BgzfReader, end: int | None, checked: bool = False, sizes: int = 1
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of plain bytes, where records begin in them, and the records' virtual offsets, up to an offset. checked:
    a record that reaches over that offset is an error. sizes: how many sizes stand before a record."""
    data, marks = bytearray(), []  # marks: place in data of a member's first byte, and the member's in the file
    border = None
    blocks = reader.blocks()
    while True:
        more = False
        for block, plain, skip in blocks:
            if end is not None and block << 16 >= end:
                border = block << 16
                break
            marks.append((len(data) - skip, block))
            data += plain[skip:]
            if len(data) >= CHUNK:
                more = True
                break
        at, found, size = 0, [], len(data)
        head = struct.Struct(f"<{sizes}I")
        while at + head.size <= size and (upto := at + head.size + sum(head.unpack_from(data, at))) <= size:
            found.append(at)
            at = upto
        if found:
            begins, places = (np.array(x, np.int64) for x in zip(*marks))
            at_record = np.array(found, np.int64)
            member = np.searchsorted(begins, at_record, side="right") - 1
            offsets = places[member] << 16 | (at_record - begins[member])
            inside = len(found) if end is None else int(np.searchsorted(offsets, end))
            yield np.frombuffer(bytes(data), np.uint8), at_record[:inside], offsets[:inside]
            if inside < len(found):
                if checked and offsets[inside] != end:
                    raise OSError(LOST)
                return
        if not more:
            if checked and end is not None:
                reached = border if at == size or not marks else marks[-1][1] << 16 | max(0, at - marks[-1][0])
                if reached != end:
                    raise OSError(LOST)
            return
        marks = [(p - at, b) for k, (p, b) in enumerate(marks) if k + 1 == len(marks) or marks[k + 1][0] > at]
        del data[:at]


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(BamSource)


def read_bam(
    spark: SparkSession, path: str, contig: str | None = None, start: int | None = None,
    stop: int | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """Alignments of a file, or those that can overlap a region (the exact overlap is the caller's
    filter). A region needs an index."""
    register(spark)
    reader = spark.read.format("bam")
    if contig is not None:
        if read_index(path) is None:
            raise ValueError(f"could not find index of {path}")
        reader = reader.option("contig", contig)
        reader = reader if start is None else reader.option("start", str(start))
        reader = reader if stop is None else reader.option("stop", str(stop))
    if columns is not None:
        reader = reader.option("columns", ",".join(columns))
    return reader.load(path)


def read_unplaced(spark: SparkSession, path: str) -> DataFrame:
    """Reads without a contig; with an index only the file's end is read."""
    register(spark)
    return spark.read.format("bam").option("unplaced", "true").load(path)
