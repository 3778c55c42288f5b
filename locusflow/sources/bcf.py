"""BCF files, as typed columns (``read_columns``) or as lines of VCF text for the parser of both formats."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bam import LOST, cut, read_index, records
from .bgzf import SPLIT, BgzfReader, open_file
from .bcf_columns import decode, schema_of
from .boundaries import BcfShape, first_record, ranges
from .vcf import header_of

ROWS = 10_000

_INTS = {1: ("b", -128), 2: ("h", -32768), 3: ("i", -(1 << 31))}
_MISSING_FLOAT, _END_FLOAT = 0x7F800001, 0x7F800002


def _dictionary(text: str) -> tuple[list[str], list[str]]:
    """Names of filters and keys, and of contigs, by their numbers in records."""
    keys, contigs = {"PASS": 0}, {}
    for line in text.splitlines():
        kind = re.match(r"##(FILTER|INFO|FORMAT|contig)=<", line)
        name = re.search(r"[<,]ID=([^,>]+)", line)
        if not kind or not name:
            continue
        place = contigs if kind[1] == "contig" else keys
        idx = re.search(r"[<,]IDX=(\d+)", line)
        if idx:
            place[name[1]] = int(idx[1])
        else:
            place.setdefault(name[1], max(place.values(), default=-1) + 1)

    def listed(place: dict[str, int]) -> list[str]:
        out = [""] * (max(place.values(), default=-1) + 1)
        for name, k in place.items():
            out[k] = name
        return out

    return listed(keys), listed(contigs)


def _number(x: float) -> str:
    """The shortest text that gives the same 32-bit number."""
    return np.format_float_positional(np.float32(x), trim="-") if np.isfinite(x) else str(x)


class _Values:
    """Typed values in a record's bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def describe(self) -> tuple[int, int]:
        head = self.data[self.at]
        self.at += 1
        kind, size = head & 15, head >> 4
        if size == 15:
            size = int(self.take(*self.describe())[0])
        return kind, size

    def take(self, kind: int, size: int) -> list[str]:
        """Texts of values; "." for missing ones; padding at the end is dropped."""
        if kind == 7:
            raw = self.data[self.at : self.at + size]
            self.at += size
            text = raw.rstrip(b"\0").decode()
            return [text] if text else []
        if kind == 5:
            bits = struct.unpack_from(f"<{size}I", self.data, self.at)
            floats = struct.unpack_from(f"<{size}f", self.data, self.at)
            self.at += 4 * size
            return ["." if b == _MISSING_FLOAT else _number(x) for b, x in zip(bits, floats) if b != _END_FLOAT]
        if kind in _INTS:
            code, missing = _INTS[kind]
            form = f"<{size}{code}"
            values = struct.unpack_from(form, self.data, self.at)
            self.at += struct.calcsize(form)
            return ["." if v == missing else str(v) for v in values if v != missing + 1]
        return []

    def typed(self) -> list[str]:
        return self.take(*self.describe())


def _genotype(values: list[str]) -> str:
    out = ""
    for k, v in enumerate(values):
        n = 0 if v == "." else int(v)
        out += ("" if k == 0 else "|" if n & 1 else "/") + ("." if n >> 1 == 0 else str((n >> 1) - 1))
    return out or "."


def line_of(shared: bytes, each: bytes, keys: list[str], contigs: list[str]) -> str:
    chrom, pos, length, quality, counts, samples = struct.unpack_from("<iiiIII", shared)
    (qual,) = struct.unpack_from("<f", shared, 12)
    n_info, n_allele, n_format, n_sample = counts & 0xFFFF, counts >> 16, samples >> 24, samples & 0xFFFFFF
    v = _Values(shared)
    v.at = 24
    name = ";".join(v.typed()) or "."
    alleles = ["".join(v.typed()) for _ in range(n_allele)]
    filters = [keys[int(x)] for x in v.typed()]
    info = []
    for _ in range(n_info):
        key = keys[int(v.typed()[0])]
        kind, size = v.describe()
        values = v.take(kind, size)
        info.append(f"{key}={','.join(values)}" if kind and size else key)
    if length != len(alleles[0]) and not any(x.startswith("END=") for x in info):
        info.append(f"END={pos + length}")
    f = _Values(each)
    formats, columns = [], [[] for _ in range(n_sample)]
    for _ in range(n_format):
        formats.append(keys[int(f.typed()[0])])
        kind, size = f.describe()
        for column in columns:
            values = f.take(kind, size)
            column.append(_genotype(values) if formats[-1] == "GT" else ",".join(values) or ".")
    fields = [
        contigs[chrom], str(pos + 1), name, alleles[0] if alleles else ".", ",".join(alleles[1:]) or ".",
        "." if quality == _MISSING_FLOAT else _number(qual), ";".join(filters) or ".", ";".join(info) or ".",
    ]
    if n_format:
        fields += [":".join(formats), *(":".join(c) for c in columns)]
    return "\t".join(fields)


class BcfLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bcf_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _BcfReader(dict(self.options))


def header_text(path: str) -> str:
    with open_file(path) as file:
        return _header(BgzfReader(file))


def _header(reader: BgzfReader) -> str:
    if reader.read(5)[:3] != b"BCF":
        raise OSError("not a BCF file")
    return reader.read(struct.unpack("<I", reader.read(4))[0]).rstrip(b"\0").decode()


class BcfPartition(InputPartition):
    """Virtual offsets at which records begin; or, if ``found`` is false, places of the file, anywhere."""

    def __init__(self, begin: int, end: int | None, found: bool = True) -> None:
        self.begin, self.end, self.found = begin, end, found


class _BcfReader(DataSourceReader):
    """Partitions are cut where the index (.csi) says that records begin; without one, anywhere (``boundaries``)."""

    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.span = (int(options["begin"]), int(options["end"])) if "begin" in options else None

    def partitions(self) -> list[BcfPartition]:
        with open_file(self.path) as file:
            reader = BgzfReader(file)
            _header(reader)
            begin, end, size = reader.tell(), None, file.size()
        index = read_index(self.path)
        if index is None:
            return [BcfPartition(a, b, False) for a, b in ranges(size, self.split)]
        if self.span is not None:
            begin, end = max(begin, self.span[0]), max(begin, self.span[1])
        return [BcfPartition(a, b) for a, b in cut(begin, end, index.splits(), self.split)]

    def read(self, partition: BcfPartition) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as file:
            reader = BgzfReader(file)
            text = _header(reader)
            keys, contigs = _dictionary(text)
            span = self._span(file, reader.tell(), partition, contigs, text)
            if span is None:
                return
            begin, end = span
            reader = BgzfReader(file, begin)
            held: list[str] = []
            while end is None or reader.where() < end:
                if len(sizes := reader.read(8)) < 8:
                    break
                a, b = struct.unpack("<II", sizes)
                held.append(line_of(reader.read(a), reader.read(b), keys, contigs))
                if len(held) == ROWS:
                    yield pa.record_batch([pa.array(held)], names=["value"])
                    held = []
            if not partition.found and end is not None and reader.where() > end:
                raise OSError(LOST)
            if held:
                yield pa.record_batch([pa.array(held)], names=["value"])

    @staticmethod
    def _span(file, first: int, partition: BcfPartition, contigs: list[str], text: str) -> tuple[int, int | None] | None:
        """The virtual offsets of a partition's records; None if it has none."""
        begin, end = partition.begin, partition.end
        if not partition.found:
            shape, size = BcfShape(len(contigs), max(0, len(text.splitlines()[-1].split("\t")) - 9)), file.size()
            begin, end = (first_record(file, shape, first, x, size) for x in (begin, end))
            if begin > end:
                raise OSError(LOST)
            if begin == end:
                return None
            end = None if end == size << 16 else end
        return begin, end


class BcfColumns(DataSource):
    """Records as rows of ``bcf_columns.schema_of`` the file's header."""

    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self):
        return schema_of(header_of(header_text(self.options["path"]).splitlines()))

    def reader(self, schema) -> DataSourceReader:
        return _ColumnReader(dict(self.options))


class _ColumnReader(_BcfReader):
    def read(self, partition: BcfPartition) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as file:
            reader = BgzfReader(file)
            text = _header(reader)
            keys, contigs = _dictionary(text)
            header = header_of(text.splitlines())
            span = self._span(file, reader.tell(), partition, contigs, text)
            if span is None:
                return
            begin, end = span
            for raw, at, _ in records(BgzfReader(file, begin), end, not partition.found, 2):
                if len(at):
                    yield decode(raw, at, keys, contigs, header)


def read_columns(spark: SparkSession, path: str, span: tuple[int, int] | None = None) -> DataFrame:
    """Records with typed columns; of a run of virtual offsets, if one is given."""
    from ..session import ship

    ship(spark)
    spark.dataSource.register(BcfColumns)
    reader = spark.read.format("bcf")
    if span is not None:
        reader = reader.option("begin", str(span[0])).option("end", str(span[1]))
    return reader.load(path)


def read_lines(spark: SparkSession, path: str, span: tuple[int, int] | None = None) -> DataFrame:
    """Records as lines (column value), without the header; of a run of virtual offsets, if one is given."""
    from ..session import ship

    ship(spark)
    spark.dataSource.register(BcfLines)
    reader = spark.read.format("bcf_lines")
    if span is not None:
        reader = reader.option("begin", str(span[0])).option("end", str(span[1]))
    return reader.load(path)
