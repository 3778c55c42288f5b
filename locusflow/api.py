"""Files with the familiar methods, each a DataFrame plan.

Methods that give arrays or records bring a region's rows to the driver; their ``*_df`` twins give the
DataFrame. ``threads`` is checked and otherwise ignored: Spark decides.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.alignments import FLAGS, read_filter, reference_end
from .functions.coords import clamp_checked, resolve
from .operators import regions, stats
from .sources import bam, cram, vcf

PREFETCH = 256
_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


class AlignedSegment:
    """One record."""

    def __init__(self, row) -> None:
        self._row = row

    def __getattr__(self, name: str):
        if name in FLAGS:
            return bool(self._row["flag"] & FLAGS[name])
        if name.startswith("_") or name not in self._row:
            raise AttributeError(name)
        return self._row[name]

    query_name = property(lambda self: self._row["query_name"] or "*")
    query_sequence = property(lambda self: self._row["query_sequence"] or "")
    query_length = property(lambda self: len(self.query_sequence))
    query_qualities = property(lambda self: list(self._row["query_qualities"] or []))
    cigarstring = property(lambda self: self._row["cigar"])

    @property
    def cigartuples(self) -> list[tuple[int, int]]:
        import re

        return [
            ("MIDNSHP=X".index(op), int(n)) for n, op in re.findall("([0-9]+)([MIDNSHP=X])", self.cigarstring or "")
        ]

    @property
    def tags(self) -> dict:
        return {k: self.get_tag(k) for k in sorted(self._row["tags"] or {})}

    def has_tag(self, name: str) -> bool:
        return name in (self._row["tags"] or {})

    def get_tag(self, name: str):
        if not self.has_tag(name):
            raise KeyError(name)
        t = self._row["tags"][name]
        if t["type"][0] == "B":
            code = _CODES[t["type"][1]]
            return array(code, t["fa"] if code == "f" else t["ia"])
        return next((x for x in (t["i"], t["f"], t["s"]) if x is not None), None)

    def __repr__(self) -> str:
        return f"AlignedSegment({self.query_name!r}, flag={self.flag}, {self.reference_name}:{self.reference_start})"


def _threads(n: int) -> None:
    if not isinstance(n, int) or n < 1:
        raise ValueError("threads must be a positive integer")


class AlignmentFile:
    def __init__(
        self, filename: str, mode: str = "rb", reference_filename: str | None = None, spark: SparkSession | None = None
    ) -> None:
        self.is_cram = cram.is_cram_path(filename) or mode == "rc"
        if mode not in ("rb", "rc") or mode == "rc" and not cram.is_cram_path(filename):
            raise ValueError(f"unsupported mode: {mode}")
        self.filename, self.mode = filename, mode
        self._spark = spark or SparkSession.builder.getOrCreate()
        if self.is_cram:
            self.reference_filename = reference_filename or cram.sibling_fasta(filename)
            if self.reference_filename is None:
                raise ValueError("a CRAM file needs a reference FASTA")
        self._header = (cram if self.is_cram else bam).header_of(filename)
        self._closed = False
        self._rows: Iterator | None = None

    references = property(lambda self: tuple(self._header.names))
    lengths = property(lambda self: tuple(self._header.lengths))
    nreferences = property(lambda self: len(self._header.names))
    header = property(lambda self: self._header.to_dict())

    def close(self) -> None:
        self._closed = True
        self._rows = None

    def reset(self) -> None:
        self._check()
        self._rows = None

    def __enter__(self) -> AlignmentFile:
        self._check()
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _check(self) -> None:
        if self._closed:
            raise ValueError("I/O operation on a closed file")

    def _ready(self, what: str) -> None:
        self._check()
        if self.is_cram:
            raise RuntimeError(f"{what} is not available for CRAM")

    def _region(self, contig: str, start: int | None, stop: int | None):
        return resolve(dict(zip(self._header.names, self._header.lengths)), contig, start, stop)

    def dataframe(self, columns: list[str] | None = None) -> DataFrame:
        self._ready("reading records")
        return bam.read_bam(self._spark, self.filename, columns=columns)

    def unplaced_df(self) -> DataFrame:
        """Reads without a contig, which stand at the file's end."""
        self._ready("reading records")
        return bam.read_unplaced(self._spark, self.filename)

    def _scan(self, region, *columns: str) -> DataFrame:
        return bam.read_bam(self._spark, self.filename, *region, columns=list(columns) or None)

    def __iter__(self) -> AlignmentFile:
        self._check()
        return self

    def __next__(self) -> AlignedSegment:
        self._ready("iteration")
        if self._rows is None:
            self._rows = self._records(self.dataframe())  # partitions follow each other in the file's order
        return next(self._rows)

    @staticmethod
    def _records(df: DataFrame) -> Iterator[AlignedSegment]:
        whole = df.withColumn("reference_end", reference_end())
        return (AlignedSegment(r.asDict(recursive=True)) for r in whole.toLocalIterator())

    def fetch_df(self, contig: str, start: int | None = None, stop: int | None = None) -> DataFrame:
        self._ready("fetch")
        region = self._region(contig, start, stop)
        return regions.fetch(self._scan(region), *region)

    def fetch(self, contig: str, start: int | None = None, stop: int | None = None) -> Iterator[AlignedSegment]:
        return self._records(self.fetch_df(contig, start, stop))

    def count(
        self, contig: str, start: int | None = None, stop: int | None = None, read_callback: str = "nofilter",
        threads: int = 1,
    ) -> int:
        self._ready("count")
        _threads(threads)
        read_filter(read_callback)
        region = self._region(contig, start, stop)
        return stats.count(self._scan(region, "span_end"), *region, read_callback=read_callback).first()[0]

    def count_coverage_df(
        self, contig: str, start: int | None = None, stop: int | None = None, quality_threshold: int = 15,
        read_callback: str = "all",
    ) -> DataFrame:
        self._ready("count_coverage")
        region = self._region(contig, start, stop)
        scan = self._scan(region, "cigar", "query_sequence", "query_qualities")
        return stats.count_coverage(scan, *region, quality_threshold, read_callback)

    def count_coverage(
        self, contig: str, start: int | None = None, stop: int | None = None, quality_threshold: int = 15,
        read_callback: str = "all", threads: int = 1,
    ) -> tuple:
        _threads(threads)
        read_filter(read_callback)
        found = self.count_coverage_df(contig, start, stop, quality_threshold, read_callback)
        rows = found.orderBy("pos").toPandas()
        return tuple(array("L", rows[c].tolist()) for c in "ACGT")

    def depth_df(self, contig: str, start: int | None = None, stop: int | None = None) -> DataFrame:
        self._ready("depth")
        region = self._region(contig, start, stop)
        return stats.depth(self._scan(region, "cigar"), *region)

    def depth_numpy(self, contig: str, start: int | None = None, stop: int | None = None, threads: int = 1):
        _threads(threads)
        return self.depth_df(contig, start, stop).orderBy("pos").toPandas()["depth"].to_numpy("uint32")

    def depth_blocks(
        self, contig: str, start: int | None = None, stop: int | None = None, threads: int = 1
    ) -> list[tuple[int, int, int]]:
        self._ready("depth_blocks")
        _threads(threads)
        region = self._region(contig, start, stop)
        rows = stats.depth_blocks(self._scan(region, "cigar"), *region).orderBy("start").collect()
        return [(r.start, r.length, r.depth) for r in rows]

    def pileup_counts_df(
        self, contig: str, start: int | None = None, stop: int | None = None, min_base_quality: int = 0,
        min_mapping_quality: int = 0,
    ) -> DataFrame:
        self._ready("pileup_counts")
        region = self._region(contig, start, stop)
        scan = self._scan(region, "cigar", "query_sequence", "query_qualities")
        return stats.pileup_counts(scan, *region, min_base_quality, min_mapping_quality)

    def pileup_counts(
        self, contig: str, start: int | None = None, stop: int | None = None, min_base_quality: int = 0,
        min_mapping_quality: int = 0, threads: int = 1,
    ) -> dict:
        _threads(threads)
        found = self.pileup_counts_df(contig, start, stop, min_base_quality, min_mapping_quality)
        rows = found.orderBy("pos").toPandas()
        return {c: rows[c].to_numpy("uint32") for c in ("A", "C", "G", "T", "N", "depth")}

    def iter_batches(self, batch_size: int = 256, threads: int = 1, ordered: bool = True) -> Iterator[list]:
        """Lists of at most batch_size records in file order, from the start."""
        self._ready("iter_batches")
        _threads(threads)
        size, held = max(1, batch_size), []
        for record in self._records(self.dataframe()):
            held.append(record)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def parallel_fetch(self, wanted, threads: int = 1, ordered: bool = True) -> list[AlignedSegment]:
        """Records of several regions, once for each merged region, in genomic order."""
        self._ready("parallel_fetch")
        _threads(threads)
        known = dict(zip(self._header.names, self._header.lengths))
        checked = []
        for item in wanted:
            if not isinstance(item, tuple) or len(item) != 3:
                raise ValueError("regions must be (contig, start, stop)")
            checked.append(tuple(clamp_checked(known, *item)))
        if not checked:
            return []
        table = self._spark.createDataFrame(checked, "contig string, start long, stop long")
        found = regions.multi_fetch(self.dataframe(), table)
        return list(self._records(found.orderBy("reference_id", "region_start", "reference_start", "file_offset")))


class VariantRecord(NamedTuple):
    chrom: str
    pos: int
    start: int
    stop: int
    id: str | None
    ref: str
    alts: tuple
    qual: float | None
    filter: list
    format: list
    info: dict
    samples: Samples

    contig = property(lambda self: self.chrom)
    alleles = property(lambda self: (self.ref, *self.alts))


class Samples:
    """Genotypes by number or name; each has GT, DP and AD."""

    def __init__(self, names: list[str], values: list) -> None:
        self._names, self._values = names, values

    def __len__(self) -> int:
        return len(self._values)

    def __getitem__(self, key: int | str) -> dict:
        k = self._names.index(key) if isinstance(key, str) and key in self._names else key
        if not isinstance(k, int) or not 0 <= k < len(self._values):
            raise KeyError(key)
        v = self._values[k]
        return {
            "GT": None if v["gt"] is None else tuple(v["gt"]),
            "DP": v["dp"],
            "AD": None if v["ad"] is None else tuple(v["ad"]),
        }


class VariantFile:
    def __init__(self, filename: str, mode: str = "r", spark: SparkSession | None = None) -> None:
        if mode not in ("r", "rb"):
            raise ValueError(f"unsupported mode: {mode}")
        self.filename = filename
        self._spark = spark or SparkSession.builder.getOrCreate()
        self.header = vcf.read_header(filename)
        self._closed = False
        self._rows: Iterator | None = None

    samples = property(lambda self: list(self.header.samples))

    def close(self) -> None:
        self._closed = True

    def __enter__(self) -> VariantFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def dataframe(self, *region) -> DataFrame:
        """All records, or those of the part of the file that can hold a region's."""
        if self._closed:
            raise ValueError("I/O operation on a closed file")
        return vcf.parse(vcf.read_lines(self._spark, self.filename, *region))

    def typed_dataframe(self, *region) -> DataFrame:
        """The same with ``info`` as a struct of typed values, and ``more_info`` for keys that nothing declares."""
        if self._closed:
            raise ValueError("I/O operation on a closed file")
        return vcf.read_typed(self._spark, self.filename, *region)

    def _records(self, df: DataFrame) -> Iterator[VariantRecord]:
        for r in df.toLocalIterator():
            typed = {k: tuple(v) if isinstance(v, list) else v for k, v in r["info"].asDict().items() if v is not None}
            info = dict(sorted({**typed, **r["more_info"]}.items()))
            yield VariantRecord(
                r["chrom"], r["pos"], r["start"], r["stop"], r["id"], r["ref"], tuple(r["alts"]), r["qual"],
                list(r["filter"]), list(r["format"]), info, Samples(self.header.samples, r["samples"]),
            )

    def __iter__(self) -> VariantFile:
        self._rows = self._records(self.typed_dataframe())
        return self

    def __next__(self) -> VariantRecord:
        if self._rows is None:
            iter(self)
        return next(self._rows)

    def fetch_df(
        self, contig: str | None = None, start: int | None = None, stop: int | None = None, typed: bool = False
    ) -> DataFrame:
        """Records of a region; typed: as in typed_dataframe."""
        read = self.typed_dataframe if typed else self.dataframe
        if contig is None:
            return read()
        if contig not in self.header.contigs:
            raise ValueError(f"unknown contig: {contig}")
        if any(x is not None and x < 0 for x in (start, stop)):
            raise ValueError("coordinates must not be negative")
        if contig in self.header.lengths:
            region = tuple(resolve(self.header.lengths, contig, start, stop))
            return vcf.fetch(read(*region), *region)
        if stop is not None and (start or 0) > stop:
            raise ValueError("start is greater than stop")
        return vcf.fetch(read(contig, start or 0, stop), contig, start or 0, stop)

    def fetch(self, contig: str | None = None, start: int | None = None, stop: int | None = None) -> Iterator[VariantRecord]:
        return self._records(self.fetch_df(contig, start, stop, typed=True))
