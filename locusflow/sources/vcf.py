"""VCF text: records, headers, region scans."""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bam import read_index
from .bgzf import MEMBER, open_file, register

GENOTYPE = "array<struct<gt:array<int>,dp:int,ad:array<int>>>"


class VariantHeader(NamedTuple):
    samples: list[str]
    contigs: list[str]
    lengths: dict[str, int]  # of those that declare one
    info: dict[str, tuple[str, str]]  # Number and Type of each declared key


# Fixed values of the file format: Number and Type of the keys that it reserves, for files that do not declare them.
RESERVED = {
    "AA": ("1", "String"), "AC": ("A", "Integer"), "AD": ("R", "Integer"), "ADF": ("R", "Integer"), "ADR": ("R", "Integer"),
    "AF": ("A", "Float"), "AN": ("1", "Integer"), "BQ": ("1", "Float"), "CIGAR": ("A", "String"), "DB": ("0", "Flag"),
    "DP": ("1", "Integer"), "END": ("1", "Integer"), "H2": ("0", "Flag"), "H3": ("0", "Flag"), "MQ": ("1", "Float"),
    "MQ0": ("1", "Integer"), "NS": ("1", "Integer"), "SB": ("4", "Integer"), "SOMATIC": ("0", "Flag"),
    "VALIDATED": ("0", "Flag"), "1000G": ("0", "Flag"),
}


def kind_of(path: str) -> str:
    """"vcf" (plain text), "gz", "bgz" (a gzip file that can be read from its middle) or "bcf"."""
    name = path.lower()
    if name.endswith(".bcf"):
        return "bcf"
    if name.endswith(".vcf"):
        return "vcf"
    if name.endswith((".vcf.gz", ".vcf.bgz")):
        with open_file(path) as file:
            return "bgz" if MEMBER.match(file.read(18)) else "gz"
    raise ValueError(f"not a variant file: {path}")


def header_of(lines: list[str]) -> VariantHeader:
    contigs, lengths, samples, info = [], {}, [], {}
    for line in lines:
        name = re.search(r"[<,]ID=([^,>]+)", line)
        if line.startswith("##contig=<") and name:
            contigs.append(name[1])
            size = re.search(r"[<,]length=(\d+)", line)
            if size:
                lengths[name[1]] = int(size[1])
        elif line.startswith("##INFO=<") and name:
            number, kind = re.search(r"[<,]Number=([^,>]+)", line), re.search(r"[<,]Type=([^,>]+)", line)
            if number and kind:
                info[name[1]] = (number[1], kind[1])
        elif line.startswith("#CHROM"):
            samples = line.rstrip("\r\n").split("\t")[9:]
    return VariantHeader(samples, contigs, lengths, info)


def read_lines(
    spark: SparkSession, path: str, contig: str | None = None, start: int = 0, stop: int | None = None
) -> DataFrame:
    """Lines (column value) of a variant file. For a region of a file with an index (.tbi or .csi) only the part that
    can hold its records is read; which of them overlap it is the caller's filter."""
    kind = kind_of(path)
    if kind in ("vcf", "gz"):
        return spark.read.text(path)
    span = _span(path, contig, start, stop)
    if kind == "bcf":
        from . import bcf

        return bcf.read_lines(spark, path, span)
    register(spark)
    reader = spark.read.format("bgzf_lines")
    if span is not None:
        reader = reader.option("begin", str(span[0])).option("end", str(span[1]))
    return reader.load(path)


def _span(path: str, contig: str | None, start: int, stop: int | None) -> tuple[int, int] | None:
    """The run of virtual offsets that the index gives for a region; None for the whole file."""
    if contig is None or (index := read_index(path)) is None:
        return None
    names = index.names or read_header(path).contigs
    return (index.span(names.index(contig), start, stop) if contig in names else None) or (0, 0)


def read_typed(
    spark: SparkSession, path: str, contig: str | None = None, start: int = 0, stop: int | None = None
) -> DataFrame:
    """Records with typed ``info``, of the part of the file that can hold a region's, if one is given. A BCF file's values
    come from its bytes, the others' from text."""
    if kind_of(path) == "bcf":
        from . import bcf

        return bcf.read_columns(spark, path, _span(path, contig, start, stop))
    return with_typed_info(parse(read_lines(spark, path, contig, start, stop)), read_header(path))


def head_lines(path: str) -> list[str]:
    """The header's lines, read from the file's start up to the names of the columns."""
    if kind_of(path) == "bcf":
        from . import bcf

        return bcf.header_text(path).splitlines()
    out: list[str] = []
    rest = b""
    with open_file(path) as file:
        inflate = zlib.decompressobj(31) if path.lower().endswith("gz") else None
        while piece := file.read(1 << 16):
            while piece:
                rest += inflate.decompress(piece) if inflate else piece
                piece = b""
                if inflate and inflate.eof:
                    piece, inflate = inflate.unused_data, zlib.decompressobj(31)
            *whole, rest = rest.split(b"\n")
            for line in whole:
                if not line.startswith(b"#"):
                    return out
                out.append(line.decode().rstrip("\r"))
                if line.startswith(b"#CHROM"):
                    return out
    return out + ([rest.decode()] if rest.startswith(b"#") else [])


def read_header(path: str) -> VariantHeader:
    return header_of(head_lines(path))


def _missing(x: Column) -> Column:
    return F.when((x != ".") & (x != ""), x)


def _int(text: Column) -> Column:
    return F.when(text.rlike("^-?[0-9]+$"), text.cast("int"))


def parse(lines: DataFrame) -> DataFrame:
    """Records of VCF lines: chrom, pos (1-based), start, stop, id, ref, alts, alleles, qual, filter, format,
    info (a map of texts, keys without a value left out, flags empty texts) and samples (gt, dp, ad).
    """
    c = F.split("value", "\t")
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#")).select(c.alias("c"))

    def at(k: int) -> Column:
        return F.get("c", F.lit(k))

    pairs = F.filter(F.split(_missing(at(7)), ";"), lambda p: (p != "") & ~p.rlike("^[^=]*=\\.?$"))
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("value"),
        ),
    )
    info = F.coalesce(F.map_from_entries(entries), F.create_map().cast("map<string,string>"))
    alts = F.coalesce(F.split(_missing(at(4)), ","), F.array().cast("array<string>"))
    formats = F.coalesce(F.split(_missing(at(8)), ":"), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    base = rows.select(
        at(0).alias("chrom"),
        at(1).cast("long").alias("pos"),
        (at(1).cast("long") - 1).alias("start"),
        _missing(at(2)).alias("id"),
        at(3).alias("ref"),
        alts.alias("alts"),
        _missing(at(5)).cast("float").alias("qual"),
        F.coalesce(F.split(_missing(at(6)), ";"), none).alias("filter"),
        formats.alias("format"),
        info.alias("info"),
        F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0))).alias("raw"),
    )

    def sample(text: Column) -> Column:
        values = F.split(text, ":")

        def key(name: str) -> Column:
            place = F.array_position("format", name).cast("int")
            return F.when(place > 0, _missing(F.get(values, place - 1)))

        gt = F.transform(F.split(key("GT"), "[/|]"), _int)
        return F.struct(
            gt.alias("gt"), _int(key("DP")).alias("dp"), F.transform(F.split(key("AD"), ","), _int).alias("ad")
        )

    declared = F.get(F.split(F.col("info")["END"], ","), F.lit(0)).cast("long")
    return base.select(
        "chrom",
        "pos",
        "start",
        F.coalesce(declared, F.col("start") + F.length("ref")).alias("stop"),
        "id",
        "ref",
        "alts",
        F.concat(F.array("ref"), "alts").alias("alleles"),
        "qual",
        "filter",
        "format",
        "info",
        F.transform("raw", sample).alias("samples"),
    )


def with_typed_info(variants: DataFrame, header: VariantHeader) -> DataFrame:
    """``info`` becomes a struct with a field for each key that the header declares or the format reserves, typed by
    Number and Type: flags are true or null, of Number 1 one value, of others an array; what is no such number is null.
    ``more_info`` holds the texts of other keys."""
    kinds = {"Integer": "int", "Float": "float"}
    every = {**RESERVED, **header.info}

    def typed(key: str) -> Column:
        number, kind = every[key]
        text = F.col("info")[key]

        def one(x: Column) -> Column:
            return _missing(x).try_cast(kinds.get(kind, "string"))

        if kind == "Flag":
            return F.when(F.map_contains_key("info", key), F.lit(True))
        return one(text) if number == "1" else F.transform(F.split(text, ","), one)

    others = F.map_filter("info", lambda k, _: ~k.isin(*every))
    return variants.withColumn("more_info", others).withColumn("info", F.struct(*[typed(k).alias(k) for k in sorted(every)]))


def fetch(variants: DataFrame, contig: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Records that overlap [start, stop); without stop, up to the contig's end."""
    if stop is not None and start >= stop:
        return variants.limit(0)
    found = variants.filter((F.col("chrom") == contig) & (F.col("stop") > start))
    return found if stop is None else found.filter(F.col("start") < stop)
