"""The alignment schema and column expressions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

TAG = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("f", T.FloatType()),
        T.StructField("s", T.StringType()),
        T.StructField("ia", T.ArrayType(T.LongType())),
        T.StructField("fa", T.ArrayType(T.FloatType())),
    ]
)
ALIGNMENTS = T.StructType(
    [
        T.StructField("query_name", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("reference_id", T.IntegerType()),
        T.StructField("reference_name", T.StringType()),
        T.StructField("reference_start", T.LongType()),
        T.StructField("mapping_quality", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
        T.StructField("query_sequence", T.StringType()),
        T.StructField("query_qualities", T.ArrayType(T.ByteType())),
        T.StructField("next_reference_id", T.IntegerType()),
        T.StructField("next_reference_start", T.LongType()),
        T.StructField("template_length", T.IntegerType()),
        T.StructField("tags", T.MapType(T.StringType(), TAG)),
        T.StructField("file_offset", T.LongType()),
        T.StructField("span_end", T.LongType()),
    ]
)

FLAGS = {
    "is_paired": 0x1,
    "is_proper_pair": 0x2,
    "is_unmapped": 0x4,
    "mate_is_unmapped": 0x8,
    "is_reverse": 0x10,
    "mate_is_reverse": 0x20,
    "is_read1": 0x40,
    "is_read2": 0x80,
    "is_secondary": 0x100,
    "is_qcfail": 0x200,
    "is_duplicate": 0x400,
    "is_supplementary": 0x800,
}
#: Reads that count and depth leave out under "all", and those that pileups leave out.
MASK_ALL = FLAGS["is_unmapped"] | FLAGS["is_secondary"] | FLAGS["is_qcfail"] | FLAGS["is_duplicate"]
MASK_PILEUP = MASK_ALL | FLAGS["is_supplementary"]
READ_FILTERS = {"nofilter": 0, "all": MASK_ALL}

CIGAR_OPS = "MIDNSHP=X"  # an operation's place is its code
ON_REFERENCE, ON_BOTH, ON_QUERY = "MDN=X", "M=X", "MIS=X"


def has_flag(name: str, flag: Column | str = "flag") -> Column:
    return _col(flag).bitwiseAND(FLAGS[name]) != 0


def passes(mask: int, flag: Column | str = "flag") -> Column:
    """No bit of the mask is set."""
    return _col(flag).bitwiseAND(mask) == 0 if mask else F.lit(True)


def read_filter(name: str) -> int:
    if name not in READ_FILTERS:
        raise ValueError(f"read_callback must be one of {sorted(READ_FILTERS)}")
    return READ_FILTERS[name]


def cigar_ops(cigar: Column | str = "cigar") -> Column:
    """array<struct<op, len>> of a CIGAR string; null stays null."""
    return F.transform(
        F.regexp_extract_all(_col(cigar), F.lit(f"([0-9]+)([{CIGAR_OPS}])"), F.lit(0)),
        lambda t: F.struct(
            F.substring(t, -1, 1).alias("op"),
            t.substr(F.lit(1), F.length(t) - 1).cast("int").alias("len"),
        ),
    )


def cigar_tuples(cigar: Column | str = "cigar") -> Column:
    """array<struct<code, len>>; empty without a CIGAR."""
    found = F.transform(
        cigar_ops(cigar),
        lambda o: F.struct((F.instr(F.lit(CIGAR_OPS), o["op"]) - 1).alias("code"), o["len"].alias("len")),
    )
    return F.coalesce(found, F.array().cast("array<struct<code:int,len:int>>"))


def cigar_string(ops: Column | str) -> Column:
    """The text of array<struct<op, len>>; null if there is none."""
    ops = _col(ops)
    text = F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return F.when(F.size(ops) > 0, text)


def _sum(ops: Column, kinds: str) -> Column:
    held = F.filter(ops, lambda o: o["op"].isin(*kinds))
    return F.aggregate(held, F.lit(0).cast("long"), lambda a, o: a + o["len"])


def reference_length(cigar: Column | str = "cigar") -> Column:
    return F.coalesce(_sum(cigar_ops(cigar), ON_REFERENCE), F.lit(0))


def query_length_on_cigar(cigar: Column | str = "cigar") -> Column:
    return F.coalesce(_sum(cigar_ops(cigar), ON_QUERY), F.lit(0))


def reference_end() -> Column:
    """Exclusive end; null without a place or CIGAR."""
    placed = ~has_flag("is_unmapped") & (F.col("reference_start") >= 0) & F.col("cigar").isNotNull()
    return F.when(placed, F.col("reference_start") + reference_length())


def span_end() -> Column:
    """End of what a read covers for overlaps: one base at least, one for placed unmapped reads. CIGARs of an Arrow
    batch are parsed together; only they go to Python. Spark must not repeat that in filters that it derives from
    later joins and tests, each with Python workers of its own, so it is told that the values may differ."""
    from .runs import reference_lengths

    lengths = F.arrow_udf(reference_lengths, "bigint").asNondeterministic()
    return F.col("reference_start") + F.greatest(F.lit(1), lengths(F.when(~has_flag("is_unmapped"), F.col("cigar"))))


def with_span(alignments: DataFrame) -> DataFrame:
    """alignments with span_end: that of the source, which has it from the packed CIGARs, or parsed from the texts.
    Filters behind it stay behind it, so those that do without span_end belong before it."""
    if "span_end" in alignments.columns:
        return alignments
    ship(alignments.sparkSession)
    return alignments.withColumn("span_end", span_end())


def overlapping(alignments: DataFrame, contig: str, start: int, stop: int) -> DataFrame:
    """Alignments of a region, with span_end; only of reads that begin before its end are CIGARs parsed. All tests are of
    columns, so a source that has span_end can take them."""
    near = (F.col("reference_name") == contig) & (F.col("reference_start") >= 0) & (F.col("reference_start") < stop)
    return with_span(alignments.filter(near & F.lit(start < stop))).filter(F.col("span_end") > start)


def aligned_blocks(cigar: Column | str = "cigar", start: Column | str = "reference_start") -> Column:
    """array<struct<lo, hi, q>>: runs of the reference that bases of the read stand on, and the place
    in the read of each run's first base."""
    state = F.struct(
        _col(start).cast("long").alias("r"),
        F.lit(0).cast("long").alias("q"),
        F.array().cast("array<struct<lo:bigint,hi:bigint,q:bigint>>").alias("out"),
    )

    def step(s: Column, o: Column) -> Column:
        size = o["len"].cast("long")
        block = F.struct(s["r"].alias("lo"), (s["r"] + size).alias("hi"), s["q"].alias("q"))
        return F.struct(
            (s["r"] + F.when(o["op"].isin(*ON_REFERENCE), size).otherwise(0)).alias("r"),
            (s["q"] + F.when(o["op"].isin(*ON_QUERY), size).otherwise(0)).alias("q"),
            F.when(o["op"].isin(*ON_BOTH), F.array_append(s["out"], block)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(cigar_ops(cigar), state, step, lambda s: s["out"])


def get_tag(name: str, tags: Column | str = "tags") -> Column:
    return F.try_element_at(_col(tags), F.lit(name))


def has_tag(name: str, tags: Column | str = "tags") -> Column:
    return F.coalesce(F.map_contains_key(_col(tags), name), F.lit(False))


def allele_frequency(alt: Column, depth: Column) -> Column:
    return F.when(depth > 0, alt / depth).otherwise(F.lit(0.0))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
