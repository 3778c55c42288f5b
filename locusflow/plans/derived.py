"""Alignments, variants, regions and sites derived from the driver's tables.

The view texts run unchanged in Spark and DuckDB, so every operator over them has an oracle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runs import PHRED, text_of

CONTIG_LENGTH = 20_100
CONTIGS = ("ctg0", "ctg1", "ctg2")

ALIGNMENTS_SQL = """
select *, case when flag % 8 >= 4 then null when k=0 then '32M' when k=1 then '10M2I8M3D12M' when k=2 then '4S20M8S' when k=3 then '12M50N20M' when k=4 then '10=2X20=' when k=5 then '3H5S27M' else '6M1P26M' end as cigar from (
select md5(concat(cast(l_orderkey as string),'|',cast(l_linenumber as string),'|',cast(l_partkey as string),'|',cast(l_suppkey as string),'|',cast(cast(l_quantity as int) as string))) as read_id,
 concat('ctg', cast(l_suppkey % 3 as string)) as reference_name, cast(l_suppkey % 3 as int) as reference_id,
 cast((l_partkey*37 + l_orderkey*11 + l_linenumber*5) % 20000 as bigint) as reference_start,
 cast(l_linenumber % 7 as int) as k,
 cast((case when l_partkey % 17 = 0 then 4 else 0 end)+(case when l_linestatus='F' then 16 else 0 end)+(case when l_partkey % 11 = 0 then 256 else 0 end)+(case when l_suppkey % 13 = 0 then 512 else 0 end)+(case when l_returnflag='R' then 1024 else 0 end)+(case when l_orderkey % 19 = 0 then 2048 else 0 end) as int) as flag,
 cast(l_quantity as int) as mapping_quality,
 translate(md5(concat('s',cast(l_orderkey as string),'|',cast(l_linenumber as string),'|',cast(l_partkey as string))),'0123456789abcdef','ACGTACGTACGTACNN') as query_sequence,
 md5(concat('q',cast(l_orderkey as string),'|',cast(l_linenumber as string),'|',cast(l_partkey as string))) as qual_hex
from lineitem) t
"""

#: The aligned runs of each template above: offset on the reference, length, offset in the read.
TEMPLATES_SQL = "(values (0,0,32,0),(1,0,10,0),(1,10,8,12),(1,21,12,20),(2,0,20,4),(3,0,12,0),(3,62,20,12),(4,0,10,0),(4,10,2,10),(4,12,20,12),(5,0,27,5),(6,0,6,0),(6,6,26,6)) as t(k,ro,len,qo)"

VARIANTS_SQL = """
select concat('ctg', cast(p_partkey % 3 as string)) as chrom, cast((p_partkey * 53) % 20000 as bigint) as start,
 concat('rs', cast(p_partkey as string)) as id, substr('ACGT', cast(p_partkey % 4 + 1 as int), cast(1 as int)) as ref1,
 cast(p_partkey % 5 as int) as kind, cast(p_size as int) as size,
 concat('DP=', cast(p_size as string), ';AF=0.', cast(p_partkey % 9 + 1 as string), case when p_partkey % 7 = 0 then ';DB' else '' end, ';NS=.') as info,
 concat(case when p_partkey % 6 = 0 then './1' when p_partkey % 2 = 0 then '0/1' else '1|1' end, ':', cast(p_size as string), ':', cast(p_size % 11 as string), ',', case when p_partkey % 8 = 0 then '.' else cast(p_size % 5 as string) end) as sample
from part
"""


_DIGITS = "0123456789abcdef"
_QUALITY = np.zeros(256, np.int8)
_QUALITY[list(_DIGITS.encode())] = 5 + 2 * np.arange(16)
_QUALITY_TEXT = "".join(chr(PHRED + _QUALITY[ord(c)]) for c in _DIGITS)


def qualities(digits: pa.Array) -> pa.Array:
    """A quality for each hexadecimal digit: 5 and twice the digit."""
    data, offsets = text_of(digits)
    values = pa.array(_QUALITY[data[offsets[0] : offsets[-1]]])
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), values)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived reads with the columns of the alignment schema that they have, and their qualities as SAM's text too,
    which Spark makes by itself: statistics over it need no Python worker before their own."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    rows = spark.sql(ALIGNMENTS_SQL)
    quality = F.arrow_udf(qualities, "array<tinyint>")("qual_hex")
    text = F.translate("qual_hex", _DIGITS, _QUALITY_TEXT)
    return rows.withColumns({"query_qualities": quality, "quality_text": text}).withColumnRenamed("read_id", "query_name")


def contigs(spark: SparkSession) -> DataFrame:
    """Made by Spark: local rows would be read by Python workers."""
    return spark.range(len(CONTIGS)).selectExpr(
        "cast(id as int) as reference_id", "concat('ctg', cast(id as string)) as name", f"{CONTIG_LENGTH}L as length"
    )


def regions(spark: SparkSession) -> DataFrame:
    return spark.range(200).selectExpr(
        "cast(id as int) as region_id",
        "concat('ctg', cast(id % 3 as string)) as contig",
        "id * 97 % 19500 as start",
        "id * 97 % 19500 + 1 + id * 7 % 900 as stop",
    )


REGIONS_SQL = "select cast(id as int) as region_id, concat('ctg', cast(id % 3 as string)) as contig, id * 97 % 19500 as start, id * 97 % 19500 + 1 + id * 7 % 900 as stop from range(200) t(id)"


#: Regions of orders, many of which overlap or touch.
ORDER_REGIONS_SQL = """
select concat('ctg', cast(o_custkey % 3 as string)) as contig, cast((o_orderkey * 9973) % 50000000 as bigint) as start,
 cast((o_orderkey * 9973) % 50000000 + o_custkey % 1700 as bigint) as stop
from orders
"""


def order_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(ORDER_REGIONS_SQL)


#: A site for each part.
PART_SITES_SQL = """
select cast(p_partkey as bigint) as site_idx, concat('ctg', cast(p_partkey % 3 as string)) as chrom, cast((p_partkey * 53) % 20000 as bigint) as pos0,
 substr('ACGT', cast(p_partkey % 4 + 1 as int), cast(1 as int)) as ref, substr('ACGT', cast((p_partkey + 1 + p_size % 3) % 4 + 1 as int), cast(1 as int)) as alt
from part
"""


def part_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of parts as lines of text (columns line, value), of both kinds, each behind a line that is none."""
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return _lines_of(spark, spark.sql(PART_SITES_SQL))


def sites(spark: SparkSession) -> DataFrame:
    return spark.range(3 * CONTIG_LENGTH // 50).selectExpr(
        "id as site_idx",
        "concat('ctg', cast(id % 3 as string)) as chrom",
        "id div 3 * 50 as pos0",
        "substr('ACGT', cast(id % 4 + 1 as int), 1) as ref",
        "substr('ACGT', cast((id + 1) % 4 + 1 as int), 1) as alt",
    )


SITES_SQL = f"select id as site_idx, concat('ctg', cast(id % 3 as string)) as chrom, id // 3 * 50 as pos0, substr('ACGT', cast(id % 4 + 1 as int), 1) as ref, substr('ACGT', cast((id + 1) % 4 + 1 as int), 1) as alt from range({3 * CONTIG_LENGTH // 50}) t(id)"


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived variants as lines of VCF text (column value)."""
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(
        f"""select concat_ws('\\t', chrom, cast(start + 1 as string), case when kind = 4 then '.' else id end,
          case when kind = 2 then concat(ref1, 'AC') else ref1 end,
          case kind when 0 then 'G' when 1 then 'ATT' when 2 then 'A' when 3 then 'G,T' else '.' end,
          case when kind = 3 then '.' else cast(size as string) end,
          case when kind = 1 then 'LowQual;q10' when kind = 4 then '.' else 'PASS' end,
          info, 'GT:DP:AD', sample) as value from ({VARIANTS_SQL}) v"""
    )


def _lines_of(spark: SparkSession, sites: DataFrame) -> DataFrame:
    every = sites.selectExpr(
        "2 * site_idx + 2 as line",
        "case when site_idx % 2 = 0 then concat_ws('\t', chrom, cast(pos0 as string), cast(pos0 + 1 as string), concat(ref, '>', alt)) "
        "else concat_ws('\t', chrom, cast(pos0 + 1 as string), ref, alt) end as value",
    )
    other = sites.selectExpr("2 * site_idx + 1 as line", "case when site_idx % 3 = 0 then '# x' else '  ' end as value")
    head = spark.range(1).selectExpr("0L as line", "'chrom\tpos\tref\talt' as value")
    return every.unionByName(other).unionByName(head)


def site_lines(spark: SparkSession) -> DataFrame:
    """The derived sites as lines of text (columns line, value): a header, comments, blank lines, and sites of both
    kinds, each behind a line that is none."""
    return _lines_of(spark, sites(spark))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived reads with a mate and tags, as a file has them."""
    value = "named_struct('type', {0}, 'i', cast({1} as bigint), 'f', cast(null as float), 's', {2}, 'ia', {3}, 'fa', cast(null as array<float>))"
    none = "cast(null as string)", "cast(null as array<bigint>)"
    tags = ", ".join(
        (
            "'NM', " + value.format("'C'", "mapping_quality", *none),
            "'RG', " + value.format("'Z'", "null", "concat('lane', cast(k as string))", none[1]),
            "'XX', " + value.format("'i'", "1", *none),
            "'XS', " + value.format("'Bc'", "null", none[0], "array(cast(k as bigint), cast(flag as bigint))"),
        )
    )
    return alignments(spark, sf_dir).selectExpr(
        "*", "-1 as next_reference_id", "-1L as next_reference_start", "k - 3 as template_length", f"map({tags}) as tags",
        "reference_start as file_offset",
    )
