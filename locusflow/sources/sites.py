"""Candidate sites from BED-like or tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written


def parse_sites(lines: DataFrame) -> DataFrame:
    """lines: line (number from 0), value. Gives site_idx, chrom, pos0, ref, alt.

    Blank lines, comments and a header in line 0 are left out. Four columns of which the fourth is REF>ALT
    are BED (0-based start; the stop is not used); other lines with four columns have a 1-based position.
    Anything else is an error that names the line.
    """
    text = F.trim("value")
    rows = lines.withColumn("value", text).filter(
        (text != "") & ~text.startswith("#") & ~((F.col("line") == 0) & F.lower(text).startswith("chrom"))
    )
    c = F.split("value", "\t")
    change = F.get(c, F.lit(3))
    bed = (F.size(c) >= 4) & F.coalesce(change.contains(">"), F.lit(False))
    number = F.get(c, F.lit(1)).try_cast("long")
    ok = (F.size(c) >= 4) & number.isNotNull() & F.when(bed, number >= 0).otherwise(number >= 1)
    where = F.concat(F.lit("invalid site in line "), (F.col("line") + 1).cast("string"))
    return rows.select(
        F.col("line").alias("site_idx"),
        F.get(c, F.lit(0)).alias("chrom"),
        F.when(~ok, F.raise_error(where).cast("long")).when(bed, number).otherwise(number - 1).alias("pos0"),
        F.when(bed, F.substring_index(change, ">", 1)).otherwise(F.get(c, F.lit(2))).alias("ref"),
        F.when(bed, F.regexp_replace(change, "^[^>]*>", "")).otherwise(change).alias("alt"),
    )


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites of one file, numbered in its order: a text split holds lines that follow each other, and begins where
    the split before it ends, so lines are numbered from the sum of those in earlier splits."""
    held = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_row")
    )
    placed = written(held, "site-lines")
    inside = Window.partitionBy("_part").orderBy("_row")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    sizes = placed.groupBy("_part").count()
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    lines = placed.join(F.broadcast(offsets), "_part").withColumn(
        "line", F.row_number().over(inside) - 1 + F.col("_before")
    )
    return parse_sites(lines.select("line", "value"))
