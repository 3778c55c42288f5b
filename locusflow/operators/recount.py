"""Recounting bases at candidate sites: one pileup limited to the sites, joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignments import MASK_PILEUP, allele_frequency, has_flag, passes
from ..sources.lines import write_lines
from ..storage import written
from .pileups import TILE, base_sums, counts_at
from .stats import depth_of

OUTPUT = ("sample", "chrom", "pos", "ref", "A", "C", "G", "T", "N", "DP", "ALT_COUNT", "AF", "alt")


def recount(
    alignments: DataFrame, sites: DataFrame, sample: str, min_base_quality: int = 0,
    min_mapping_quality: int = 0, min_alt: int = 0,
) -> DataFrame:
    """sites: site_idx, chrom, pos0, ref, alt. A row for each site, repeated ones too, in OUTPUT columns and
    site_idx; sites that no read covers have zeros. Sites with fewer than min_alt alternative bases go.

    Bases are counted by tiles of the reference, as in a pileup, in the tiles that have sites; a tile's counts meet
    its sites and become rows of the sites alone.
    """
    tile = F.expr(f"pos0 div {TILE}")
    distinct = sites.select("chrom", "pos0").filter("pos0 >= 0").distinct()
    # a tile's sites are bounded by its positions
    wanted = distinct.groupBy(F.col("chrom").alias("contig"), tile.alias("tile")).agg(
        F.collect_list((F.col("pos0") % TILE).cast("int")).alias("places")
    )
    wanted = written(wanted, "site-tiles")
    reads = alignments.filter(
        passes(MASK_PILEUP)
        & ~has_flag("is_unmapped")
        & F.col("reference_name").isNotNull()
        & (F.col("reference_start") >= 0)
        & F.col("cigar").isNotNull()
        & (F.col("mapping_quality") >= min_mapping_quality)
    ).withColumn("contig", F.col("reference_name"))
    sums = base_sums(reads, 0, None, min_base_quality, True, wanted.select("contig", "tile"))
    counted = counts_at(sums, wanted).withColumnsRenamed({"contig": "chrom", "pos": "pos0"}).withColumn("depth", depth_of())
    joined = sites.join(counted, ["chrom", "pos0"], "left").na.fill(0, [*"ACGTN", "depth"])
    first = F.upper(F.substring("alt", 1, 1))
    alt = F.col("N")
    for letter in "ACGT":
        alt = F.when(first == letter, F.col(letter)).otherwise(alt)
    return (
        joined.withColumn("ALT_COUNT", F.when(F.length("alt") == 1, alt).otherwise(0))
        .withColumn("AF", allele_frequency(F.col("ALT_COUNT"), F.col("depth")))
        .select(
            "site_idx", F.lit(sample).alias("sample"), "chrom", (F.col("pos0") + 1).alias("pos"), "ref",
            *"ACGTN", F.col("depth").alias("DP"), "ALT_COUNT", "AF", "alt",
        )
        .filter(F.col("ALT_COUNT") >= min_alt)
    )


def tsv_line() -> Column:
    """The OUTPUT columns, tab-separated; AF with six decimals."""
    return F.concat_ws("\t", *[F.format_string("%.6f", "AF") if c == "AF" else F.col(c).cast("string") for c in OUTPUT])


def to_tsv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes the lines in site order behind one header, in parts that follow each other."""
    lines = rows.orderBy("site_idx").select(tsv_line().alias("value"))
    write_lines(lines, path, "\t".join(OUTPUT), mode)
