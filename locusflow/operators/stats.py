"""Region statistics: counts, depth, run-length blocks, coverage, pileups.

Each takes a DataFrame of alignments (any source) and a region, or the contigs of a header, and gives rows that do not
depend on how the alignments are partitioned. Positions without reads are filled with zeros. Work is keyed by contig and
tile throughout, so a genome of any number of contigs is one scan and one shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignments import MASK_ALL, MASK_PILEUP, has_flag, overlapping, passes, read_filter
from ..storage import written
from .pileups import TILE, base_sums, counts_at, depth_steps


def count(alignments: DataFrame, contig: str, start: int, stop: int, read_callback: str = "nofilter") -> DataFrame:
    """One row: the reads that overlap the region."""
    chosen = overlapping(alignments.filter(passes(read_filter(read_callback))), contig, start, stop)
    return chosen.agg(F.count("*").alias("count"))


class Scope(NamedTuple):
    """reads: unmasked mapped reads with a column contig; spans: the pieces of contigs (contig, start, stop) that are
    asked for, at most one of a contig; start, stop: bounds on all of them."""

    reads: DataFrame
    spans: DataFrame
    start: int
    stop: int | None


def _mapped(alignments: DataFrame, mask: int) -> DataFrame:
    mapped = ~has_flag("is_unmapped") & F.col("cigar").isNotNull() & (F.col("reference_start") >= 0)
    return alignments.filter(passes(mask) & mapped & F.col("reference_name").isNotNull()).withColumn(
        "contig", F.col("reference_name")
    )


def of_region(alignments: DataFrame, contig: str, start: int, stop: int, mask: int) -> Scope:
    """Reads that begin before the region's end; what of them lies in it is decided where their CIGARs are parsed."""
    near = (F.col("reference_name") == contig) & (F.col("reference_start") < stop) & F.lit(start < stop)
    row = alignments.sparkSession.range(1 if start < stop else 0)
    spans = row.select(F.lit(contig).alias("contig"), F.lit(start).cast("long").alias("start"), F.lit(stop).cast("long").alias("stop"))
    return Scope(_mapped(alignments.filter(near), mask), spans, start, stop)


def of_contigs(alignments: DataFrame, contigs: DataFrame, mask: int) -> Scope:
    """All reads, over whole contigs (name, length): one scan, whatever their number."""
    spans = contigs.filter("length > 0").select(
        F.col("name").alias("contig"), F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("stop")
    )
    return Scope(_mapped(alignments, mask), spans, 0, None)


def _tiles(spans: DataFrame) -> DataFrame:
    """Tiles of the spans, with the piece of the span in each: contig, tile, low, high."""
    every = F.explode(F.sequence(F.expr(f"start div {TILE}"), F.expr(f"(stop - 1) div {TILE}"))).alias("tile")
    return spans.select("*", every).select(
        "contig", "tile", F.greatest(F.col("start"), F.col("tile") * TILE).alias("low"),
        F.least(F.col("stop"), (F.col("tile") + 1) * TILE).alias("high"),
    )


def depth_runs(scope: Scope) -> DataFrame:
    """Runs of equal depth (contig, tile, start, stop, depth) that cover the spans, cut at tile borders.

    Each aligned run adds one at its start and takes one at its end, so rows follow runs, not bases. The
    running sum is taken in tiles, which need no row of their neighbours.
    """
    steps = depth_steps(scope.reads, scope.start, scope.stop)
    spans = F.broadcast(scope.spans)  # a header's dictionary
    steps = steps.join(spans, "contig").filter("pos >= start and pos < stop").select("contig", "tile", "pos", "d")
    borders = _tiles(scope.spans).select(
        "contig", "tile", F.explode(F.array("low", "high")).alias("pos"), F.lit(0).cast("long").alias("d")
    )
    order = Window.partitionBy("contig", "tile").orderBy("pos")
    summed = steps.unionByName(borders).groupBy("contig", "tile", "pos").agg(F.sum("d").alias("d"))
    level = summed.select(
        "contig",
        "tile",
        F.col("pos").alias("start"),
        F.lead("pos").over(order).alias("stop"),
        F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"),
    )
    return level.filter("stop is not null")


def _depth(scope: Scope) -> DataFrame:
    return depth_runs(scope).select("contig", F.explode(F.expr("sequence(start, stop - 1)")).alias("pos"), "depth")


def depth(alignments: DataFrame, contig: str, start: int, stop: int) -> DataFrame:
    """pos, depth of every position of the region."""
    return _depth(of_region(alignments, contig, start, stop, MASK_ALL)).drop("contig")


def depth_contigs(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig, pos, depth of every position of the contigs."""
    return _depth(of_contigs(alignments, contigs, MASK_ALL))


def _depth_blocks(scope: Scope) -> DataFrame:
    """Runs are merged in their tiles first; across tiles only each tile's first and last run matter, a row a
    tile, and chains of joined tiles take the start of the run that opens them.
    """
    order = Window.partitionBy("contig", "tile").orderBy("start")
    runs = depth_runs(scope)
    opens = F.when(F.col("depth") == F.lag("depth").over(order), 0).otherwise(1)
    whole = (
        runs.withColumn("opens", opens)
        .withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("contig", "tile", "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("depth").alias("depth"))
    )
    whole = written(whole, "runs")  # read for the edges and again for the runs
    edge = whole.groupBy("contig", "tile").agg(
        F.min_by("depth", "start").alias("first_depth"),
        F.max_by("depth", "start").alias("last_depth"),
        F.max("start").alias("last_start"),
        F.max("run").alias("runs"),
    )
    across = Window.partitionBy("contig").orderBy("tile")  # a row a tile, whatever the number of reads
    joined = F.coalesce(F.col("first_depth") == F.lag("last_depth").over(across), F.lit(False))
    chained = edge.withColumn("joined", joined).withColumn(
        "anchor", F.when((F.col("runs") > 1) | ~F.col("joined"), F.col("last_start"))
    )
    opened = F.last("anchor", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    heads = chained.select("contig", "tile", F.when(F.col("joined"), opened).alias("head"))
    return (
        whole.join(heads, ["contig", "tile"])
        .withColumn("begin", F.when(F.col("run") == 1, F.coalesce("head", "start")).otherwise(F.col("start")))
        .groupBy("contig", "begin")
        .agg(F.sum(F.col("stop") - F.col("start")).alias("length"), F.first("depth").alias("depth"))
        .withColumnRenamed("begin", "start")
    )


def depth_blocks(alignments: DataFrame, contig: str, start: int, stop: int) -> DataFrame:
    """start, length, depth of maximal runs of equal depth of the region, those of depth 0 included."""
    return _depth_blocks(of_region(alignments, contig, start, stop, MASK_ALL)).drop("contig")


def depth_blocks_contigs(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """The same over whole contigs: contig, start, length, depth."""
    return _depth_blocks(of_contigs(alignments, contigs, MASK_ALL))


def _counts(scope: Scope, min_quality: int, others: bool) -> DataFrame:
    """contig, pos, A, C, G, T, N of every position of the spans."""
    low, high = ((F.col(c) - F.col("tile") * TILE).cast("int") for c in ("low", "high"))
    wanted = _tiles(scope.spans).select("contig", "tile", F.sequence(low, high - 1).alias("places"))
    return counts_at(base_sums(scope.reads, scope.start, scope.stop, min_quality, others), wanted)


def count_coverage(
    alignments: DataFrame, contig: str, start: int, stop: int, quality_threshold: int = 15,
    read_callback: str = "all",
) -> DataFrame:
    """pos, A, C, G, T of every position of the region; other letters are not counted."""
    scope = of_region(alignments, contig, start, stop, read_filter(read_callback))
    return _counts(scope, quality_threshold, False).drop("contig", "N")


def count_coverage_contigs(
    alignments: DataFrame, contigs: DataFrame, quality_threshold: int = 15, read_callback: str = "all"
) -> DataFrame:
    """The same over whole contigs, with contig."""
    return _counts(of_contigs(alignments, contigs, read_filter(read_callback)), quality_threshold, False).drop("N")


def _pileup(scope: Scope, min_base_quality: int, min_mapping_quality: int) -> DataFrame:
    reads = scope.reads
    if min_mapping_quality > 0:
        reads = reads.filter(F.col("mapping_quality") >= min_mapping_quality)
    return _counts(scope._replace(reads=reads), min_base_quality, True).withColumn("depth", depth_of())


def pileup_counts(
    alignments: DataFrame, contig: str, start: int, stop: int, min_base_quality: int = 0,
    min_mapping_quality: int = 0, mask: int = MASK_PILEUP,
) -> DataFrame:
    """pos, A, C, G, T, N, depth of every position of the region; N is any other letter."""
    scope = of_region(alignments, contig, start, stop, mask)
    return _pileup(scope, min_base_quality, min_mapping_quality).drop("contig")


def pileup_counts_contigs(
    alignments: DataFrame, contigs: DataFrame, min_base_quality: int = 0, min_mapping_quality: int = 0,
    mask: int = MASK_PILEUP,
) -> DataFrame:
    """The same over whole contigs, with contig."""
    return _pileup(of_contigs(alignments, contigs, mask), min_base_quality, min_mapping_quality)


def depth_of() -> Column:
    return F.col("A") + F.col("C") + F.col("G") + F.col("T") + F.col("N")


def flag_summary(alignments: DataFrame) -> DataFrame:
    """One row: reads in all and by each flag."""
    from ..functions.alignments import FLAGS

    return alignments.agg(F.count("*").alias("total"), *[F.count_if(has_flag(f)).alias(f[3:] if f.startswith("is_") else f) for f in FLAGS])


def contig_summary(alignments: DataFrame) -> DataFrame:
    """Mapped and unmapped reads of each contig (and of none)."""
    return alignments.groupBy("reference_id", "reference_name").agg(
        F.count_if(~has_flag("is_unmapped")).alias("mapped"), F.count_if(has_flag("is_unmapped")).alias("unmapped")
    )
