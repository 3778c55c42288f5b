"""Interval operators: merging, tiling, and joins of intervals with alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignments import overlapping, with_span
from ..storage import written

#: Bins of a level are 2^STEP times as wide as those of the level below; the highest level has one bin.
STEP, FINEST, HIGHEST = 3, 9, 36
SPREAD = 8  # rows of a region in all levels of bins, on average, that the finest level is chosen for
FEW, NARROW = 500_000, 32 << 20  # so many binned regions, of so many bytes, are broadcast; more are shuffled
STARTS = 16  # bits of a position in the tile that regions are merged in
TILE = 1_000_000


def fetch(alignments: DataFrame, contig: str, start: int, stop: int, keep_span: bool = False) -> DataFrame:
    """Reads that overlap a region, placed unmapped ones by their one base; with span_end, if that is to be kept."""
    found = overlapping(alignments, contig, start, stop)
    return found if keep_span else found.select(*alignments.columns)


def unplaced(alignments: DataFrame) -> DataFrame:
    return alignments.filter(F.col("reference_id") == -1)


def genomic_order(alignments: DataFrame, *ties: str) -> DataFrame:
    """By contig of the header, position and place in the file; unplaced reads last."""
    return alignments.orderBy(
        (F.col("reference_id") < 0).asc(), "reference_id", "reference_start", *(ties or ("file_offset",))
    )


def clamp_regions(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """regions (contig, start, stop) within the contigs' lengths; empty ones go. contigs: name, length."""
    c = F.broadcast(contigs.select(F.col("name").alias("contig"), "length"))  # a header's dictionary
    return (
        regions.join(c, "contig")
        .withColumns({"start": F.least("start", "length"), "stop": F.least("stop", "length")})
        .filter("start < stop")
        .drop("length")
    )


def merge_regions(regions: DataFrame) -> DataFrame:
    """Overlapping and touching regions of a contig become one.

    In two levels: regions are merged in tiles of their starts, of which there are at most 2^STARTS in a tile; then a
    row a tile tells how far the tiles before it reach and which merged region is open there.
    """
    inside = Window.partitionBy("contig", "tile").orderBy("start")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        regions.filter("start < stop")
        .groupBy("contig", F.col("start").cast("long").alias("start"))
        .agg(F.max(F.col("stop").cast("long")).alias("stop"))
        .withColumn("tile", F.shiftright("start", STARTS))
    )
    reach = F.max("stop").over(upto)
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    islands = (
        starts.withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("contig", "tile", "island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    islands = written(islands, "islands")
    before = Window.partitionBy("contig").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)  # a row a tile
    tiles = islands.groupBy("contig", "tile").agg(F.max("stop").alias("stop"), F.max("start").alias("last"))
    tiles = tiles.withColumn("reached", F.max("stop").over(before))
    # the last island of a tile opens a region unless the tiles before reach over it
    opened = F.when(F.col("reached").isNull() | (F.col("last") > F.col("reached")), F.col("last"))
    tiles = tiles.withColumn("open", F.last(opened, ignorenulls=True).over(before))
    apart = F.col("reached").isNull() | (F.col("start") > F.col("reached"))
    return (
        islands.join(tiles.select("contig", "tile", "reached", "open"), ["contig", "tile"])
        .groupBy("contig", F.when(apart, F.col("start")).otherwise(F.col("open")).alias("start"))
        .agg(F.max("stop").alias("stop"))
    )


def _ended(merged: DataFrame) -> DataFrame:
    """Merged regions with the end of the one before them on the contig (-1 before the first), tile by tile."""
    tiled = written(merged.withColumn("tile", F.shiftright("start", STARTS)), "merged")
    before = Window.partitionBy("contig").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)  # a row a tile
    tiles = tiled.groupBy("contig", "tile").agg(F.max("stop").alias("most")).withColumn("reached", F.max("most").over(before))
    inside = F.lag("stop").over(Window.partitionBy("contig", "tile").orderBy("start"))
    found = tiled.join(tiles.drop("most"), ["contig", "tile"])
    return found.withColumn("_ended", F.coalesce(inside, "reached", F.lit(-1))).drop("tile", "reached")


def tile_regions(regions: DataFrame, width: int = TILE) -> DataFrame:
    """Consecutive pieces of at most ``width``; regions without length have none."""
    if width < 1:
        raise ValueError("width must be positive")
    starts = F.explode(F.expr(f"sequence(start, stop - 1, {width}L)")).alias("low")
    return (
        regions.filter("start < stop")
        .withColumns({"start": F.col("start").cast("long"), "stop": F.col("stop").cast("long")})
        .select("*", starts)
        .withColumns({"stop": F.least(F.col("stop"), F.col("low") + width), "start": F.col("low")})
        .drop("low")
    )


def chunk_width(length: int, threads: int, per_thread: int) -> int:
    """Width that cuts a length into threads * per_thread pieces."""
    return max(1, -(-length // max(1, threads * per_thread)))


def contig_windows(contigs: DataFrame, width: int = TILE) -> DataFrame:
    """Windows over whole contigs (name, length, reference_id), those without length left out."""
    every = contigs.select(
        "reference_id", F.col("name").alias("contig"), F.lit(0).cast("long").alias("start"),
        F.col("length").cast("long").alias("stop"),
    )
    return tile_regions(every, width)


def _levels(finest: int) -> list[int]:
    return [*range(finest, HIGHEST, STEP), HIGHEST]


def _bin(level: Column, number: Column) -> Column:
    return F.shiftleft(level.cast("long"), 48).bitwiseOR(number)


def smallest_bin(start: Column, stop: Column, finest: int) -> Column:
    """The number of the smallest bin that holds [start, stop)."""
    found = F.lit(None).cast("long")
    for shift in reversed(_levels(finest)):
        low = F.shiftright(start, shift)
        found = F.when(low == F.shiftright(stop - 1, shift), _bin(F.lit(shift), low)).otherwise(found)
    return found


def met_bins(start: Column, stop: Column, finest: int) -> Column:
    """Numbers of all bins, of every level, that [start, stop) meets."""

    def of_level(shift: int) -> Column:
        numbers = F.sequence(F.shiftright(start, shift), F.shiftright(stop - 1, shift))
        return F.transform(numbers, lambda k: _bin(F.lit(shift), k))

    return F.concat(*map(of_level, _levels(finest)))


def _width(rows: DataFrame) -> Column:
    """About how many bytes a row takes; very many, if it holds what has no simple size."""
    plain = 16 * len(rows.columns)
    if any(kind.startswith(("array", "map", "struct", "variant")) for _, kind in rows.dtypes):
        return F.lit(1 << 40)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in rows.dtypes if kind in ("string", "binary")]
    return sum(texts, F.lit(plain)).cast("long")


def overlap_join(alignments: DataFrame, regions: DataFrame, finest: int | None = None) -> DataFrame:
    """Alignments with each region (contig, start, stop, others) that they overlap.

    Bins are nested. A read has one row, with the smallest bin that holds it; a region has a row for each bin that it
    meets in each level. They meet on (contig, bin), an equi-join that Spark can shuffle and split, and a pair in one
    bin only. So a read is never repeated, however long it is. The finest bins (2^finest wide) are the narrowest with
    which regions have about SPREAD rows on average. Regions are written and counted: few are broadcast, many are
    shuffled (many or wide ones), and reads are never the broadcast side. Region columns named like alignment columns must be renamed before.
    """
    whole = [F.col(c).cast("long").alias(c) if c in ("start", "stop") else F.col(c) for c in regions.columns]
    regions = written(regions.filter("start < stop").select(*whole), "regions")
    size = regions.agg(
        F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("length"), F.max(_width(regions)).alias("width")
    ).first()
    length = int(size.length or 0)
    if finest is None:
        finest = max(FINEST, (length // (SPREAD * size.n + FEW // SPREAD)).bit_length())
    reads = with_span(alignments.filter((F.col("reference_start") >= 0) & (F.col("reference_id") >= 0)))
    binned = reads.withColumn("_bin", smallest_bin(F.col("reference_start"), F.col("span_end"), finest))
    spread = regions.withColumn("_rbin", F.explode(met_bins(F.col("start"), F.col("stop"), finest)))
    rows = 2 * len(_levels(finest)) * size.n + 2 * (length >> finest)  # at most
    few = rows <= FEW and rows * (size.width or 0) <= NARROW
    spread = F.broadcast(spread) if few else spread.hint("merge")
    meets = (
        (F.col("reference_name") == F.col("contig"))
        & (F.col("_bin") == F.col("_rbin"))
        & (F.col("reference_start") < F.col("stop"))
        & (F.col("span_end") > F.col("start"))
    )
    joined = binned.join(spread, meets)
    return joined.select(*alignments.columns, *[c for c in regions.columns])


def overlapping_any(alignments: DataFrame, regions: DataFrame, finest: int | None = None) -> DataFrame:
    """Reads that overlap at least one region, once each (a semi-join).

    Merged regions do not touch, so the first that a read meets is the one whose predecessor ends at or
    before the read's start: that one owns the read, and no distinct is needed.
    """
    merged = _ended(merge_regions(regions.select("contig", "start", "stop")))
    joined = overlap_join(alignments, merged, finest)
    return joined.filter(F.col("_ended") <= F.col("reference_start")).drop("contig", "start", "stop", "_ended")


def multi_fetch(alignments: DataFrame, regions: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Reads of several regions: regions are clamped and merged, and a read comes once for each merged
    region that it overlaps. Equal rows of the input are kept."""
    if contigs is not None:
        regions = clamp_regions(regions, contigs)
    merged = merge_regions(regions.select("contig", "start", "stop"))
    return overlap_join(alignments, merged).withColumnsRenamed(
        {"contig": "region_contig", "start": "region_start", "stop": "region_stop"}
    )


def batches(alignments: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds ``batch``: the number of the fixed-size batch a row falls into, in a total order.

    Row numbers come from one pass over range-sorted partitions: rows of each partition are counted and
    numbered from the sum of those before.
    """
    size = max(1, size)
    spark = alignments.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = alignments.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = written(
        dealt.withColumn("_part", F.spark_partition_id()).withColumn(
            "_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        ),
        "numbered",
    )
    sizes = numbered.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row a partition
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn("batch", F.floor((F.col("_before") + F.col("_row")) / size).cast("long"))
        .drop("_part", "_row", "_before")
    )
