"""Range partitions with known bounds, each of which also sees the first row of the next; prefix sums.

Rows are ordered by id and, where ids are equal or null, by a hash of the text: an id that many rows share is
cut by that hash, so that it can span ranges.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions, written

LEAST = -(1 << 63)  # the key of a null id: it comes first

Bound = tuple[int, int]  # id and hash of the first row that can be in a range


def key_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LEAST))


def bounds_of(df: DataFrame, name: str, n: int) -> list[Bound]:
    """At most n - 1 ascending bounds that cut the rows into ranges of about equal counts. Reads only the
    id column; a key at several quantiles is cut into as many equal ranges of hashes."""
    if n < 2:
        return []
    cuts = [k / n for k in range(1, n)]
    got = df.select(key_of(name).alias("k")).agg(F.percentile_approx("k", cuts, 10_000)).first()[0]
    times = Counter(got or [])
    return [(v, LEAST + k * ((1 << 64) // m)) for v, m in sorted(times.items()) for k in range(m)]


def range_of(key: Column, mark: Column, bounds: list[Bound]) -> Column:
    """How many bounds are not above a row: two short searches, whatever the number of bounds."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    blocks = [bounds[k : k + width] for k in range(0, len(bounds), width)]

    def made(x: Bound) -> Column:
        return F.struct(F.lit(x[0]).cast("long").alias("k"), F.lit(x[1]).cast("long").alias("m"))

    row = F.struct(key.alias("k"), mark.alias("m"))
    heads = F.array(*[made(x[0]) for x in blocks])
    rows = F.array(*[F.array(*map(made, x)) for x in blocks])
    block = F.size(F.filter(heads, lambda x: x <= row))
    inside = F.size(F.filter(F.element_at(rows, F.greatest(block, F.lit(1))), lambda x: x <= row))
    return F.when(block == 0, 0).otherwise((block - 1) * width + inside).cast("int")


def in_ranges(df: DataFrame, name: str, text: str, guests: bool = False) -> DataFrame:
    """df dealt into range partitions by an id, and by a hash of a text where ids are equal, and sorted in each.
    Adds ``_range`` and ``_guest``.

    With guests, the first row of each following non-empty range (after the last: of the first) also
    comes to the end of a partition, marked ``_guest`` = 1. One shuffle; equal rows stay in one partition.
    """
    spark = df.sparkSession
    n = partitions(spark)
    bounds = bounds_of(df, name, n)
    dealt = df.withColumns({"_key": key_of(name), "_mark": F.xxhash64(text)})
    dealt = dealt.withColumn("_range", range_of(F.col("_key"), F.col("_mark"), bounds))
    if guests:
        least = sorted(
            (r[0], *r[1]) for r in dealt.groupBy("_range").agg(F.min(F.struct("_key", "_mark"))).collect()
        )  # a row a range
        before = [(*first, least[i - 1][0]) for i, (_, *first) in enumerate(least)]
        firsts = spark.createDataFrame(before or [(0, 0, -1)], "_first long, _fmark long, _before int")
        dealt = (
            dealt.join(F.broadcast(firsts), (F.col("_key") == F.col("_first")) & (F.col("_mark") == F.col("_fmark")), "left")
            .withColumn(
                "_to",
                F.explode(
                    F.filter(
                        F.array(
                            F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")),
                            F.struct(F.col("_before").alias("r"), F.lit(1).alias("g")),
                        ),
                        lambda x: x["r"].isNotNull(),
                    )
                ),
            )
            .withColumns({"_range": F.col("_to.r"), "_guest": F.col("_to.g")})
            .drop("_to", "_first", "_fmark", "_before")
        )
    else:
        dealt = dealt.withColumn("_guest", F.lit(0))
    return dealt.repartitionById(max(n, len(bounds) + 1), F.col("_range")).sortWithinPartitions(
        "_guest", "_key", "_mark", text
    ).drop("_key", "_mark")


def running(df: DataFrame, order: list[Column], drop: tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """df with the sum of each of the given columns over all rows before it, by ascending ``order``. Columns to
    drop go once the rows are sorted.

    Rows are range-sorted and summed in their partitions; sums of whole partitions, a row each, come on top.
    """
    spark = df.sparkSession
    keys = {f"_k{k}": c for k, c in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop(*keys, *drop)
    placed = written(
        dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "sorted"
    )
    whole = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = whole.select("_part", *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return (
        placed.withColumns({n: F.coalesce(F.sum(c).over(inside), zero) for n, c in sums.items()})
        .join(F.broadcast(offsets), "_part")
        .withColumns({n: F.col(n) + F.coalesce(F.col(f"_{n}"), zero) for n in sums})
        .drop("_part", "_row", *[f"_{n}" for n in sums])
    )
