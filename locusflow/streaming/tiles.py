"""Read counts by genomic tile over a stream of alignment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.alignments import passes


def stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Parquet alignments as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def tile_counts(alignments: DataFrame, width: int = 1_000_000, mask: int = 0) -> DataFrame:
    """Reads that start in each tile so far (output mode "complete" or "update"); batch or stream. State is
    a row a tile, so it is bounded by the genome."""
    placed = alignments.filter((F.col("reference_start") >= 0) & passes(mask))
    return placed.groupBy(
        F.col("reference_name").alias("contig"), (F.expr(f"reference_start div {width}") * width).alias("start")
    ).agg(F.count("*").alias("reads"))
