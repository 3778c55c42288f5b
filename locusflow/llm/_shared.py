"""What the operators of this subpackage share: the cluster's shared folder, written
intermediate tables, and broadcasts behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..storage import clean, new_path, shared_dir, written

__all__ = ["clean", "new_path", "partitions", "shared_dir", "small", "tune", "written"]

#: Rows of one Arrow batch sent to Python: long texts stay within a worker's memory.
BATCH_ROWS = 2000
#: Most rows and bytes of a table that is broadcast; beyond either the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32 << 20


def tune(spark: SparkSession) -> None:
    session.tune(spark, BATCH_ROWS)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if it has at most so many rows and, about, so many bytes."""
    lengths = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    width = sum(lengths, F.lit(16 * len(df.columns)))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return F.broadcast(df) if found.n <= rows and (found.bytes or 0) <= size else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
