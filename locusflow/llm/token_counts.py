"""Token counts of documents in flat, unindexed token files.

A flat file is a run of fixed-width ids in which a separator id ends each document; nothing says where
documents begin. Files are cut into blocks of any alignment. A task finds all separators of a block with
one vectorised comparison and returns a row for the block: its tokens, its separators, and the lengths
between them. A prefix scan over the blocks of each file (running sums, and the running maximum of the
last separator's position) tells how many documents came before a block and how many tokens of the
document that is open at its start, which stitches documents that span blocks.

Tokens behind a file's last separator are a document with ``ended`` = false. Empty files have none. Texts may be of
any length (a null one counts as empty); rows that repeat are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._chunks import TextEncoder, grouped
from ._files import make_dir, place
from ._shared import new_path, partitions, tune, written

BLOCK = 1 << 21  # tokens
FILE = 1 << 25  # tokens after which a writer begins another file


def write_flat_files(
    documents: DataFrame, encoder: Callable[[], TextEncoder], separator: int, folder: str
) -> DataFrame:
    """Encodes every text (null: empty) into flat files of 16-bit ids, wherever its row is read. The
    manifest, a written table: file (its number), ordinal and doc_id of each document, and bytes (of the
    file so far). ``path_of`` gives a file's path; one that a lost task leaves behind is in no manifest."""
    spark = documents.sparkSession
    tune(spark)
    make_dir(folder)
    stop = separator.to_bytes(2, "little")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sink = None
        file = count = size = 0
        try:
            for part in grouped(parts):
                if sink is None or size >= 2 * FILE:
                    if sink is not None:
                        sink.close()
                    file, count, size = uuid.uuid4().int >> 65, 0, 0
                    system, name = place(f"{folder}/{file:016x}.bin")
                    sink, coder = system.open_output_stream(name), encoder()
                packed = stop.join([*coder.encode_array(part.column("text").fill_null("")).to_pylist(), b""])
                sink.write(packed)
                size += len(packed)
                n = part.num_rows
                yield pa.record_batch(
                    [
                        pa.array([file] * n, pa.int64()),
                        pa.array(range(count, count + n), pa.int64()),
                        part.column("doc_id"),
                        pa.array([size] * n, pa.int64()),
                    ],
                    names=["file", "ordinal", "doc_id", "bytes"],
                )
                count += n
        finally:
            if sink is not None:
                sink.close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(
        rows.mapInArrow(run, "file long, ordinal long, doc_id long, bytes long"), "flat-manifest"
    )


def path_of(file: Column, folder: str) -> Column:
    return F.format_string(folder.replace("%", "%%") + "/%016x.bin", file)


def scan_separators(files: DataFrame, separator: int, block: int = BLOCK, width: int = 2) -> DataFrame:
    """files: file (a number of its own), path, bytes. A row for each document: file, ordinal in it, n_tokens
    (without the separator), ended."""
    spark: SparkSession = files.sparkSession
    tune(spark)
    step = block * width
    blocks = (
        files.filter("bytes > 0")
        .select("file", "path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {step}L)")).alias("at"))
        .select("file", "path", (F.col("at") / step).cast("long").alias("block"), "at",
                F.least(F.lit(step), F.col("bytes") - F.col("at")).cast("long").alias("size"))
        .repartition(partitions(spark), "file", "block")
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                system, name = place(row["path"])
                with system.open_input_file(name) as source:
                    ids = np.frombuffer(source.read_at(row["size"], row["at"]), f"<u{width}")
                found = np.flatnonzero(ids == separator)
                lengths = np.diff(found, prepend=-1) - 1
                tail = len(ids) - 1 - (found[-1] if len(found) else -1)
                yield pa.record_batch(
                    [
                        pa.array([row["file"]], pa.int64()),
                        pa.array([row["block"]], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([int(tail)], pa.int64()),
                        pa.array([lengths.astype(np.int64)], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "tokens", "tail", "lengths"],
                )

    scanned = written(
        blocks.mapInArrow(run, "file long, block long, tokens long, tail long, lengths array<long>"), "separators"
    )
    # the separators themselves are tokens of the stream: positions count them
    seen = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    narrow = (  # a short row a block: a file of a terabyte has 250,000
        scanned.select("file", "block", "tokens", "tail", F.size("lengths").cast("long").alias("n"))
        .withColumn("before", F.coalesce(F.sum("tokens").over(seen), F.lit(0)))
        .withColumn("done", F.coalesce(F.sum("n").over(seen), F.lit(0)))
        .withColumn("last", F.when(F.col("n") > 0, F.col("before") + F.col("tokens") - F.col("tail") - 1))
        .withColumn("open", F.col("before") - F.coalesce(F.max("last").over(seen), F.lit(-1)) - 1)
        .withColumn("end", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
        .withColumn("rest", F.col("before") + F.col("tokens") - F.coalesce(F.max("last").over(upto), F.lit(-1)) - 1)
    )
    placed = scanned.select("file", "block", "lengths").join(
        narrow.select("file", "block", "done", "open", "end", "rest").hint("merge"), ["file", "block"]
    )
    every = F.concat(
        F.transform(
            "lengths",
            lambda x, i: F.struct(
                F.when(i == 0, x + F.col("open")).otherwise(x).alias("n_tokens"), F.lit(True).alias("ended")
            ),
        ),
        F.when(
            F.col("end") & (F.col("rest") > 0),
            F.array(F.struct(F.col("rest").alias("n_tokens"), F.lit(False).alias("ended"))),
        ).otherwise(F.expr("cast(array() as array<struct<n_tokens:bigint,ended:boolean>>)")),
    )
    return placed.select("file", "done", F.posexplode(every).alias("k", "d")).select(
        "file",
        (F.col("done") + F.col("k")).alias("ordinal"),
        F.col("d.n_tokens").alias("n_tokens"),
        F.col("d.ended").alias("ended"),
    )


def count_tokens(documents: DataFrame, encoder: Callable[[], TextEncoder], separator: int) -> DataFrame:
    """doc_id and n_tokens (without the separator) of every document, counted in flat files that are
    written for them. Rows with equal or null ids keep their own counts; other columns are not looked at."""
    folder = new_path(documents.sparkSession, "flat-files")
    manifest = write_flat_files(documents, encoder, separator, folder)
    files = manifest.groupBy("file").agg(F.max("bytes").alias("bytes")).withColumn("path", path_of(F.col("file"), folder))
    counts = scan_separators(files, separator)
    # both sides have a row for each document: neither is ever broadcast
    return manifest.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
