"""Counts of runs and bases by position, summed in tiles of the reference.

Tasks parse the CIGARs of an Arrow batch together and sum what they count by position before anything is
shuffled; rows of sums, one for each tile and task, meet by tile and are added up as they stream by. So the
shuffle follows the positions that a task touches, not its bases, and a position that a third of all reads
cover is no more work than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runs import LETTERS, OTHER, Runs, Tally, aligned_runs, bases
from ..session import tune

BITS, KINDS = 14, 3  # bits of a position in its tile, and of a base's code
TILE = 1 << BITS
TILES = 200_000  # so many wanted tiles are sent to every task (16 bytes each), more are only joined
_PLACE = 36  # bits of a position; a task's number of the contig stands above them
_SUMS = "contig string, tile long, at array<int>, n array<long>"
_COUNTS = "contig string, pos long, A long, C long, G long, T long, N long"


def _numbered(names: dict[str, int], column: pa.Array) -> np.ndarray:
    """A number for each contig, in the order in which a task meets them."""
    coded = column.dictionary_encode()
    known = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)


def _rows(names: dict[str, int], keys: np.ndarray, sums: np.ndarray, kinds: int) -> pa.RecordBatch:
    """A row for each tile."""
    tiles = keys >> (BITS + kinds)
    first = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]])) if len(tiles) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
    every, head = list(names), tiles[first]
    at = pa.array((keys & ((1 << BITS + kinds) - 1)).astype(np.int32))
    return pa.record_batch(
        [
            pa.array([every[k] for k in (head >> (_PLACE - BITS)).tolist()], pa.string()),
            pa.array(head & ((1 << _PLACE - BITS) - 1)),
            pa.ListArray.from_arrays(offsets, at),
            pa.ListArray.from_arrays(offsets, pa.array(sums)),
        ],
        names=["contig", "tile", "at", "n"],
    )


def depth_steps(reads: DataFrame, start: int, stop: int | None) -> DataFrame:
    """reads: contig, reference_start, cigar. contig, tile, pos, d: by how much the depth changes at a position. A run
    that enters a tile from the left counts at the tile's border."""
    tune(reads.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        tally = Tally()
        for part in parts:
            runs = aligned_runs(part.column("cigar"), part.column("reference_start").to_numpy())
            runs = runs.within(start, (1 << _PLACE) - 1 if stop is None else stop)
            base = _numbered(names, part.column("contig"))[runs.row] << _PLACE
            high = runs.lo + runs.size
            inner = (high - 1 >> BITS) - (runs.lo >> BITS)  # borders that a run crosses
            k = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
            border = np.repeat((runs.lo >> BITS) + 1, inner) + k << BITS
            ends = high & (TILE - 1) != 0
            keys = np.concatenate([base + runs.lo, np.repeat(base, inner) + border, (base + high)[ends]])
            weights = np.ones(len(keys), np.int64)
            weights[len(keys) - ends.sum() :] = -1
            if (full := tally.add(keys, weights)) is not None:
                yield _rows(names, *full, 0)
        yield _rows(names, *tally.take(), 0)

    sums = reads.select("contig", "reference_start", "cigar").mapInArrow(run, _SUMS)
    each = sums.select("contig", "tile", F.inline(F.arrays_zip("at", "n")))
    return each.select("contig", "tile", (F.col("tile") * TILE + F.col("at")).alias("pos"), F.col("n").alias("d"))


def base_sums(
    reads: DataFrame, start: int, stop: int | None, min_quality: int, others: bool, tiles: DataFrame | None = None
) -> DataFrame:
    """reads: contig, reference_start, cigar, query_sequence, query_qualities. How often each base stands on a position
    of [start, stop), summed by the tasks: contig, tile, at (place in the tile and code), n. tiles (contig, tile, a
    written table): only bases in these are counted; if they are few, other runs are left out at once. Of reads that
    have quality_text too (SAM's text), that is read instead: a text takes less to send than a list."""
    spark = reads.sparkSession
    tune(spark)
    few = None
    if tiles is not None and tiles.count() <= TILES:
        wanted: dict[str, list[int]] = {}
        for r in tiles.collect():
            wanted.setdefault(r.contig, []).append(r.tile)
        few = spark.sparkContext.broadcast({c: np.array(sorted(x), np.int64) for c, x in wanted.items()})

    def near(runs: Runs, names: pa.Array) -> Runs:
        """Runs that touch a tile of theirs."""
        coded = names.dictionary_encode()
        of = coded.indices.to_numpy(zero_copy_only=False)[runs.row]
        keep = np.zeros(len(of), bool)
        for k, name in enumerate(coded.dictionary.to_pylist()):
            mine = np.flatnonzero(of == k)
            theirs = np.append(few.value.get(name, np.zeros(0, np.int64)), np.iinfo(np.int64).max)
            low, high = runs.lo[mine] >> BITS, runs.lo[mine] + runs.size[mine] - 1 >> BITS
            keep[mine] = theirs[np.searchsorted(theirs, low)] <= high
        return runs.take(keep)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        tally = Tally()
        for part in parts:
            runs = aligned_runs(part.column("cigar"), part.column("reference_start").to_numpy())
            runs = runs.within(start, (1 << _PLACE) - 1 if stop is None else stop)
            if few is not None:
                runs = near(runs, part.column("contig"))
            contigs = _numbered(names, part.column("contig")) << _PLACE
            for row, pos, code in bases(runs, part.column("query_sequence"), part.column("query_qualities"), min_quality):
                keys = contigs[row] + pos << KINDS | code
                if (full := tally.add(keys if others else keys[code < OTHER])) is not None:
                    yield _rows(names, *full, KINDS)
        yield _rows(names, *tally.take(), KINDS)

    quality = "quality_text" if "quality_text" in reads.columns else "query_qualities"
    columns = ("contig", "reference_start", "cigar", "query_sequence", F.col(quality).alias("query_qualities"))
    sums = reads.select(*columns).mapInArrow(run, _SUMS)
    return sums if tiles is None else sums.join(tiles, ["contig", "tile"], "left_semi")


def counts_at(sums: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: contig, tile, places (array<int>, positions in the tile). contig, pos, A, C, G, T, N of each wanted
    position, zeros where nothing was counted."""
    n = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = sums.withColumn("places", F.lit(None).cast("array<int>")).unionByName(
        wanted.selectExpr("contig", "tile", "cast(null as array<int>) as at", "cast(null as array<bigint>) as n", "places")
    )
    dealt = both.repartition(n, "contig", "tile").sortWithinPartitions("contig", "tile")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places = None, []
        counts = np.zeros(TILE << KINDS, np.int64)

        def finished() -> Iterator[pa.RecordBatch]:
            at = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
            if now is not None and len(at):
                table = counts.reshape(TILE, 1 << KINDS)[at]
                yield pa.record_batch(
                    [pa.array([now[0]] * len(at), pa.string()), pa.array((now[1] << BITS) + at)]
                    + [pa.array(table[:, k]) for k in range(OTHER + 1)],
                    names=["contig", "pos", *LETTERS, "N"],
                )

        for part in parts:
            at, n, wants = (part.column(x) for x in ("at", "n", "places"))
            for k, key in enumerate(zip(part.column("contig").to_pylist(), part.column("tile").to_pylist())):
                if key != now:
                    yield from finished()
                    now, places = key, []
                    counts[:] = 0
                if at[k].is_valid:
                    counts[at[k].values.to_numpy()] += n[k].values.to_numpy()  # places of one row differ
                if wants[k].is_valid:
                    places.append(wants[k].values.to_numpy())
        yield from finished()

    return dealt.mapInArrow(run, _COUNTS)
