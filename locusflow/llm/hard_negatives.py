"""Hard negatives by product quantisation with stored residual norms.

A vector is cut into parts of PART components; each part is stored as the number of its nearest centroid, and the
whole with the norm of what the centroids leave over. For an anchor a, a table holds the inner product of each part of
a with each centroid, so a vector's score is a sum of table entries, and lies within |a| times its residual norm of
that sum. Vectors whose bounds cannot reach a window are left out; the others are scored in whole numbers, so the
result is exact whatever the centroids are. They are fitted (k-means) on at most SAMPLE vectors, chosen by a hash;
every vector is indexed. Vectors of a length that the sample lacks have no centroids: their residual is the vector.

Two passes over the index: the anchor's best rows of its own label (positives), then, for each positive, the best rows
of other labels whose score is between two shares of the positive's. Index rows are dealt into shards by a hash of
their own number and anchors into blocks, so a task is bounded by CELLS and ANCHORS; a shard's best are merged by a
window over an anchor. Of equal vectors of one label only as many as a window can hold are indexed, those of the least
ids: they tie, so the others cannot be among the first. That bounds what a group of copies sends on.

Defined results: rows without id or label, null vectors and those with a null or non-finite component take no part;
vectors meet those of the same length only. Repeated ids are rows of their own, each an anchor if its id is one's, and
never its own positive. Ties go to the smaller id. Fewer rows than asked for are returned as they are; a negative
positive score has no window. A score beyond 64 bits is an error. An empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import tune, written
from .maxscore import _exact

PART, CENTROIDS, ROUNDS = 2, 256, 8
SAMPLE, SAMPLE_CELLS = 4096, 1 << 20
CELLS, ANCHORS = 1 << 22, 512

Codebook = list[np.ndarray]  # the centroids of each part


def fit(vectors: np.ndarray) -> Codebook:
    """Centroids of each part by k-means; as many as there are vectors, at most CENTROIDS."""
    rng = np.random.default_rng(1)
    start = vectors[rng.permutation(len(vectors))[:CENTROIDS]]
    out = []
    for k in range(0, vectors.shape[1], PART):
        part, centroids = vectors[:, k : k + PART], start[:, k : k + PART].copy()
        for _ in range(ROUNDS):
            nearest = _nearest(part, centroids)
            counts = np.bincount(nearest, minlength=len(centroids))
            used = counts > 0
            for c in range(part.shape[1]):
                sums = np.bincount(nearest, part[:, c], len(centroids))
                centroids[used, c] = sums[used] / counts[used]
        out.append(centroids)
    return out


def _nearest(part: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * part @ centroids.T, axis=1)


def _codebook(books: dict[int, Codebook], n: int) -> Codebook:
    """That of a length; one centroid at nought for a length that was not fitted."""
    return books.get(n) or [np.zeros((1, min(PART, n - k))) for k in range(0, n, PART)]


def encode(vectors: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Centroid numbers (a row a vector) and margins: an inner product with a differs from its table sum by at most
    |a| times the margin. Margins hold the residual's norm, and what sums of doubles may lose."""
    plain = vectors.astype(np.float64)
    codes = np.empty((len(plain), len(book)), np.uint8)
    residual = np.zeros(len(plain))
    for m, centroids in enumerate(book):
        part = plain[:, m * PART : m * PART + centroids.shape[1]]
        codes[:, m] = _nearest(part, centroids)
        residual += ((part - centroids[codes[:, m]]) ** 2).sum(1)
    norm = np.sqrt(residual)
    return codes, norm + 1e-9 * (norm + np.sqrt((plain**2).sum(1)))


def table_sums(anchor: np.ndarray, codes: np.ndarray, book: Codebook) -> np.ndarray:
    """codes: a row a part."""
    plain, total = anchor.astype(np.float64), np.zeros(codes.shape[1])
    for m, centroids in enumerate(book):
        total += (centroids @ plain[m * PART : m * PART + centroids.shape[1]])[codes[m]]
    return total


def _packed(vector: np.ndarray) -> bytes:
    """The narrowest little-endian whole numbers that hold a vector."""
    low, high = int(vector.min()), int(vector.max())
    return vector.astype(next(f"<i{k}" for k in (2, 4, 8) if -(1 << 8 * k - 1) <= low and high < 1 << 8 * k - 1)).tobytes()


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    values = column.to_pylist()
    out = np.empty((len(values), n), np.int64)
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(values[k] for k in at), f"<i{size // n}").reshape(-1, n)
    return out


class _Shard:
    """The index rows of a group."""

    def __init__(self, rows: pa.Table, books: dict[int, Codebook]) -> None:
        rows = rows.sort_by("vec_id")
        self.n = rows["n"][0].as_py()
        self.row, self.id, self.label, self.margin = (rows[c].to_numpy() for c in ("row", "vec_id", "label", "margin"))
        self.vectors, self.book = _matrix(rows["packed"], self.n), _codebook(books, self.n)
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(rows), -1)
        self.codes = np.ascontiguousarray(codes.T).astype(np.intp)

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = table_sums(anchor, self.codes, self.book)
        slack = self.margin * np.sqrt((anchor.astype(np.float64) ** 2).sum())
        return score - slack, score + slack

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        chosen = self.vectors[at]
        kind = _exact(chosen, anchor[None, :])
        found = chosen.astype(kind) @ anchor.astype(kind)
        if kind is object and any(int(x) + (1 << 63) >> 64 for x in found):
            raise OverflowError("a score is beyond 64 bits")
        return found.astype(np.int64)

    def best(self, anchor: np.ndarray, at: np.ndarray, low: float, high: float, k: int, bounds) -> list[tuple[int, int]]:
        """The k best (id, score) of the rows ``at`` with a score from low to high."""
        lower, upper = bounds[0][at], bounds[1][at]
        sure = lower[(lower >= low) & (upper <= high)]
        bar = max(low, np.partition(sure, -k)[-k]) if len(sure) > k else low
        at = at[(upper >= bar) & (lower <= high)]
        score = self.scores(anchor, at)
        inside = (score >= low) & (score <= high)
        at, score = at[inside], score[inside]
        order = np.argsort(-score, kind="stable")[:k]  # rows ascend with the id
        return list(zip(self.id[at[order]].tolist(), score[order].tolist()))


def _anchors(table: pa.Table, n: int) -> Iterator[tuple[dict, np.ndarray]]:
    vectors = _matrix(table["packed"], n)
    for row, vector in zip(table.drop_columns(["packed"]).to_pylist(), vectors):
        yield row, vector


_FOUND = "row long, at int, vec_id long, score long"


def _result(found: list[tuple]) -> pa.Table:
    names, kinds = ("row", "at", "vec_id", "score"), (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    columns = zip(*found) if found else ([],) * 4
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def _positives(books, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if len(anchors) and len(rows):
            shard = _Shard(rows, books.value)
            for a, vector in _anchors(anchors, shard.n):
                at = np.flatnonzero((shard.label == a["label"]) & (shard.row != a["row"]))
                best = shard.best(vector, at, -np.inf, np.inf, k, shard.bounds(vector))
                found += [(a["row"], 0, i, s) for i, s in best]
        return _result(found)

    return run


def _negatives(books, k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if len(anchors) and len(rows):
            shard = _Shard(rows, books.value)
            for a, vector in _anchors(anchors, shard.n):
                at, bounds = np.flatnonzero(shard.label != a["label"]), shard.bounds(vector)
                for p in a["positives"]:
                    least, most = -(-low * p["score"] // 100), high * p["score"] // 100
                    if least <= most:
                        best = shard.best(vector, at, least, most, k, bounds)
                        found += [(a["row"], p["rank"], i, s) for i, s in best]
        return _result(found)

    return run


def _index(rows: DataFrame) -> tuple[DataFrame, dict[int, Codebook]]:
    """The rows with codes, margin and the packed vector; the codebooks, by length."""
    width = rows.agg(F.max("n")).first()[0] or 1
    some = max(1, min(SAMPLE, SAMPLE_CELLS // width))
    sample = [r.q for r in rows.select("row", "q").orderBy(F.xxhash64("row"), "row").limit(some).collect()]
    books = {n: fit(np.array([q for q in sample if len(q) == n], np.float64)) for n in {len(q) for q in sample}}
    shared = rows.sparkSession.sparkContext.broadcast(books)  # at most CENTROIDS times width numbers a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, values = batch["n"].to_numpy(), batch["q"].flatten().to_numpy()
            ends = np.cumsum(sizes)
            codes, packed, margin = [b""] * len(sizes), [b""] * len(sizes), np.zeros(len(sizes))
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                vectors = values[(ends[at] - n)[:, None] + np.arange(n)]
                found, margin[at] = encode(vectors, _codebook(shared.value, n))
                for k, c, v in zip(at.tolist(), found, vectors):
                    codes[k], packed[k] = c.tobytes(), _packed(v)
            kept = [batch[c] for c in ("row", "vec_id", "label", "n")]
            more = [pa.array(codes, pa.binary()), pa.array(margin), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(kept + more, ["row", "vec_id", "label", "n", "codes", "margin", "packed"])

    form = "row long, vec_id long, label long, n int, codes binary, margin double, packed binary"
    return rows.select("row", "vec_id", "label", "n", "q").mapInArrow(run, form), books


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """vectors: vec_id, label, q (array<long>). For each row that is_anchor selects and each of its ``positives`` best
    other rows of its label: the ``negatives`` best rows of other labels, with low to high hundredths of the positive's
    score. Columns anchor_id, positive_id, positive_rank, rank (from 1), negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    tune(spark)
    n = F.size("q").alias("n")
    rows = vectors.filter(F.col("label").isNotNull() & (F.size("q") > 0)).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"), n, "q",
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = written(rows, "vectors")
    copies = F.row_number().over(Window.partitionBy("label", "q").orderBy("vec_id", "row"))
    first = rows.withColumn("copy", copies).filter(F.col("copy") <= max(negatives, positives + 1))
    index, books = _index(written(first.drop("copy", "asks"), "vectors"))
    index = written(index, "index")
    coded = spark.sparkContext.broadcast(books)
    size = index.agg(F.count("*").alias("rows"), F.max("n").alias("width")).first()
    asked = rows.filter("asks")
    shards = max(1, -(-size.rows // max(1, CELLS // (size.width or 1))))
    blocks = max(1, -(-asked.count() // ANCHORS))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array([_packed(np.array(q, np.int64)) for q in batch["q"].to_pylist()], pa.binary())
            kept = [batch[c] for c in ("row", "vec_id", "label", "n")]
            yield pa.RecordBatch.from_arrays([*kept, vectors], ["row", "vec_id", "label", "n", "packed"])

    anchors = written(
        asked.select("row", "vec_id", "label", "n", "q").mapInArrow(packed, "row long, vec_id long, label long, n int, packed binary"),
        "anchors",
    )

    def meet(asking: DataFrame, best) -> DataFrame:
        left = asking.withColumn("block", block).withColumn("shard", every(shards))
        right = index.withColumn("shard", shard).withColumn("block", every(blocks))
        keys = "shard", "block", "n"
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, _FOUND)

    def first_of(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("row", "at").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found = first_of(meet(anchors.select("row", "label", "n", "packed"), _positives(coded, positives)), positives)
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    asking = written(anchors.join(found, "row"), "positives")
    hard = meet(asking.select("row", "label", "n", "packed", "positives"), _negatives(coded, negatives, low, high))
    hard = first_of(hard, negatives)
    of = asking.select("row", F.col("vec_id").alias("anchor_id"), F.inline("positives")).select(
        "row", "anchor_id", F.col("rank").alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return of.join(hard, ["row", "at"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"), F.col("at").alias("positive_rank"),
    )
