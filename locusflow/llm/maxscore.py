"""Exact top-k inner products by MaxScore over integer vectors.

A dimension is a term; its postings are the components of all vectors of a shard. Over a shard each query
term has a least and a greatest contribution (its weight times the postings' least or greatest value).
Measured from the least, contributions are not negative, so terms sorted by the width of their bounds
split as in MaxScore: while the widths of the last terms together cannot lift a vector from the floor
over the k-th best score, those terms are non-essential. The essential postings are traversed for the
whole shard; vectors whose partial score plus what is left cannot reach the k-th best are dropped, the
others are probed term by term in blocks. The k best of every shard are merged.

A first round scores every query against SEEDS vectors: the k-th best of them is a bar that all shards
share, below which no vector can be among the k best. (Exact: the seeds only raise the bar.)

Rows are dealt into shards by a hash of their own number, queries into blocks; a task takes one shard and
one block, so its memory is bounded by CELLS and QUERIES. The vectors of a shard meet all queries, as the
result asks for: each is sent once for QUERIES queries, against which a shard's work is that of CELLS times
QUERIES multiplications. Ties go to the smaller id.

Defined results: null ids, null vectors and those with a null or non-finite component take no part; vectors are
compared with those of the same length only. Rows that repeat an id are rows of their own: each is a
candidate, and a query if its id is one's; a query never returns its own row. With fewer than k others, a
query has as many rows as there are. Scores are exact; one beyond 64 bits, or a component beyond them, is
an error. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

CELLS, QUERIES, PROBE = 1 << 21, 4096, 8
SEEDS = 2048
_RESULT = "query_row long, query_id long, vec_id long, score long"


def quantised(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, **more: Column
) -> DataFrame:
    """vec_id and q: floor(scale * x) of each component as array<long>; rows that take no part are gone. ``more``:
    further columns of the result."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))

    def whole(v: Column) -> Column:
        return F.when(F.abs(v * scale) < 2.0**63, F.floor(v * scale)).otherwise(
            F.raise_error(F.lit("a component is beyond 64 bits")).cast("long")
        )

    return vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(vec_id).cast("long").alias("vec_id"), *[c.alias(n) for n, c in more.items()], F.transform(x, whole).alias("q")
    )


def _score(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.assign(n=rows["q"].map(len)).sort_values("vec_id")
            queries = queries.assign(n=queries["q"].map(len))
            for n, part in queries.groupby("n"):
                same = rows[rows["n"] == n]
                if n and len(same):
                    out += _top(part, same, k)
        columns = zip(*out) if out else [[np.zeros(0, np.int64)]] * 4
        return pd.DataFrame(dict(zip(("query_row", "query_id", "vec_id", "score"), map(np.concatenate, columns))))

    return run


def _exact(*sides: np.ndarray) -> type:
    """The narrowest kind of numbers in which all inner products of the two sides' vectors are exact."""
    largest = sides[0].shape[1]
    for x in sides:
        largest *= max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return next((kind for kind, most in ((np.float32, 24), (np.float64, 53), (np.int64, 63)) if largest < 1 << most), object)


def _top(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[tuple[np.ndarray, ...]]:
    """queries: row, vec_id, q, bar; rows: row, vec_id, q, ascending by id; all vectors of one length."""
    ids, numbers = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
    matrix, asked = np.stack(rows["q"].to_list()), np.stack(queries["q"].to_list())
    kind = _exact(matrix, asked)
    postings = np.ascontiguousarray(matrix.T.astype(kind))  # a row for each term
    low, high = postings.min(1), postings.max(1)
    place = np.argsort(numbers)
    own = place[np.minimum(np.searchsorted(numbers, queries["row"].to_numpy(), sorter=place), len(place) - 1)]
    found = []
    for number, query_id, query, bar, mine in zip(
        queries["row"].to_numpy(), queries["vec_id"].to_numpy(), asked.astype(kind), queries["bar"], own.tolist()
    ):
        bar = -np.inf if bar is None or bar != bar else int(bar)
        floor, top = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
        width = top - floor
        order = np.argsort(-width, kind="stable")
        # non-essential: the longest tail of terms that cannot lift a vector from the floor to the bar
        rest = np.concatenate([np.cumsum(width[order][::-1])[::-1], [0]])
        total = floor.sum()
        essential = int(np.searchsorted(-rest, -(bar - total), side="right")) if bar > total else len(order)
        essential = max(1, min(essential, len(order)))
        at = order[:essential]
        score = query[at] @ postings[at]
        left = top[order[essential:]].sum()
        live = np.flatnonzero(score + left >= bar)
        score = score[live]
        for begin in range(essential, len(order), PROBE):
            at = order[begin : begin + PROBE]
            score = score + query[at] @ postings[np.ix_(at, live)]
            left = top[order[begin + PROBE :]].sum()
            keep = score + left >= bar
            if not keep.all():
                live, score = live[keep], score[keep]
        if numbers[mine] == number:
            keep = live != mine
            live, score = live[keep], score[keep]
        if len(live) > k:
            kth = np.partition(score, -k)[-k]
            keep = score >= kth
            live, score = live[keep], score[keep]
        best = np.argsort(-score, kind="stable")[:k]  # live ascends with the id
        if kind is object and any(abs(int(x)) >> 63 for x in score[best]):
            raise OverflowError("a score is beyond 64 bits")
        n = len(best)
        found.append((np.full(n, number), np.full(n, query_id), ids[live[best]], score[best].astype(np.int64)))
    return found


def _with_bars(asked: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Adds bar: the k-th best score of a query among the seeds, its own row left out; null if they are fewer."""
    spark = asked.sparkSession
    some = spark.sparkContext.broadcast(seeds.toPandas())  # at most SEEDS rows

    def run(parts):
        rows = some.value
        length = rows["q"].map(len)
        for part in parts:
            bars = np.full(len(part), None, object)
            sizes = part["q"].map(len).to_numpy()
            for n in np.unique(sizes):
                same = rows[length == n]
                at = np.flatnonzero(sizes == n)
                if not n or len(same) <= k:
                    continue
                matrix, queries = np.stack(same["q"].to_list()), np.stack(part["q"].iloc[at].to_list())
                kind = _exact(matrix, queries)
                postings, numbers = matrix.T.astype(kind), same["row"].to_numpy()
                for begin in range(0, len(at), 256):
                    some_at = at[begin : begin + 256]
                    scores = queries[begin : begin + 256].astype(kind) @ postings
                    mine = part["row"].to_numpy()[some_at][:, None] == numbers
                    # without its own row a query has one seed less: its k-th best is then the (k + 1)-th of all
                    for i, row, me in zip(some_at, scores, mine):
                        row = row[~me] if me.any() else row
                        bars[i] = int(np.partition(row, -k)[-k])
            yield part.assign(bar=pd.Series(bars, part.index, dtype=object))

    return asked.mapInPandas(run, "row long, vec_id long, q array<long>, bar decimal(38,0)")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """vectors: vec_id, q (array<long>). The k best other rows of each row that is_query selects: query_id,
    rank (from 1), vec_id, score."""
    rows = written(vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("_asks", is_query), "vectors")
    vectors = rows.select("row", "vec_id", "q")
    asked = rows.filter("_asks").select("row", "vec_id", "q")
    size = rows.agg(F.count("*").alias("n"), F.count_if("_asks").alias("m"), F.max(F.size("q")).alias("width")).first()
    per = max(1, CELLS // max(1, size.width or 1))
    shards, blocks = max(1, -(-size.n // per)), max(1, -(-size.m // QUERIES))
    seeds = vectors.orderBy(F.xxhash64("row"), "row").limit(max(SEEDS, 2 * k))
    asked = _with_bars(asked, seeds, k)
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    dealt = vectors.select(
        shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "row", "vec_id", "q"
    )
    queries = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), "row", "vec_id", "q",
        F.col("bar").cast("long").alias("bar"),
    )
    best = (
        queries.groupBy("shard", "block")
        .cogroup(dealt.groupBy("shard", "block"))
        .applyInPandas(_score(k), _RESULT)
    )
    rank = F.row_number().over(
        Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    )
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
