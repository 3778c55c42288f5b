"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features of a text are its lower-cased words and the prefixes of PREFIXES letters of them, hashed; the
value of a feature is ln(1 + occurrences per hundred chunks between white space), so that a text's length does
not speak. One weight vector w serves all ordered thresholds
b1 < b2 < b3: P(grade >= k) = sigmoid(w.x - bk). The expected severity is the sum of these over k. A
document is rejected when P(grade >= 1) reaches ``cutoff``.

Fitting takes a bounded sample, SAMPLE labelled documents of each class by a hash of their id; its
examples are weighted back to the classes' shares. Features that occur with the two classes alike (G2
test) are left out; as each needs a share of a class's documents, their number is bounded by the sample's.
Labels are 0 or 1; documents labelled 1 are graded 1 to 3 by terciles of the share of their chunks (between
white space) that hold a feature that speaks for toxicity, whatever their length.

Defined results: null and empty texts have no features; texts of any length are read whole. An empty table gives no
rows. Only labels of documents that are there count. Null labels do not count, of several labels of a
document the greatest does. Rows that repeat are scored each. Without labels of both classes no document is rejected, and severities are 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._chunks import Memo
from ._shared import partitions, tune, written
from ._words import batches, words_of

SAMPLE, GRADES = 6000, 4
PREFIXES = (4, 5, 6)
#: A feature needs so many documents, this share of a class's documents, and this G2. The share keeps
#: out what only a group of near copies says.
LEAST, SHARE, EVIDENCE = 3, 0.01, 15.0
CUTOFF = 0.5
STEPS, PENALTY = 1000, 1e-5


def features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-cased word and of its prefixes."""
    names = ["=" + word] + ["^" + word[:n] for n in PREFIXES if len(word) >= n]
    return tuple(crc32(x.encode("utf-8", "surrogatepass")) for x in names)


def _of_chunks(chunks: list[str]) -> Iterator[list[tuple[int, ...]]]:
    return ([features(w) for w in words] for words in words_of(chunks))


class Model(NamedTuple):
    """places: feature hash to index; weights; cuts: the thresholds; positive: indices that speak for
    toxicity."""

    places: dict[int, int]
    weights: np.ndarray
    cuts: np.ndarray
    positive: frozenset[int]

    def lexicon(self) -> Memo:
        """For each white-space separated chunk of text the indices of its features, repeats included, and
        whether one is positive; None for a chunk without features."""
        places = self.places

        def compute(chunks: list[str]):
            for found in _of_chunks(chunks):
                words = [[places[f] for f in word if f in places] for word in found]
                flat = [j for word in words for j in word]
                yield (flat, not self.positive.isdisjoint(flat)) if flat else None

        return Memo(compute, weigh=lambda v: 0 if v is None else 150 + 8 * len(v[0]))

    def values(self, texts: list, memo: Memo) -> list[tuple[dict[int, float], float]]:
        """Values of features, and the share of chunks with a positive one, of each text. A chunk that a text
        repeats is looked up once."""
        tallies = [Counter(t.split()) if t else Counter() for t in texts]
        known = memo.have(set().union(*tallies))
        out = []
        for tally in tallies:
            found: dict[int, int] = {}
            marked = 0
            for x, n in tally.items():
                if (have := known[x]) is not None:
                    for j in have[0]:
                        found[j] = found.get(j, 0) + n
                    marked += n * have[1]
            chunks = max(1, tally.total())
            out.append(({j: math.log1p(100 * n / chunks) for j, n in found.items()}, marked / chunks))
        return out

    def at_least(self, found: dict[int, float]) -> np.ndarray:
        """P(grade >= k) for k from 1, from the values of features."""
        at, x = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found))
        s = self.weights[at] @ x
        return 1 / (1 + np.exp(np.clip(self.cuts - s, -60, 60)))


def _sample(documents: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """At most so many labelled documents of either class, those of the least hashes of the id; and how many documents
    of each class there are."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known.join(documents.select("doc_id"), "doc_id", "left_semi"), "labels")
    every = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [
        known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)
    ]
    both = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * most rows
    rows = documents.select("doc_id", "text").join(both, "doc_id")
    copies = rows.groupBy("toxic", F.xxhash64("text")).agg(F.min(F.struct("doc_id", "text")).alias("d"))
    return written(copies.select("toxic", "d.text"), "labelled"), every  # exact copies speak once


def _document_counts(sample: DataFrame) -> DataFrame:
    """How many sampled documents of each class have a feature."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        memo = Memo(lambda chunks: [{f for w in x for f in w} for x in _of_chunks(chunks)], weigh=lambda v: 200 + 60 * len(v))
        for part in parts:
            texts, toxic = part.column("text").to_pylist(), part.column("toxic").to_pylist()
            for text, grade in zip(texts, toxic):
                chunks = set(text.split()) if text else set()
                known = memo.have(chunks)
                seen[grade].update(set().union(*[known[x] for x in chunks]))
        keys = list(seen[0].keys() | seen[1].keys())
        for k in range(0, len(keys), 100_000):
            part = keys[k : k + 100_000]
            yield pa.record_batch(
                [pa.array(part, pa.int64())] + [pa.array([c[f] for f in part], pa.int64()) for c in seen],
                names=["feature", "clean", "toxic"],
            )

    counts = sample.repartition(partitions(sample.sparkSession)).mapInArrow(run, "feature long, clean long, toxic long")
    return counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _telling(counts: DataFrame, clean: int, toxic: int) -> DataFrame:
    """Features whose frequencies differ between the classes, by G2."""

    def term(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    total = clean + toxic
    have = F.col("clean") + F.col("toxic")
    g2 = 2 * (
        term(F.col("clean"), have * clean / total)
        + term(F.col("toxic"), have * toxic / total)
        + term(clean - F.col("clean"), (total - have) * clean / total)
        + term(toxic - F.col("toxic"), (total - have) * toxic / total)
    )
    return (
        counts.filter(have >= LEAST)
        .filter((F.col("clean") >= SHARE * clean) | (F.col("toxic") >= SHARE * toxic))
        .withColumn("g2", g2)
        .filter(F.col("g2") >= EVIDENCE)
        .orderBy(F.col("g2").desc(), "feature")
        .select("feature", (F.col("toxic") / toxic > F.col("clean") / clean).alias("positive"))
    )


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """documents: doc_id, text. labels: doc_id, toxic."""
    tune(documents.sparkSession)
    none = Model({}, np.zeros(0), np.full(GRADES - 1, 60.0), frozenset())
    known, every = _sample(documents, labels, sample)
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return none
    chosen = _telling(_document_counts(known), sizes[0], sizes[1]).collect()  # bounded by the sample
    if not chosen:
        return none
    places = {r.feature: k for k, r in enumerate(chosen)}
    positive = frozenset(k for k, r in enumerate(chosen) if r.positive)
    model = Model(places, np.zeros(len(places)), np.zeros(GRADES - 1), positive)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.lexicon()
        for part in parts:
            found = model.values(part.column("text").to_pylist(), memo)
            yield pa.record_batch(
                [
                    part.column("toxic").cast(pa.int32()),
                    pa.array([x for _, x in found], pa.float64()),
                    pa.array([list(c) for c, _ in found], pa.list_(pa.int32())),
                    pa.array([list(c.values()) for c, _ in found], pa.list_(pa.float64())),
                ],
                names=["toxic", "marked", "at", "x"],
            )

    rows = known.mapInArrow(run, "toxic int, marked double, at array<int>, x array<double>").toPandas()
    toxic, marked = rows["toxic"].to_numpy(), rows["marked"].to_numpy()
    low, high = np.quantile(marked[toxic == 1], [1 / 3, 2 / 3], method="lower")
    grade = np.where(toxic == 1, 1 + (marked > low) + (marked > high), 0)
    weight = np.where(toxic == 1, every[1] / sizes[1], every[0] / sizes[0])
    return _regress(model, grade, weight / weight.mean(), rows["at"].to_list(), rows["x"].to_list())


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _cuts(params: np.ndarray, size: int) -> np.ndarray:
    """Thresholds from the first of them and the logarithms of the gaps between them."""
    return params[size] + np.concatenate([[0], np.cumsum(np.exp(params[size + 1 :]))])


def loss_and_gradient(
    params: np.ndarray, size: int, grade: np.ndarray, weight: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray
) -> tuple[float, np.ndarray]:
    """Mean weighted negative log likelihood of the grades, with the penalty, and its gradient. params: size weights,
    the first threshold and the logarithms of the gaps; row, column and value: the sparse features."""
    w, n, steps = params[:size], len(grade), GRADES - 1
    s = np.bincount(row, value * w[column], n)
    # P(grade <= k) at the two thresholds around each example's grade
    edges = np.concatenate([[-np.inf], _cuts(params, size), [np.inf]])
    above, below = _sigmoid(edges[grade + 1] - s), _sigmoid(edges[grade] - s)
    p = np.maximum(above - below, 1e-12)
    d_above, d_below = weight * above * (1 - above) / p, weight * below * (1 - below) / p
    d_cut = np.array([d_below[grade == k + 1].sum() - d_above[grade == k].sum() for k in range(steps)])
    gaps = np.exp(params[size + 1 :])
    gradient = np.concatenate(
        [
            np.bincount(column, value * (d_above - d_below)[row], size),
            [d_cut.sum()],
            [d_cut[k:].sum() * gaps[k - 1] for k in range(1, steps)],
        ]
    ) / n
    gradient[:size] += PENALTY * w
    return float(-(weight * np.log(p)).sum() / n + PENALTY / 2 * w @ w), gradient


def _regress(model: Model, grade: np.ndarray, weight: np.ndarray, at: list, x: list) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam."""
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    column = np.concatenate([*at, []]).astype(np.int64)
    value = np.concatenate([*x, []])
    size = len(model.weights)
    params = np.concatenate([np.zeros(size), [1.0], np.zeros(GRADES - 2)])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        _, gradient = loss_and_gradient(params, size, grade, weight, row, column, value)
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient**2 - second)
        params -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return model._replace(weights=params[:size].copy(), cuts=_cuts(params, size))


def with_severity(
    documents: DataFrame, model: Model, cutoff: float = CUTOFF, keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of documents (all if None) with severity (expected grade, from 0 to 3), grade
    (the most likely), p_toxic and rejected. A narrow operation; existing columns of these names are
    replaced."""
    spark = documents.sparkSession
    tune(spark)
    new = T.StructType().add("severity", "double").add("grade", "integer").add("p_toxic", "double").add("rejected", "boolean")
    keep = [c for c in (documents.columns if keep is None else keep) if c not in new.names]
    into = T.StructType([documents.schema[c] for c in keep] + new.fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.lexicon()
        for part in parts:
            texts = part.column("text").to_pylist()
            for begin, end in batches(texts):
                p = np.array([model.at_least(found) for found, _ in model.values(texts[begin:end], memo)])
                each = np.column_stack([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]])
                none = not model.places
                piece = part.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in keep]
                    + [
                        pa.array(np.zeros(len(p)) if none else p.sum(1)),
                        pa.array(each.argmax(1).astype(np.int32)),
                        pa.array(p[:, 0]),
                        pa.array(p[:, 0] >= cutoff),
                    ],
                    names=[*keep, *new.names],
                )

    return documents.select(*{*keep, "text"}).mapInArrow(run, into)
