"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import hard_negatives
from locusflow.llm.hard_negatives import encode, fit, mine, table_sums
from locusflow.llm.maxscore import quantised

FORM = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """rows: (vec_id, q, label)."""
    out = []
    for i, (a, q, label) in enumerate(rows):
        if a % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(q, r)), b, l) for j, (b, r, l) in enumerate(rows) if j != i and len(r) == len(q)
        ]
        best = sorted((s, b) for s, b, l in scored if l == label)[:positives]
        for k, (s, b) in enumerate(best):
            hard = sorted((t, c) for t, c, l in scored if l != label and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(a, b, n + 1, c, -s, -t, k + 1) for n, (t, c) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, FORM)
    found = mine(quantised(df, label=F.col("label")), F.col("vec_id") % 100 == 0, **options)
    return sorted(map(tuple, found.collect()))


def plain(rows):
    return [
        (i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v], label)
        for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]


@pytest.mark.parametrize("cells", [1 << 22, 1 << 9])
def test_mined_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(hard_negatives, "CELLS", cells)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 40)
    rng = np.random.default_rng(3)
    rows = [(int(k) * 20, rng.normal(size=7).round(2).tolist(), int(rng.integers(3))) for k in range(150)]
    rows += [(k, [0.5, 0.25, -0.125, 0.5, 0.0, 0.0, 1.0], k % 2) for k in range(3000, 3060)]  # copies of two labels
    rows += [(k, [1.0, k / 50.0], k % 3) for k in range(3100, 3300, 10)]  # another length
    rows += [(5000, None, 1), (5100, [1.0, None], 1), (5200, [float("nan")] * 7, 1), (5300, [1.0] * 7, None), (5400, [], 1)]
    rows += [(None, [1.0] * 7, 1), (200, [0.1] * 7, 1), (200, [0.1] * 7, 1), (0, [0.0] * 7, 2), (5500, [30000.0] * 7, 2)]
    want = brute(plain(rows))
    assert len(want) > 500 and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=3, low=-50, high=100) == brute(plain(rows), 2, 3, -50, 100)


def test_no_rows_one_row_and_clashing_columns(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(5, [1.0], 1), (6, [1.0], 1)]) == []
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)], FORM)
    odd = df.withColumns({c: F.lit("x") for c in ("row", "rank", "score", "n", "shard", "block", "at", "packed", "copy")})
    found = mine(quantised(odd, label=F.col("label")), F.col("vec_id") == 0)
    assert list(map(tuple, found.collect())) == [(0, 1, 1, 2, 65536, 32768, 1)]


def test_scores_lie_within_their_bounds():
    rng = np.random.default_rng(5)
    for scale in (3, 300, 10**9, 1 << 61):
        vectors = (rng.normal(size=(400, 9)) * scale).clip(-(2.0**62), 2.0**62).astype(np.int64)
        book = fit(vectors[:200].astype(np.float64))
        codes, margin = encode(vectors, book)
        for a in vectors[:20]:
            slack = margin * np.sqrt((a.astype(np.float64) ** 2).sum())
            exact = np.array([sum(int(x) * int(y) for x, y in zip(a, v)) for v in vectors], np.float64)
            assert (np.abs(table_sums(a, codes.T.astype(np.intp), book) - exact) <= slack).all()
        assert (slack < 0.4 * np.sqrt((vectors[0].astype(np.float64) ** 2).sum()) * np.sqrt((a.astype(np.float64) ** 2).sum())).mean() > 0.9
