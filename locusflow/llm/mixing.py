"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, piecewise linear between knots; its
share of the mix at time t is its weight over the sum of all weights. The integral of a source's share is
its cumulative token demand, D(t); the whole mix has the tokens that the targets sum to, so a source's
demand is scaled to end at its target. A source's documents stand in a fixed pseudo-random order (by md5
of the id), repeated while the demand lasts; a document that begins at c of its source's tokens is due
at the time t with D(t) = c. Documents are range-sorted by that position.

Targets: a source gets ``share`` of all tokens by its weight, but at most ``most`` (and at least
``least``) times its own size; what is over goes to the others by weight until none is above. The cut is
to the word: the last document of a source may be taken in part.

Only keys, sources and sizes are shuffled; rows that are equal in all of them are one row with a count until
positions are given out. Prefix sums are taken in two levels: within hash buckets of a source and over the
buckets, so a source with a third of all rows is spread like the others. The table of sources is never
collected: ranks and levels come from prefix sums over range-sorted partitions.

Defined results: a null source is a source, after the others; null texts have size 0 and are never taken;
a source without words has target 0. Rows that repeat a doc_id, null ids too, are documents of their own and
stand by a hash of id and text. Texts of any length are counted whole; an empty table gives no rows. Only the columns doc_id, source and text are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions, small, written
from .ordering import running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SOURCES = 10_000  # a plan of so many sources is broadcast (about 600 bytes each), a larger one is shuffled
STEPS = 64  # pieces of time in which demand curves are linear

Schedule = list[tuple[float, float]]  # (time, factor on the weight) knots, times ascending from 0 to 1


def key_of(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """The place of a document in its source's order: rows have equal keys iff id and text are equal."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(text)))


def sizes(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id",
        "source",
        key_of().alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(
    totals: DataFrame, share: float, most: float, least: float = 0.0, weights: tuple[float, ...] = WEIGHTS
) -> DataFrame:
    """totals: source, n (words). Adds rank (by code point, null last), weight (weights in turn) and target:
    the weight times a common level, within the source's bounds, so that all sum to the share (as far as
    bounds allow).

    What all targets sum to is a piecewise linear function of the level: a source joins in where its weight
    lifts it from its lower bound, and leaves at its upper bound. Prefix sums over these knots give the
    function's pieces; the level lies in the first piece that reaches the goal.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = running(totals, [F.col("source").isNull(), F.col("source")], rank=F.lit(1))
    ranked = written(ranked.withColumn("weight", turn), "sources")
    low, high = F.lit(float(least)) * F.col("n"), F.lit(float(most)) * F.col("n")
    whole = ranked.agg(F.sum("n").alias("n"), F.sum(low).alias("low")).first()
    goal = min(share, most) * (whole.n or 0)
    knots = ranked.select(
        F.inline(
            F.array(
                F.struct((low / F.col("weight")).alias("x"), F.col("weight").alias("dw"), (-low).alias("df")),
                F.struct((high / F.col("weight")).alias("x"), (-F.col("weight")).alias("dw"), high.alias("df")),
            )
        )
    )
    knots = written(knots, "knots")
    pieces = running(knots, [F.col("x"), -F.col("dw")], w=F.col("dw"), f=F.col("df"), place=F.lit(1))
    fixed = F.col("f") + (whole.low or 0.0)
    reached = pieces.filter(fixed + F.col("w") * F.col("x") >= goal).select(
        "place", F.when(F.col("w") > 0, (goal - fixed) / F.col("w")).otherwise(F.col("x")).alias("level")
    )
    first = reached.orderBy("place").limit(1).first()
    level = first.level if first else knots.agg(F.max("x")).first()[0] or 0.0
    return ranked.withColumn("target", F.least(high, F.greatest(low, F.col("weight") * F.lit(float(level)))))


def ramp(rank: int) -> Schedule:
    """The default curriculum: every second source fades in from half to one and a half times its weight,
    the others fade out."""
    return [(0.0, 0.5), (1.0, 1.5)] if rank % 2 else [(0.0, 1.5), (1.0, 0.5)]


def demand(
    sources: DataFrame, weights: tuple[float, ...], schedules: dict | None, steps: int = STEPS
) -> tuple[Column, DataFrame | None]:
    """sources: source, rank. The curve of a source as an expression of its rank and ``own``: the integral of its
    share from 0 to k / steps, for k to steps, scaled to end at 1; and a table (name, own) of the sources that
    have a schedule of their own. Sources of the default curriculum differ by rank modulo a small number only."""
    import numpy as np

    t = (np.arange(steps) + 0.5) / steps
    kinds = math.lcm(2, len(weights))

    def factor(rank: int, schedule: Schedule) -> np.ndarray:
        return weights[rank % len(weights)] * np.interp(t, [x for x, _ in schedule], [y for _, y in schedule])

    count = {r[0]: r[1] for r in sources.groupBy(F.col("rank") % kinds).count().collect()}  # at most kinds rows
    given = dict(schedules or {})
    names = sources.sparkSession.createDataFrame([(n, k) for k, n in enumerate(given)], "name string, own int") if given else None
    owned = []
    if names is not None:
        met = sources.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name")))  # a row a schedule
        owned = [(r.own, r["rank"]) for r in met.select("own", "rank").collect()]
    for _, rank in owned:
        count[rank % kinds] -= 1
    by_kind = {k: factor(k, ramp(k)) for k in range(kinds)}
    by_own = {own: factor(rank, list(given.values())[own]) for own, rank in owned}
    total = sum([n * by_kind[k] for k, n in count.items()]) + sum(by_own.values()) if count else np.ones(steps)

    def curve(f: np.ndarray) -> Column:
        grown = np.concatenate([[0.0], np.cumsum(f / total)])
        return F.array(*[F.lit(float(v)) for v in grown / (grown[-1] or 1.0)])

    every = F.element_at(F.array(*[curve(by_kind[k]) for k in range(kinds)]), (F.col("rank") % kinds + 1).cast("int"))
    if names is None:
        return every, None
    mine = F.array(*[curve(by_own.get(own, np.zeros(steps))) for own in range(len(given))])
    return F.coalesce(F.get(mine, F.col("own")), every), names


def _due(curve: Column, x: Column) -> Column:
    """The time at which a curve (its values at k / STEPS) reaches x in [0, 1]."""
    k = F.greatest(F.lit(1), F.least(F.lit(STEPS), F.size(F.filter(curve, lambda v: v <= x))))
    a, b = F.element_at(curve, k), F.element_at(curve, k + 1)
    return (k - 1 + F.when(b > a, (x - a) / (b - a)).otherwise(0.0)) / STEPS


def mix(
    documents: DataFrame, share: float = 1.5, most: float = 2.0, least: float = 0.0,
    weights: tuple[float, ...] = WEIGHTS, schedules: dict | None = None, cut: bool = True,
) -> DataFrame:
    """Documents (doc_id, source, text) with key, size, source_size, target, taken (words, repeats counted) and
    positions: the training positions in [0, 1] of each time it is taken, and how many words each time.

    With cut = False documents are taken whole or not: each time iff more than half of it is wanted.
    """
    alike = sizes(documents).groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("rows"))
    rows = written(alike, "sizes")
    words = F.col("size") * F.col("rows")
    totals = written(rows.groupBy("source").agg(F.sum(words).alias("n")), "totals")
    goals = targets(totals, share, most, least, weights)
    curve, names = demand(goals, weights, schedules)
    if names is not None:
        goals = goals.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name")), "left")
    plan = written(
        goals.select(F.col("source").alias("name"), F.col("n").alias("source_size"), "target", curve.alias("curve")), "plan"
    )
    order = [F.col("key"), F.col("size")]
    # the first digits of the key name a bucket: buckets follow each other in that order
    dealt = rows.withColumn("bucket", F.substring("key", 1, 3))
    per = dealt.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = (
        dealt.repartition(partitions(documents.sparkSession), "source", "bucket")
        .withColumn("within", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .join(small(plan, SOURCES), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("copy", F.explode(F.expr("sequence(0L, rows - 1)")))
        .withColumn("begin", F.col("offset") + F.col("within") + F.col("copy") * F.col("size"))
    )
    wanted = F.floor("target").cast("long") if cut else F.col("target")

    def times(k: Column) -> Column:
        """Words taken and position in pass k over the source."""
        begin = F.col("begin") + k * F.col("source_size")
        left = wanted - begin
        if cut:
            words = F.greatest(F.lit(0), F.least(F.col("size"), left))
        else:
            words = F.when(left > F.col("size") / 2, F.col("size")).otherwise(0)
        at = F.when(F.col("target") > 0, F.least(F.lit(1.0), begin / F.col("target"))).otherwise(0.0)
        return F.struct(words.cast("long").alias("words"), _due(F.col("curve"), at).alias("position"))

    passes = int(-(-most // 1))
    taken = placed.withColumn(
        "positions",
        F.filter(F.array(*[times(F.lit(k)) for k in range(passes)]), lambda p: p["words"] > 0),
    )
    return taken.select(
        "doc_id",
        "key",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"),
        "positions",
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each time a document is taken, range-sorted by position (ties by doc_id)."""
    rows = mixed.select("doc_id", "source", F.explode("positions").alias("p")).select(
        "doc_id", "source", F.col("p.position").alias("position"), F.col("p.words").alias("words")
    )
    rows = written(rows, "positions")  # the sort's sample and the sort read the same rows
    return rows.orderBy("position", "doc_id")
