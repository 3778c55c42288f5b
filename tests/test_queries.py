"""Every query of the catalogue against its SQL, and regions that merge, tile and batch."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusflow.operators import regions
from locusflow.plans.catalogue import ORACLE_SQL, QUERIES
from locusflow.streaming import tiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("lineitem", "part", "events", "orders"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(frame, names):
    def value(v):
        if pd.isna(v):
            return None
        return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(str(tuple(value(v) for v in row)) for row in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toPandas(), tables.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


def test_statistics_of_all_contigs_hold_all_reads(spark):
    aligned = QUERIES["cigar_blocks"](spark, SF).selectExpr("sum(hi - lo)").first()[0]
    counted = QUERIES["count_coverage_nofilter_contigs"](spark, SF).selectExpr("count(*)", "sum(A + C + G + T)").first()
    assert counted[0] == 3 * 20_100 and counted[1] == aligned - _others(spark)


def _others(spark):
    """Aligned letters that are not A, C, G or T."""
    from locusflow.functions.alignments import aligned_blocks, has_flag
    from locusflow.plans import derived

    reads = derived.alignments(spark, SF).filter(~has_flag("is_unmapped"))
    runs = reads.select("query_sequence", F.inline(aligned_blocks()))
    return runs.selectExpr("sum(length(translate(substr(query_sequence, int(q + 1), int(hi - lo)), 'ACGT', '')))").first()[0]


def test_merge_and_tiles(spark):
    rows = [("a", 0, 5), ("a", 5, 9), ("a", 10, 12), ("a", 1, 2), ("b", 3, 3), ("b", 4, 9)]
    df = spark.createDataFrame(rows, "contig string, start long, stop long")
    assert sorted(map(tuple, regions.merge_regions(df).collect())) == [("a", 0, 9), ("a", 10, 12), ("b", 4, 9)]
    got = regions.tile_regions(df.filter("contig = 'b'"), 2).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(4, 6), (6, 8), (8, 9)]
    assert regions.chunk_width(1000, 4, 4) == 63 and regions.chunk_width(0, 1, 1) == 1


def _plain_merge(rows):
    out = []
    for c, a, b in sorted(r for r in rows if r[1] < r[2]):
        if out and out[-1][0] == c and a <= out[-1][2]:
            out[-1] = (c, out[-1][1], max(out[-1][2], b))
        else:
            out.append((c, a, b))
    return out


@pytest.mark.parametrize("bits", [2, 6, 16])
def test_merge_over_tiles(spark, monkeypatch, bits):
    monkeypatch.setattr(regions, "STARTS", bits)
    rng = random.Random(bits)
    for most in (3, 30, 400):
        rows = [(rng.choice("ab"), a, a + rng.randrange(most)) for a in (rng.randrange(3000) for _ in range(300))]
        df = spark.createDataFrame(rows, "contig string, start long, stop long")
        merged = regions.merge_regions(df)
        want = _plain_merge(rows)
        assert sorted(map(tuple, merged.collect())) == want
        ended = {(r.contig, r.start): r._ended for r in regions._ended(merged).collect()}
        before = {(c, a): want[k - 1][2] if k and want[k - 1][0] == c else -1 for k, (c, a, _) in enumerate(want)}
        assert ended == before
    assert regions.merge_regions(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 500_000])
def test_overlaps_of_mixed_widths(spark, monkeypatch, few):
    monkeypatch.setattr(regions, "FEW", few)
    rng = random.Random(few)
    widths = [20, 150, 511, 512, 513, 5000, 100_000, 1_000_000, 10_000_000]
    place = lambda: rng.choice([rng.randrange(20_000), rng.randrange(1 << 26), (1 << rng.randrange(9, 26)) - rng.randrange(3)])
    reads = [(f"r{k}", 4 * (k % 29 == 0), k % 2, "ab"[k % 2], place(), f"10M{rng.choice(widths)}N10M") for k in range(400)]
    reads += [("same", 0, 0, "a", 777, "40M")] * 3 + [("none", 0, -1, None, -1, None), ("odd", 0, 0, "a", 512, None)]
    spans = [(k, rng.choice("ab"), a, a + rng.choice(widths)) for k, a in enumerate(place() for _ in range(120))] + [(999, "a", 5, 5)]
    df = spark.createDataFrame(reads, "query_name string, flag int, reference_id int, reference_name string, reference_start long, cigar string")
    table = spark.createDataFrame(spans, "region_id int, contig string, start long, stop long")

    def end(flag, start, cigar):
        return start + max(1, 0 if flag & 4 or not cigar else sum(int(n) for n, op in re.findall(r"(\d+)([A-Z])", cigar) if op in "MN"))

    def met(some):
        return [(n, i) for n, f, ref, c, a, cigar in reads for i, d, s, e in some if ref >= 0 and c == d and a < e and end(f, a, cigar) > s and s < e]

    for finest in (None, 9, 14):
        joined = regions.overlap_join(df, table, finest)
        assert joined.columns == [*df.columns, *table.columns]
        assert sorted((r.query_name, r.region_id) for r in joined.collect()) == sorted(met(spans))
    wide = table.withColumns({"note": F.lit("x" * 300_000), "some": F.array("region_id")})
    assert "BroadcastExchange" not in regions.overlap_join(df, wide)._jdf.queryExecution().executedPlan().toString()
    merged = [(k, *m) for k, m in enumerate(_plain_merge([s[1:] for s in spans]))]
    assert sorted(r.query_name for r in regions.overlapping_any(df, table).collect()) == sorted(
        r[0] for r in reads if any(r[2] >= 0 and r[3] == c and r[4] < e and end(r[1], r[4], r[5]) > s for _, c, s, e in merged))
    assert sorted(r.query_name for r in regions.multi_fetch(df, table).collect()) == sorted(n for n, _ in met(merged))


def test_reads_are_not_repeated_in_joins_and_genomes_take_one_scan(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for name in ("region_join", "tile_counts", "multi_region_fetch", "region_any_overlap", "region_fetch", "region_count_all"):
        text = plan(QUERIES[name](spark, SF))
        assert "regexp_extract_all" not in text and "lambdafunction(cast(regexp" not in text, name
    for name in sorted(QUERIES):
        if name.endswith("_contigs") and not name.startswith("depth_blocks"):
            assert plan(QUERIES[name](spark, SF)).split("Final Plan")[-1].count("FileScan") == 1, name


def test_stream_of_tiles(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 5, 0), ("a", 1500, 0), ("a", 1600, 4)], "reference_name string, reference_start long, flag int"
    )
    rows.write.parquet(str(tmp_path / "in"))
    live = tiles.tile_counts(tiles.stream(spark, str(tmp_path / "in"), rows.schema), 1000)
    query = live.writeStream.format("memory").queryName("tiles").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("tiles").collect())) == [("a", 0, 1), ("a", 1000, 2)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics_of_derived_reads_need_one_python_worker_a_task(spark):
    for name in ("recount_lines", "recount_min_alt", "recount_sites", "count_coverage", "pileup_filtered_contigs"):
        assert "ArrowEvalPython" not in _plan(QUERIES[name](spark, SF)), name


def test_qualities_as_text(spark):
    from locusflow.operators import stats

    rows = [(0, "c", 3, 9, "4M1I5M", "ACGTNACGTA", [0, 12, 13, 14, 60, 93, 7, 13, 20, 2]), (0, "c", 5, 9, "6M", "TTTTTT", None),
            (16, "c", 1, 9, "8M", "acgtacgt", [40, 41, 42])]
    reads = spark.createDataFrame(rows, "flag int, reference_name string, reference_start long, mapping_quality int, cigar string, query_sequence string, query_qualities array<tinyint>")
    text = F.array_join(F.transform("query_qualities", lambda x: F.chr(x.cast("int") + 33)), "")
    other = reads.withColumn("quality_text", text).withColumn("query_qualities", F.lit(None).cast("array<tinyint>"))
    for least in (-300, 0, 13, 14, 60, 93, 94, 300):
        got, want = (sorted(map(tuple, stats.pileup_counts(x, "c", 0, 20, least).collect())) for x in (other, reads))
        assert got == want and sum(r[-1] for r in got) == sum(q >= least for _, *_, x in rows for k, q in enumerate(x or []) if len(x) < 10 or k != 4)


def test_contigs_are_made_without_python(spark):
    for name in ("count_coverage_nofilter_contigs", "depth_profile_contigs", "tile_counts", "multi_region_fetch"):
        assert "ExistingRDD" not in _plan(QUERIES[name](spark, SF)), name


def test_cigars_are_parsed_once(spark):
    for name in ("multi_region_fetch", "region_join", "region_any_overlap", "tile_counts", "region_fetch", "region_count_all"):
        assert _plan(QUERIES[name](spark, SF)).count("ArrowEvalPython") == 1, name
