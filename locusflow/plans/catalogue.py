"""Registered queries over the driver's tables, and their SQL for DuckDB.

The SQL never parses a CIGAR: it takes aligned runs from a table of templates, so it is an independent
way to the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignments as A
from ..operators import recount as R
from ..operators import regions as G
from ..operators import stats as S
from ..sources import dump, vcf
from ..sources.sites import parse_sites
from . import derived as D

Query = Callable[[SparkSession, str], DataFrame]
REGION = ("ctg1", 2_000, 6_000)
WHOLE = ("ctg0", 0, D.CONTIG_LENGTH)

_READS = f"a as ({D.ALIGNMENTS_SQL})"
_SPAN = "case when flag % 8 >= 4 then 1 else case k when 0 then 32 when 1 then 33 when 2 then 20 when 3 then 82 when 4 then 32 when 5 then 27 else 32 end end"
_BLOCKS = f"b as (select a.*, reference_start + ro as lo, reference_start + ro + len as hi, qo as q from a join (select * from {D.TEMPLATES_SQL}) t using (k) where (flag & 4) = 0)"


def _bases(contig: str, start: int, stop: int, mask: int, quality: int, mapq: int = 0) -> str:
    return f"""p as (select lo + i as pos, substr(query_sequence, cast(q + i + 1 as int), 1) as base,
      5 + 2 * (instr('0123456789abcdef', substr(qual_hex, cast(q + i + 1 as int), 1)) - 1) as quality
      from b, range(0, 32) r(i) where i < hi - lo and reference_name = '{contig}' and (flag & {mask}) = 0
      and mapping_quality >= {mapq} and lo + i >= {start} and lo + i < {stop}),
    g as (select * from p where quality >= {quality})"""


def _sum(letter: str) -> str:
    return f"cast(coalesce(sum(case when base = '{letter}' then 1 else 0 end), 0) as bigint) as \"{letter}\""


def _pileup(contig: str, start: int, stop: int, mask: int, quality: int, mapq: int, letters: str, depth: bool) -> str:
    extra = ', cast(count(base) as bigint) as depth' if depth else ""
    return f"""with {_READS}, {_BLOCKS}, {_bases(contig, start, stop, mask, quality, mapq)}
    select x.pos, {', '.join(map(_sum, letters))}{extra} from range({start}, {stop}) x(pos) left join g on g.pos = x.pos group by x.pos"""


def _depth(contig: str, start: int, stop: int) -> str:
    return f"""with {_READS}, {_BLOCKS}, p as (select lo + i as pos from b, range(0, 32) r(i)
      where i < hi - lo and reference_name = '{contig}' and (flag & {A.MASK_ALL}) = 0),
    d as (select x.pos, cast(count(p.pos) as bigint) as depth from range({start}, {stop}) x(pos) left join p on p.pos = x.pos group by x.pos)"""


def region_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fetch(D.alignments(spark, sf_dir), *REGION, keep_span=True).select(
        "query_name", "flag", "reference_start", "span_end"
    )


def region_count(read_callback: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.count(D.alignments(spark, sf_dir), *REGION, read_callback=read_callback)

    return run


def flag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.alignments(spark, sf_dir).select("query_name", *[A.has_flag(f).alias(f) for f in A.FLAGS])


def cigar_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.alignments(spark, sf_dir).select(
        "query_name",
        A.reference_length().alias("reference_length"),
        A.reference_end().alias("reference_end"),
        A.cigar_string(A.cigar_ops()).alias("cigarstring"),
        F.to_json(F.transform(A.cigar_tuples(), lambda t: F.array(t["code"], t["len"]))).alias("cigartuples"),
        A.query_length_on_cigar().alias("query_on_cigar"),
    )


def cigar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = D.alignments(spark, sf_dir).filter(~A.has_flag("is_unmapped"))
    return mapped.select("query_name", F.inline(A.aligned_blocks()))


def depth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.depth(D.alignments(spark, sf_dir), *WHOLE)


def depth_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.depth_blocks(D.alignments(spark, sf_dir), *WHOLE)


def count_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.count_coverage(D.alignments(spark, sf_dir), *WHOLE)


def count_coverage_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.count_coverage(D.alignments(spark, sf_dir), *REGION, quality_threshold=0, read_callback="nofilter")


def pileup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pileup_counts(D.alignments(spark, sf_dir), *WHOLE)


def pileup_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pileup_counts(D.alignments(spark, sf_dir), *REGION, min_base_quality=13, min_mapping_quality=10)


def every_contig(statistic: Callable[..., DataFrame], **options) -> Query:
    """A statistic over the whole of all contigs, so over all reads, in one pass."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return statistic(D.alignments(spark, sf_dir), D.contigs(spark), **options)

    return run


def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flag_summary(D.alignments(spark, sf_dir))


def contig_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contig_summary(D.alignments(spark, sf_dir))


def merge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_regions(D.order_regions(spark, sf_dir))


def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = G.contig_windows(D.contigs(spark), 1_000)
    joined = G.overlap_join(D.alignments(spark, sf_dir), tiles.drop("reference_id"))
    counts = joined.groupBy("contig", "start").agg(F.count("*").alias("reads"))
    return tiles.select("contig", "start", "stop").join(counts, ["contig", "start"], "left").na.fill(0, ["reads"])


def region_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.overlap_join(D.alignments(spark, sf_dir), D.regions(spark)).select("query_name", "region_id")


def multi_region_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.multi_fetch(D.alignments(spark, sf_dir), D.regions(spark), D.contigs(spark)).select(
        "query_name", "region_contig", "region_start", "region_stop"
    )


def region_any_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.overlapping_any(D.alignments(spark, sf_dir), D.regions(spark)).select("query_name")


def recount_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recount(D.alignments(spark, sf_dir), D.sites(spark), "s1", min_base_quality=10).drop("AF")


def recount_min_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.recount(D.alignments(spark, sf_dir), D.sites(spark), "s1", min_mapping_quality=5, min_alt=2)
    return rows.select("site_idx", "chrom", "pos", "DP", "ALT_COUNT", "AF")


def recount_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.recount(D.alignments(spark, sf_dir), parse_sites(D.site_lines(spark)), "s1", min_base_quality=10)
    return rows.select("site_idx", R.tsv_line().alias("value"))


def sites_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_sites(D.part_site_lines(spark, sf_dir))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.json_lines(D.tagged(spark, sf_dir)).select("value")


def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tagged(spark, sf_dir).select(
        "query_name", A.has_tag("MD").alias("has_md"), A.has_tag("XX").alias("has_xx"), A.get_tag("NM")["i"].alias("nm"),
        dump.tag_text(A.get_tag("RG")).alias("rg"), dump.tag_text(A.get_tag("XS")).alias("xs"), dump.tag_text(A.get_tag("MD")).alias("md"),
    )


def genomic_order_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.genomic_order(D.alignments(spark, sf_dir), "query_name").limit(500)
    return rows.select(
        "query_name",
        F.to_json(F.struct("query_name", "flag", "reference_name", "reference_start", "mapping_quality")).alias("line"),
    )


def read_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.alignments(spark, sf_dir).select("query_name", "reference_id", "reference_start")
    return G.batches(rows, 256, "reference_id", "reference_start", "query_name").select("query_name", "batch")


def variant_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vcf.fetch(vcf.parse(D.vcf_lines(spark, sf_dir)), "ctg1", 3_000, 9_000)
    return found.select("chrom", "pos", "start", "stop", "id", "ref", F.size("alts").alias("n_alts"))


def variant_open_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vcf.fetch(vcf.parse(D.vcf_lines(spark, sf_dir)), "ctg2", 15_000)
    return found.select("chrom", "pos", "stop", F.array_join("alleles", "/").alias("alleles"), "qual",
                        F.array_join("filter", ",").alias("filter"))


def variant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.get("samples", F.lit(0))
    return vcf.parse(D.vcf_lines(spark, sf_dir)).select(
        "chrom",
        "pos",
        F.col("info")["DP"].cast("int").alias("info_dp"),
        F.col("info")["AF"].alias("info_af"),
        F.map_contains_key("info", "DB").alias("info_db"),
        F.map_contains_key("info", "NS").alias("info_ns"),
        F.get(s["gt"], F.lit(0)).alias("gt0"),
        F.get(s["gt"], F.lit(1)).alias("gt1"),
        s["dp"].alias("dp"),
        F.get(s["ad"], F.lit(0)).alias("ad0"),
        F.get(s["ad"], F.lit(1)).alias("ad1"),
    )


def tags_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tags = F.from_json("props", "map<string,bigint>")
    return events.select(
        "event_id",
        A.has_tag("k", tags).alias("has_k"),
        A.get_tag("k", tags).alias("k"),
        A.has_tag("absent", tags).alias("has_absent"),
    )


QUERIES: dict[str, Query] = {
    "region_fetch": region_fetch,
    "region_count_nofilter": region_count("nofilter"),
    "region_count_all": region_count("all"),
    "flag_bits": flag_bits,
    "cigar_values": cigar_values,
    "cigar_blocks": cigar_blocks,
    "depth_profile": depth_profile,
    "depth_blocks": depth_blocks,
    "count_coverage": count_coverage,
    "count_coverage_nofilter": count_coverage_all,
    "pileup_counts": pileup_counts,
    "pileup_filtered": pileup_filtered,
    "depth_profile_contigs": every_contig(S.depth_contigs),
    "depth_blocks_contigs": every_contig(S.depth_blocks_contigs),
    "count_coverage_contigs": every_contig(S.count_coverage_contigs),
    "count_coverage_nofilter_contigs": every_contig(S.count_coverage_contigs, quality_threshold=0, read_callback="nofilter"),
    "pileup_counts_contigs": every_contig(S.pileup_counts_contigs),
    "pileup_filtered_contigs": every_contig(S.pileup_counts_contigs, min_base_quality=13, min_mapping_quality=10),
    "flag_summary": flag_summary,
    "contig_summary": contig_summary,
    "merge_regions": merge_regions,
    "tile_counts": tile_counts,
    "region_join": region_join,
    "multi_region_fetch": multi_region_fetch,
    "region_any_overlap": region_any_overlap,
    "recount_sites": recount_sites,
    "recount_min_alt": recount_min_alt,
    "recount_lines": recount_lines,
    "sites_text": sites_text,
    "record_lines": record_lines,
    "tag_values": tag_values,
    "genomic_order_dump": genomic_order_dump,
    "read_batches": read_batches,
    "variant_fetch": variant_fetch,
    "variant_open_ended": variant_open_ended,
    "variant_values": variant_values,
    "tags_lookup": tags_lookup,
}

_IN = "reference_name = '{0}' and reference_start < {2} and reference_start + ({3}) > {1}".format(*REGION, _SPAN)
def _merged(regions: str) -> str:
    return f"""r as (select * from ({regions}) x where start < stop), o as (select *, case when start <= max(stop) over (partition by contig order by start, stop rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from r),
 i as (select *, sum(opens) over (partition by contig order by start, stop rows unbounded preceding) as island from o),
 m as (select contig, min(start) as start, max(stop) as stop from i group by contig, island)"""


_MERGED = _merged(D.REGIONS_SQL)
_HITS = f"reference_name = contig and reference_start < stop and reference_start + ({_SPAN}) > start"
_NAMES = "select read_id as query_name"
_OPS = {
    0: (32, "32M", [(0, 32)], 32), 1: (33, "10M2I8M3D12M", [(0, 10), (1, 2), (0, 8), (2, 3), (0, 12)], 32),
    2: (20, "4S20M8S", [(4, 4), (0, 20), (4, 8)], 32), 3: (82, "12M50N20M", [(0, 12), (3, 50), (0, 20)], 32),
    4: (32, "10=2X20=", [(7, 10), (8, 2), (7, 20)], 32), 5: (27, "3H5S27M", [(5, 3), (4, 5), (0, 27)], 32),
    6: (32, "6M1P26M", [(0, 6), (6, 1), (0, 26)], 32),
}
_CIGARS = "(values " + ",".join(
    f"({k},{n},'{text}','{str([list(o) for o in ops]).replace(' ', '')}',{q})" for k, (n, text, ops, q) in _OPS.items()
) + ") as t(k,n,text,ops,q)"
_SITE_PILEUP = """with {reads}, {blocks}, s as ({sites}),
 p as (select site_idx, substr(query_sequence, cast(q + pos0 - lo + 1 as int), 1) as base,
   5 + 2 * (instr('0123456789abcdef', substr(qual_hex, cast(q + pos0 - lo + 1 as int), 1)) - 1) as quality
   from b join s on b.reference_name = s.chrom and pos0 >= lo and pos0 < hi where (flag & {mask}) = 0 and mapping_quality >= {mapq}),
 g as (select * from p where quality >= {quality}),
 c as (select s.*, {sums}, cast(count(base) as bigint) as "DP" from s left join g using (site_idx) group by all),
 f as (select *, case alt when 'A' then "A" when 'C' then "C" when 'G' then "G" else "T" end as "ALT_COUNT" from c)"""


def _sites(mapq: int, quality: int) -> str:
    sums = ", ".join(map(_sum, "ACGT")) + ", cast(coalesce(sum(case when base = 'N' then 1 else 0 end), 0) as bigint) as \"N\""
    return _SITE_PILEUP.format(
        reads=_READS, blocks=_BLOCKS, sites=D.SITES_SQL, mask=A.MASK_PILEUP, mapq=mapq, quality=quality, sums=sums
    )



def _contigs(sql: Callable[[str, int, int], str]) -> str:
    """A region's SQL over the whole of all contigs."""
    return " union all ".join(
        f"select '{name}' as contig, * from ({sql(name, 0, D.CONTIG_LENGTH)}) x" for name in D.CONTIGS
    )


_RUNS = """, e as (select pos, depth, pos - row_number() over (partition by depth order by pos) as run from d)
      select min(pos) as start, cast(count(*) as bigint) as length, depth from e group by depth, run"""
_V = f"v as (select *, case when kind = 2 then 3 else 1 end as ref_len from ({D.VARIANTS_SQL}) x)"
_ALT = "case kind when 0 then 'G' when 1 then 'ATT' when 2 then 'A' when 3 then 'G/T' else null end"

ORACLE_SQL: dict[str, str] = {
    "region_fetch": f"with {_READS} {_NAMES}, flag, reference_start, reference_start + ({_SPAN}) as span_end from a where {_IN}",
    "region_count_nofilter": f"with {_READS} select count(*) as count from a where {_IN}",
    "region_count_all": f"with {_READS} select count(*) as count from a where {_IN} and (flag & {A.MASK_ALL}) = 0",
    "flag_bits": f"with {_READS} {_NAMES}, " + ", ".join(f"(flag & {m}) <> 0 as {f}" for f, m in A.FLAGS.items()) + " from a",
    "cigar_values": f"""with {_READS} {_NAMES}, cast(case when (flag & 4) = 0 then n else 0 end as bigint) as reference_length,
      case when (flag & 4) = 0 then reference_start + n end as reference_end, case when (flag & 4) = 0 then text end as cigarstring,
      case when (flag & 4) = 0 then ops else '[]' end as cigartuples, cast(case when (flag & 4) = 0 then q else 0 end as bigint) as query_on_cigar
      from a join (select * from {_CIGARS}) t using (k)""",
    "cigar_blocks": f"with {_READS}, {_BLOCKS} {_NAMES}, cast(lo as bigint) as lo, cast(hi as bigint) as hi, cast(q as bigint) as q from b",
    "depth_profile": _depth(*WHOLE) + " select * from d",
    "depth_blocks": _depth(*WHOLE) + """, e as (select pos, depth, pos - row_number() over (partition by depth order by pos) as run from d)
      select min(pos) as start, cast(count(*) as bigint) as length, depth from e group by depth, run""",
    "count_coverage": _pileup(*WHOLE, A.MASK_ALL, 15, 0, "ACGT", False),
    "count_coverage_nofilter": _pileup(*REGION, 0, 0, 0, "ACGT", False),
    "pileup_counts": _pileup(*WHOLE, A.MASK_PILEUP, 0, 0, "ACGTN", True),
    "pileup_filtered": _pileup(*REGION, A.MASK_PILEUP, 13, 10, "ACGTN", True),
    "depth_profile_contigs": _contigs(lambda *r: _depth(*r) + " select * from d"),
    "depth_blocks_contigs": _contigs(lambda *r: _depth(*r) + _RUNS),
    "count_coverage_contigs": _contigs(lambda *r: _pileup(*r, A.MASK_ALL, 15, 0, "ACGT", False)),
    "count_coverage_nofilter_contigs": _contigs(lambda *r: _pileup(*r, 0, 0, 0, "ACGT", False)),
    "pileup_counts_contigs": _contigs(lambda *r: _pileup(*r, A.MASK_PILEUP, 0, 0, "ACGTN", True)),
    "pileup_filtered_contigs": _contigs(lambda *r: _pileup(*r, A.MASK_PILEUP, 13, 10, "ACGTN", True)),
    "flag_summary": f"with {_READS} select count(*) as total, " + ", ".join(
        f"cast(count(case when (flag & {m}) <> 0 then 1 end) as bigint) as {f[3:] if f.startswith('is_') else f}" for f, m in A.FLAGS.items()
    ) + " from a",
    "contig_summary": f"with {_READS} select reference_id, reference_name, count(case when (flag & 4) = 0 then 1 end) as mapped, count(case when (flag & 4) <> 0 then 1 end) as unmapped from a group by all",
    "merge_regions": f"with {_merged(D.ORDER_REGIONS_SQL)} select * from m",
    "tile_counts": f"""with {_READS}, t as (select concat('ctg', cast(c as string)) as contig, s * 1000 as start, least(s * 1000 + 1000, {D.CONTIG_LENGTH}) as stop from range(3) x(c), range({-(-D.CONTIG_LENGTH // 1000)}) y(s))
      select contig, start, stop, cast(count(read_id) as bigint) as reads from t left join a on {_HITS} group by all""",
    "region_join": f"with {_READS}, r as ({D.REGIONS_SQL}) {_NAMES}, region_id from a join r on {_HITS}",
    "multi_region_fetch": f"with {_READS}, {_MERGED} {_NAMES}, contig as region_contig, start as region_start, stop as region_stop from a join m on {_HITS}",
    "region_any_overlap": f"with {_READS}, r as ({D.REGIONS_SQL}) {_NAMES} from a where exists (select 1 from r where {_HITS})",
    "recount_sites": _sites(0, 10) + " select site_idx, 's1' as sample, chrom, pos0 + 1 as pos, ref, \"A\", \"C\", \"G\", \"T\", \"N\", \"DP\", \"ALT_COUNT\", alt from f",
    "recount_min_alt": _sites(5, 0) + ' select site_idx, chrom, pos0 + 1 as pos, "DP", "ALT_COUNT", case when "DP" > 0 then cast("ALT_COUNT" as double) / "DP" else 0.0 end as "AF" from f where "ALT_COUNT" >= 2',
    "recount_lines": _sites(0, 10) + """ select 2 * site_idx + 2 as site_idx, concat_ws(chr(9), 's1', chrom, pos0 + 1, ref, "A", "C", "G", "T", "N", "DP", "ALT_COUNT",
      printf('%.6f', case when "DP" > 0 then cast("ALT_COUNT" as double) / "DP" else 0.0 end), alt) as value from f""",
    "sites_text": f"select 2 * site_idx + 2 as site_idx, chrom, pos0, ref, alt from ({D.PART_SITES_SQL}) s",
    "record_lines": f"""with {_READS} select concat('{{"query_name":"', read_id, '","flag":', flag, ',"reference_id":', reference_id, ',"reference_name":"', reference_name,
      '","reference_start":', reference_start, ',"mapping_quality":', mapping_quality, ',"cigar":', case when cigar is null then 'null' else concat('"', cigar, '"') end,
      ',"query_sequence":"', query_sequence, '","next_reference_id":-1,"next_reference_start":-1,"template_length":', k - 3,
      ',"tags":{{"NM":"', mapping_quality, '","RG":"lane', k, '","XS":"', k, ',', flag, '"}}}}') as value from a""",
    "tag_values": f"with {_READS} {_NAMES}, false as has_md, true as has_xx, cast(mapping_quality as bigint) as nm, concat('lane', cast(k as string)) as rg, concat(cast(k as string), ',', cast(flag as string)) as xs, cast(null as varchar) as md from a",
    "genomic_order_dump": f"""with {_READS} {_NAMES}, concat('{{"query_name":"', read_id, '","flag":', cast(flag as string), ',"reference_name":"', reference_name, '","reference_start":', cast(reference_start as string), ',"mapping_quality":', cast(mapping_quality as string), '}}') as line
      from a order by reference_id, reference_start, read_id limit 500""",
    "read_batches": f"with {_READS} {_NAMES}, (row_number() over (order by reference_id, reference_start, read_id) - 1) // 256 as batch from a",
    "variant_fetch": f"""with {_V} select chrom, start + 1 as pos, start, start + ref_len as stop, case when kind <> 4 then id end as id,
      case when kind = 2 then concat(ref1, 'AC') else ref1 end as ref, cast(case kind when 3 then 2 when 4 then 0 else 1 end as integer) as n_alts
      from v where chrom = 'ctg1' and start < 9000 and start + ref_len > 3000""",
    "variant_open_ended": f"""with {_V} select chrom, start + 1 as pos, start + ref_len as stop, concat_ws('/', case when kind = 2 then concat(ref1, 'AC') else ref1 end, {_ALT}) as alleles,
      cast(case when kind <> 3 then size end as float) as qual, case when kind = 1 then 'LowQual,q10' when kind = 4 then '' else 'PASS' end as filter
      from v where chrom = 'ctg2' and start + ref_len > 15000""",
    "variant_values": """select concat('ctg', cast(p_partkey % 3 as string)) as chrom, cast((p_partkey * 53) % 20000 + 1 as bigint) as pos, cast(p_size as int) as info_dp,
      concat('0.', cast(p_partkey % 9 + 1 as string)) as info_af, p_partkey % 7 = 0 as info_db, false as info_ns,
      cast(case when p_partkey % 6 = 0 then null when p_partkey % 2 = 0 then 0 else 1 end as integer) as gt0, cast(1 as integer) as gt1, cast(p_size as int) as dp,
      cast(p_size % 11 as integer) as ad0, cast(case when p_partkey % 8 <> 0 then p_size % 5 end as integer) as ad1 from part""",
    "tags_lookup": """select event_id, json_exists(props, '$.k') as has_k, cast(json_extract_string(props, '$.k') as bigint) as k, json_exists(props, '$.absent') as has_absent from events""",
}
