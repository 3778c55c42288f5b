"""The queries opN_<name> over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, with_severity

    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return with_severity(documents, model, keep=["doc_id"])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens
    from .token_files import rank_encoder

    encoder = rank_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return count_tokens(table(spark, sf_dir, "documents"), encoder, separator=50256)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import neighbour_fingerprints

    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE, digest, with_spans

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = found.withColumn(
        "base", F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    )
    return base.select(
        "doc_id",
        *[count(r.kind) for r in BASE],
        F.sha2(digest("base"), 256).alias("base_sha256"),
        digest().alias("spans"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import written
    from .mixing import mix

    def at(k: int):
        return F.round(F.get("positions", F.lit(k))["position"], 6)

    mixed = written(mix(table(spark, sf_dir, "documents")), "mixed")
    return (
        mixed.select("doc_id", "size", "source_size", "target", "taken", at(0).alias("position"), at(1).alias("position_again"))
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


OP4_SQL = r"""
with d as (
  select doc_id, source, md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), md5(text))) as key,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents
), s as (
  select source, cast(sum(size) as bigint) as n, row_number() over (order by source nulls last) - 1 as rank,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w
  from d group by source
), k as (
  select *, 2.0::double * n / w as knot,
    coalesce(sum(2.0::double * n) over (order by 2.0::double * n / w, w, source rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(w) over (order by 2.0::double * n / w, w, source rows between current row and unbounded following) as free_w,
    1.5::double * sum(n) over () as goal
  from s
), l as (
  select arg_min((goal - capped) / free_w, knot) as level from k where (goal - capped) / free_w <= knot
), t as (
  select source, n, rank, least(2.0::double * n, w * level) as target from k, l
), f as (
  select source, i, w * case when rank % 2 = 1 then 0.5 + (i + 0.5) / 64 else 1.5 - (i + 0.5) / 64 end as factor from s, range(64) r(i)
), h as (
  select source, i, factor / sum(factor) over (partition by i) as part from f
), g as (
  select source, i, sum(part) over (partition by source order by i) / sum(part) over (partition by source) as y from h
), c as (
  select source, list_concat([0.0::double], list(y order by i)) as curve from g group by source
), o as (
  select d.doc_id, d.size, t.source, t.n as source_size, t.target,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.size
      rows between unbounded preceding and 1 preceding), 0) as c
  from d join t on d.source is not distinct from t.source
), e as (
  select *, greatest(0, least(size, floor(target) - c)) as one, greatest(0, least(size, floor(target) - c - source_size)) as two,
    case when target > 0 then least(1.0, c / target) else 0.0 end as x1,
    case when target > 0 then least(1.0, (c + source_size) / target) else 0.0 end as x2
  from o
), q as (
  select e.*, curve, greatest(1, least(64, len(list_filter(curve, lambda v: v <= x1)))) as k1,
    greatest(1, least(64, len(list_filter(curve, lambda v: v <= x2)))) as k2
  from e join c on e.source is not distinct from c.source
)
select doc_id, size, source_size, target, cast(one + two as bigint) as taken,
  case when one > 0 then round((k1 - 1 + case when curve[k1 + 1] > curve[k1] then (x1 - curve[k1]) / (curve[k1 + 1] - curve[k1]) else 0 end) / 64, 6) end as position,
  case when two > 0 then round((k2 - 1 + case when curve[k2 + 1] > curve[k2] then (x2 - curve[k2]) / (curve[k2 + 1] - curve[k2]) else 0 end) / 64, 6) end as position_again
from q
"""


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import quantised, top_k

    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


OP5_SQL = """
with v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as q
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as (
  select a.row, a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.row <> b.row and len(a.q) = len(b.q)
  where a.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by row order by score desc, vec_id) as integer) as rank, vec_id, score
  from p
)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .language_id import fit, with_language

    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(documents.filter(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return with_language(
        documents.select("doc_id", "text", held_out.alias("held_out")), model, keep=["doc_id", "held_out"]
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import byte_encoder, read_documents, write_token_files

    encoder = byte_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(write_token_files(table(spark, sf_dir, "documents"), encoder, end=2))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import with_tokens

    file = public_tokenizers.path("word_bpe_49k.json")
    return with_tokens(table(spark, sf_dir, "documents"), file, keep=["doc_id"]).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine
    from .maxscore import quantised

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = quantised(table(spark, sf_dir, "embeddings"), label=label)
    return mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


OP11_SQL = """
with v as materialized (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as materialized (
  select a.row as anchor, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.row <> b.row and len(a.q) = len(b.q)
  where a.vec_id % 100 = 0
), p as (
  select anchor, anchor_id, vec_id as positive_id, score as positive_score, cast(row_number() over (partition by anchor order by score desc, vec_id) as integer) as positive_rank
  from s where same
), n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    cast(row_number() over (partition by p.anchor, positive_rank order by s.score desc, s.vec_id) as integer) as rank
  from p join s on p.anchor = s.anchor and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
  where positive_rank <= 5
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank from n where rank <= 10
"""


URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judged

    return judged(table(spark, sf_dir, "pages"), URL_RULES)


def _op12_sql() -> str:
    from .url_filters import DEPTH, DIGITS, KINDS, LIMIT, LONGEST, LOWER, SHARE, SLACK, SUPPORT, UPPER

    def kind(s: str) -> str:
        return (f"case when {s} is null then 0 when translate({s}, '{DIGITS}', '') = '' then 1 when translate({s}, '{UPPER}{LOWER}-_', '') = '' then 2 "
                f"when length(translate({s}, '{DIGITS}', '')) < length({s}) then 3 else 4 end")

    cases = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{verdict}:{h}/{p}'"
        for verdict, rule in sorted(URL_RULES, key=lambda r: (-len(r[1]), -r[1].find("/")))
        for h, _, p in [rule.partition("/")]
    )
    sums = "sum(n) as n, sum(blocked) as blocked, sum(labelled) as labelled"
    steps = [
        f"""r as (select *, case {cases} end as fit from (select page_id,
          case when instr(url, '://') > 0 then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0), '{UPPER}', '{LOWER}') else '' end as host,
          case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from pages))""",
        "s as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as s from r)",
        "t0 as (select *, '' as template, 1 as n, case when fit like 'block:%' then 1 else 0 end as blocked, case when fit is null then 0 else 1 end as labelled, "
        + ", ".join(f"case when length(s[{d}]) > {LONGEST} then '*' else s[{d}] end as s{d}" for d in range(1, DEPTH + 1))
        + f", {kind(f's[{DEPTH + 1}]')} as more from s)",
    ]
    for d in range(1, DEPTH + 1):
        follow = kind(f"s{d + 1}") if d < DEPTH else "more"
        kinds = ", ".join(f"sum(case when {follow} = {k} then n else 0 end) as k{k}" for k in range(KINDS))
        chi = " + ".join(
            f"case when w{k} > 0 then (k{k}::double * total - n::double * w{k}) * (k{k}::double * total - n::double * w{k}) / (n::double * w{k} * total) else 0.0 end"
            for k in range(KINDS)
        )
        pooled = ", ".join(f"sum(k{k}) over pool::double as w{k}" for k in range(KINDS))
        steps += [
            f"g{d} as (select host, template, s{d} as segment, {sums}, {kinds} from t{d - 1} where s{d} is not null group by all)",
            f"h{d} as (select *, sum(n) over (partition by host, template) as urls from g{d})",
            f"""l{d} as (select *, case when 5 * (blocked + 1) >= 4 * (labelled + 2) then 'block' when 5 * (labelled - blocked + 1) >= 4 * (labelled + 2) then 'allow'
              when labelled < {SUPPORT} then 'open' else 'mixed' end as lean from h{d} where n >= {SUPPORT} and segment <> '*' and n * {SHARE} >= urls)""",
            f"""m{d} as (select *, case when lean = 'open' and a + b = 1 then case when a = 1 then 'allow' else 'block' end else lean end as side from (
              select *, max(case when lean = 'allow' then 1 else 0 end) over (partition by host, template) as a, max(case when lean = 'block' then 1 else 0 end) over (partition by host, template) as b from l{d}))""",
            f"p{d} as (select *, sum(n) over pool::double as total, {pooled} from m{d} window pool as (partition by host, template, side))",
            f"c{d} as (select *, {chi} <= greatest({LIMIT}, n::double * {SLACK}) as alike from p{d})",
            f"n{d} as (select host, template, segment, case when alike and count(case when alike then 1 end) over (partition by host, template, side) > 1 then '+' || side else segment end as name from c{d})",
            f"""t{d} as (select t.* exclude (template), t.template || case when s{d} is null then '' else '/' || coalesce(name, '*') end as template
              from t{d - 1} t left join n{d} n on t.host = n.host and t.template = n.template and s{d} = segment)""",
        ]
    return "with " + ", ".join(steps) + f""", z as (select *, template || case when more > 0 then '/**' else '' end as whole from t{DEPTH}),
      y as (select host, whole, {sums} from z group by all)
      select page_id, z.host, path, split_part(fit, ':', 2) as rule, coalesce(split_part(fit, ':', 1), case when 5 * (y.blocked + 1) >= 4 * (y.labelled + 2) then 'block' else 'allow' end) as verdict,
        z.whole as template, cast(y.n as bigint) as urls, cast(y.labelled as bigint) as labelled, cast(y.blocked as bigint) as blocked
      from z join y on z.host = y.host and z.whole = y.whole"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import trie

    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
with t as materialized (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), crc as (
  select conv_id, xor(list_reduce(range(8 * length(name)), lambda s, i: xor(
      (case when i % 8 = 0 then xor(s, ord(name[cast(i // 8 + 1 as integer)])) else s end) >> 1,
      3988292384 * ((case when i % 8 = 0 then xor(s, ord(name[cast(i // 8 + 1 as integer)])) else s end) & 1)), 4294967295::bigint), 4294967295::bigint) % 6 as h
  from (select distinct conv_id, cast(conv_id as varchar) as name from t)
), r as (
  select c.conv_id, b.k, b.role, b.text from crc c join t b on b.conv_id = c.conv_id - c.conv_id % 100 and b.k <= h
  union all select c.conv_id, t.k, role, text from crc c join t using (conv_id) where t.k > h
), o as (
  select *, row_number() over (partition by conv_id order by k) as pos from r
), p as materialized (
  select conv_id, pos, length(text) as chars, list(length(role) || ':' || role || length(text) || ':' || text) over (partition by conv_id order by pos) as path from o
  union all select conv_id, 0, 0, [] from crc
), q as materialized (
  select conv_id, pos, chars, sha256(array_to_string(path, ',')) as key, sha256(array_to_string(path[:-2], ',')) as above from p
), n as materialized (
  select pos, key, any_value(above) as above, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs from q group by pos, key
), c as materialized (
  select n.*, (select count(*) from n m where m.pos = n.pos + 1 and m.above = n.key) as n_children,
    (select conv_id from n m where m.pos = n.pos - 1 and m.key = n.above) as parent_conv_id from n
), s as (
  select q.pos, q.key, count(case when x.n_children = 0 then 1 end) as n_leaves, sum((x.n_convs - 1) * x.chars) as saved_tokens
  from c x join q on q.conv_id = x.conv_id and q.pos <= x.pos group by q.pos, q.key
), e as (
  select pos, key, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ends
  from q where (conv_id, pos) in (select (conv_id, max(pos)) from q group by conv_id) group by pos, key
)
select c.conv_id, cast(c.pos as bigint) as depth, parent_conv_id, n_convs, n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens,
  sha256(coalesce(ends, '')) as ends_sha256
from c join s using (pos, key) left join e using (pos, key)
"""


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_fingerprints": op3_fingerprints,
    "op4_mixing": op4_mixing,
    "op5_maxscore": op5_maxscore,
    "op6_language_id": op6_language_id,
    "op7_token_files": op7_token_files,
    "op8_bpe_encoding": op8_bpe_encoding,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_secret_scans": op10_secret_scans,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filters": op12_url_filters,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": OP4_SQL,
    "op5_maxscore": OP5_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_url_filters": _op12_sql(),
    "op13_conversation_trie": OP13_SQL,
}
