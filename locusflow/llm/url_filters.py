"""URL filters by a path-template tree of each host; DataFrame operations only.

Rules (host and path, as ``example.com/en/``) judge the urls that they fit; those urls are the labelled ones. A tree of
path templates, grown a level of segments at a time under each host, carries their judgement to the others:

- Variable segments become a wildcard: below a template, a segment keeps its name if at least SUPPORT urls and one in
  SHARE of the urls there have it. So a template has at most SHARE named branches, whatever the number of urls.
- Similar branches are merged: those under one template that lean the same way (Laplace-smoothed share of blocked among
  labelled urls), and whose next segments are alike in kind (a chi-square test of each against their sum, LIMIT, or a
  difference of at most SLACK a url, which no number of urls makes significant). Branches with fewer than SUPPORT
  labelled urls go with the others if those lean one way only.
- A template is rejected if its smoothed share of blocked urls, (blocked + 1) / (labelled + 2), is REJECT or more. Without
  labelled urls it is 1/2: allowed.

Urls are counted by path before anything else is shuffled; counts are summed by the tasks first. Named branches are few,
so a level's names are broadcast if they are small and joined by a shuffle otherwise.

Defined results: a null url or one without ``://`` has an empty host and path. A path of more than DEPTH segments is
taken by its first DEPTH ones and ``**``; empty segments do not count, longer ones than LONGEST are variable. Segments
``*`` and ``**`` of a url are taken for wildcards. Rows that repeat a page_id, and null ids, are rows of their own.
Of rules of one length that fit, the one of the longer host holds. An empty table gives no rows; other columns are not
looked at. Texts are worked on whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small, written

Rule = tuple[str, str]  # allow or block, host and path

DEPTH, LONGEST = 3, 64
SUPPORT, SHARE = 4, 50
LIMIT, SLACK = 9.488, 0.05  # 95 % of a chi-square of 4 degrees of freedom
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
KINDS = 5  # of a segment: none, digits, letters, with digits, other


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; null if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def kind_of(segment: Column) -> Column:
    """A number from 0 to KINDS - 1."""
    rest = F.translate(segment, DIGITS, "")
    letters = F.translate(segment, UPPER + LOWER + "-_", "")
    return (
        F.when(segment.isNull(), 0).when(rest == "", 1).when(letters == "", 2).when(F.length(rest) < F.length(segment), 3)
        .otherwise(4)
    )


def _with_segments(rows: DataFrame) -> DataFrame:
    """Adds s1 .. (null behind the last) and more: the kind of the one behind them."""
    every = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.withColumn("_s", F.slice(every, 1, DEPTH + 1))
    named = {
        f"s{d}": F.when(F.length(F.get("_s", F.lit(d - 1))) > LONGEST, "*").otherwise(F.get("_s", F.lit(d - 1)))
        for d in range(1, DEPTH + 1)
    }
    return rows.withColumns({**named, "more": kind_of(F.get("_s", F.lit(DEPTH)))}).drop("_s")


def _leans(blocked: str, labelled: str) -> tuple[Column, Column]:
    """Whether at least four fifths of the labelled urls, one more of each sort added, are blocked, or allowed."""
    b, n = F.col(blocked), F.col(labelled)
    return 5 * (b + 1) >= 4 * (n + 2), 5 * (n - b + 1) >= 4 * (n + 2)


def _branches(paths: DataFrame, d: int) -> DataFrame:
    """Names of the segments at a level that keep one or are merged: host, template (of the levels above), segment,
    name. paths: template, s1 .., more, n, blocked, labelled."""
    here = paths.filter(F.col(f"s{d}").isNotNull()).withColumnRenamed(f"s{d}", "segment")
    follow = kind_of(F.col(f"s{d + 1}")) if d < DEPTH else F.col("more")
    kinds = [F.sum(F.when(follow == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(KINDS)]
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    above = here.groupBy("host", "template").agg(F.sum("n").alias("urls")).filter(F.col("urls") >= SUPPORT)
    named = (
        here.groupBy("host", "template", "segment").agg(*sums, *kinds)
        .filter((F.col("n") >= SUPPORT) & (F.col("segment") != "*"))
        .join(above, ["host", "template"])
        .filter(F.col("n") * SHARE >= F.col("urls"))
    )
    block, allow = _leans("blocked", "labelled")
    lean = F.when(block, "block").when(allow, "allow").when(F.col("labelled") < SUPPORT, "open").otherwise("mixed")
    siblings = Window.partitionBy("host", "template")  # at most SHARE rows
    leans = F.array_sort(F.collect_set(F.when(F.col("lean").isin("allow", "block"), F.col("lean"))).over(siblings))
    side = F.when((F.col("lean") == "open") & (F.size("leans") == 1), F.get("leans", F.lit(0))).otherwise(F.col("lean"))
    named = named.withColumn("lean", lean).withColumn("leans", leans).withColumn("side", side)
    pool = Window.partitionBy("host", "template", "side")
    total, n = F.sum("n").over(pool).cast("double"), F.col("n").cast("double")
    chi = F.lit(0.0)
    for k in range(KINDS):
        whole, own = F.sum(f"k{k}").over(pool).cast("double"), F.col(f"k{k}").cast("double")
        gap = own * total - n * whole
        chi = chi + F.when(whole > 0, gap * gap / (n * whole * total)).otherwise(0.0)
    named = named.withColumn("like", chi <= F.greatest(F.lit(LIMIT), n * SLACK))
    merged = F.col("like") & (F.count_if("like").over(pool) > 1)
    name = F.when(merged, F.concat(F.lit("+"), "side")).otherwise(F.col("segment"))
    return named.select("host", "template", "segment", name.alias("name"))


def _placed(rows: DataFrame, names: DataFrame, d: int) -> DataFrame:
    """rows with the template of one level more."""
    step = F.when(F.col(f"s{d}").isNull(), "").otherwise(F.concat(F.lit("/"), F.coalesce("name", F.lit("*"))))
    found = rows.join(names.withColumnRenamed("segment", f"s{d}"), ["host", "template", f"s{d}"], "left")
    return found.withColumn("template", F.concat("template", step)).drop("name")


def judged(pages: DataFrame, rules: Sequence[Rule], url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The kept columns, host, path, rule, verdict; template with the counts that its verdict comes from: urls,
    labelled, blocked."""
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = _with_segments(rows).withColumn("template", F.lit(""))
    segments = [f"s{d}" for d in range(1, DEPTH + 1)]
    paths = rows.groupBy("host", "template", *segments, "more").agg(
        F.count("*").alias("n"), F.count_if(F.col("_rule.verdict") == "block").alias("blocked"), F.count("_rule").alias("labelled")
    )
    paths = written(paths, "paths")
    for d in range(1, DEPTH + 1):
        names = small(written(_branches(paths, d), "names"))
        paths, rows = _placed(paths, names, d), _placed(rows, names, d)
    tail = F.concat("template", F.when(F.col("more") > 0, "/**").otherwise(""))
    paths, rows = (x.withColumn("template", tail) for x in (paths, rows))
    templates = paths.groupBy("host", "template").agg(
        F.sum("n").alias("urls"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
    )
    verdict = F.when(_leans("blocked", "labelled")[0], "block").otherwise("allow")
    return rows.join(small(written(templates, "templates")), ["host", "template"]).select(
        *keep, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", verdict).alias("verdict"),
        "template", "urls", "labelled", "blocked",
    )
