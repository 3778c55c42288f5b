"""Url filters and the conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from locusflow.llm import conversation_trie, url_filters
from locusflow.llm.queries import URL_RULES
from locusflow.llm.url_filters import DEPTH, DIGITS, LIMIT, LONGEST, LOWER, SHARE, SLACK, SUPPORT, UPPER, judged

# --- urls


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in host), path


def rule_for(host, path):
    fits = [
        (len(rule), rule, verdict)
        for verdict, rule in URL_RULES
        for name, _, rest in [rule.partition("/")]
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)
    ]
    return max(fits)[1:] if fits else (None, None)


def kind(s):
    if s is None:
        return 0
    if all(c in DIGITS for c in s):
        return 1
    if all(c in UPPER + LOWER + "-_" for c in s):
        return 2
    return 3 if any(c in DIGITS for c in s) else 4


def brute_urls(rows):
    """rows: (page_id, url)."""
    pages = []
    for i, url in rows:
        host, path = split_url(url)
        rule, verdict = rule_for(host, path)
        segments = [s for s in path.split("/") if s]
        cut = ["*" if len(s) > LONGEST else s for s in segments[:DEPTH]] + [None] * (DEPTH - len(segments))
        more = kind(segments[DEPTH] if len(segments) > DEPTH else None)
        pages.append({"id": i, "host": host, "path": path, "rule": rule, "verdict": verdict, "s": cut, "more": more, "t": ""})
    for d in range(DEPTH):
        below = defaultdict(list)
        for p in pages:
            if p["s"][d] is not None:
                below[p["host"], p["t"]].append(p)
        names = {}
        for at, some in below.items():
            count = Counter(p["s"][d] for p in some)
            named = {}
            for s, n in count.items():
                if n >= SUPPORT and s != "*" and n * SHARE >= len(some):
                    own = [p for p in some if p["s"][d] == s]
                    b, l = sum(p["verdict"] == "block" for p in own), sum(p["verdict"] is not None for p in own)
                    lean = "block" if 5 * (b + 1) >= 4 * (l + 2) else "allow" if 5 * (l - b + 1) >= 4 * (l + 2) else "open" if l < SUPPORT else "mixed"
                    kinds = Counter(kind(p["s"][d + 1]) if d + 1 < DEPTH else p["more"] for p in own)
                    named[s] = [n, lean, kinds]
            leans = {x[1] for x in named.values()} & {"allow", "block"}
            sides = defaultdict(list)
            for s, (n, lean, kinds) in named.items():
                sides[next(iter(leans)) if lean == "open" and len(leans) == 1 else lean].append(s)
            for side, group in sides.items():
                whole = sum((named[s][2] for s in group), Counter())
                total = sum(named[s][0] for s in group)
                alike = []
                for s in group:
                    n, _, kinds = named[s]
                    chi = sum((kinds[k] * total - n * whole[k]) ** 2 / (n * whole[k] * total) for k in whole if whole[k])
                    if chi <= max(LIMIT, SLACK * n):
                        alike.append(s)
                for s in group:
                    names[(*at, s)] = "+" + side if s in alike and len(alike) > 1 else s
        for p in pages:
            if p["s"][d] is not None:
                p["t"] += "/" + names.get((p["host"], p["t"], p["s"][d]), "*")
    groups = defaultdict(list)
    for p in pages:
        p["t"] += "/**" if p["more"] else ""
        groups[p["host"], p["t"]].append(p)
    out = []
    for (host, t), some in groups.items():
        b, l = sum(p["verdict"] == "block" for p in some), sum(p["verdict"] is not None for p in some)
        own = "block" if 5 * (b + 1) >= 4 * (l + 2) else "allow"
        out += [(p["id"], host, p["path"], p["rule"], p["verdict"] or own, t, len(some), l, b) for p in some]
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def check_urls(spark, rows):
    got = [tuple(r) for r in judged(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()]
    assert sorted(got, key=key) == sorted(brute_urls(rows), key=key)
    return got


def test_url_filters_equal_plain_python(spark):
    rng = random.Random(4)
    hosts = ["a.net", "b.example.com", "www.example.com", "x.org", "HUB.Net", "com", "notcom", "q.net:80"]
    first = ["en", "es", "fr", "de", "News", "p%20q", ""]
    rows = []
    for i in range(3000):
        host = rng.choice(hosts[:3] if rng.random() < 0.7 else hosts)
        tail = rng.choice([f"{i}", f"{i}.html", f"{i}/", "list", f"y/{i}/z/w/{i}", "", "//", "x" * rng.choice([64, 65])])
        rows.append((i, f"{rng.choice(['http', 'HTTPS'])}://{host}/{rng.choice(first)}/{tail}{rng.choice(['', '?a=/b#c', '#top', '?x://y'])}"))
    got = check_urls(spark, rows)
    assert len({r[5] for r in got if "+" in r[5]}) > 1
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_odd_urls(spark):
    odd = [
        None, "", "no scheme", "://", "http://", "http://a.net", "http://A.NET?x/es/", "a://b://c/es/d", "http://a.net/es",
        "http://a.net/es/", "x://net/es/", "x://.net/es/", "x://anet/es/", "x://ÄÖ.com/É", "x://com/\n/y", "x://com//", "http:///p",
        "x://www.example.com/en/1", "x://a.www.example.com/en/1", "x://example.com/en/1", "x://example.com/EN/1", "x://com/*/**",
    ]
    rows = [(k, u) for k, u in enumerate(odd)] * 2 + [(None, "x://com/a"), (None, None)]
    rows += [(100, "x://com/" + "a/" * 300_000), (101, "x://" + "h" * 1_000_000), (102, "x://net/es/" + "z" * 1_000_000)]
    got = {r[0]: r for r in check_urls(spark, rows)}
    assert got[5][1:4] == ("a.net", "", None) and got[6][1:4] == ("a.net", "", None) and got[17][3:5] == ("www.example.com/en/", "allow")


def test_urls_empty_table_and_clashing_columns(spark):
    check_urls(spark, [])
    df = spark.createDataFrame([(1, "x://net/es/1")], "page_id long, url string")
    odd = df.withColumns({c: F.lit("x") for c in ("host", "path", "template", "s1", "more", "n", "name", "segment", "_rule", "verdict", "urls")})
    assert [r[:5] for r in map(tuple, judged(odd, URL_RULES).collect())] == [(1, "net", "/es/1", "net/es/", "block")]


# --- conversations


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: (*t[:2], t[2].encode(), t[3].encode()))] for c, turns in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].add(c)
        ends[tuple(rebuilt)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, some in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(some) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (
            min(some), len(p), min(members[p[:-1]]) if p else -1, len(some), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, some in members.items()
    )


def check_trie(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_trie.trie(df, **options).na.fill(-1, ["parent_conv_id"]).collect()
    assert sorted(map(tuple, got)) == brute_trie(rows)
    return got


def made(seed, ids, longest):
    rng = random.Random(seed)
    texts = ["hi", "a", "né😀", "", None, "x" * 50]
    rows = []
    for c in ids:
        n = rng.randint(1, longest)
        rows += [(c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else "user", rng.choice(texts)) for t in range(n)]
    rng.shuffle(rows)
    return rows


def test_trie_equals_plain_python(spark):
    ids = [*range(0, 230), 401, 455, -1, -100, -250, -200, 1 << 40]
    assert len(check_trie(spark, made(1, ids, 8))) > 300


def test_trie_of_long_conversations_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 1)
    rows = made(2, [0, 1, 2, 3, 50, 101, 102, 700, 703], 40)
    for c in (200, 205, 300, 309, 900):  # one long conversation of several bases, alike but for an end
        rows += [(c, t, "user", f"turn {t}") for t in range(60)] + [(c, 70 + t, "user", f"own {c}") for t in range(c % 7)]
    got = check_trie(spark, rows, size=8)
    assert max(r.depth for r in got) > 60


def test_trie_of_copies_ties_and_odd_rows(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1500) for t in range(3)]
    rows += [(7, None, "b", "x"), (7, None, "a", "x"), (7, 1, "a", "y"), (7, 1, "a", "y"), (7, 1, None, "z"), (8, 0, "A", "B")]
    rows += [(None, 0, "user", "lost"), (100, 5, None, None), (103, 1, "u", "w" * 1_000_000)]
    check_trie(spark, rows)


def test_trie_empty_table_and_clashing_columns(spark):
    assert check_trie(spark, []) == []
    df = spark.createDataFrame([(3, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    odd = df.withColumns({c: F.lit("x") for c in ("base", "block", "place", "key1", "k", "n", "before", "d1", "chars", "own", "_part")})
    assert len(conversation_trie.trie(odd).collect()) == (2 if zlib.crc32(b"3") % 6 == 0 else 1)
