"""Files, statistics and the facade over generated reads, against plain computations over the same rows."""

import bz2
import gzip
import json
import lzma
import random
import struct
import tracemalloc
from collections import Counter

import files
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

import locusflow
from locusflow.api import AlignmentFile
from locusflow.functions.alignments import ALIGNMENTS, MASK_ALL, MASK_PILEUP
from locusflow.functions.coords import Interval, resolve
from locusflow.operators import regions, stats
from locusflow.sources import bam, cram, dump
from locusflow.sources.tags import Tags

LENGTHS = dict(files.CONTIGS)
NAMES = [n for n, _ in files.CONTIGS]


@pytest.fixture(scope="module", params=["bai", "csi"])
def small(spark, tmp_path_factory, request):
    path = str(tmp_path_factory.mktemp("bam") / "some.bam")
    files.write_bam(path, block=300, index=request.param)
    return AlignmentFile(path, spark=spark)


def of_contig(contig):
    return [r for r in files.RECORDS if r[2] >= 0 and NAMES[r[2]] == contig]


def overlapping(contig, start, stop):
    return [r for r in of_contig(contig) if files.span(r)[0] < stop and files.span(r)[1] > start]


def brute_depth(contig, start, stop):
    n = Counter(p for r in of_contig(contig) if not r[1] & MASK_ALL for p, _ in files.blocks(r))
    return [n[p] for p in range(start, stop)]


def brute_bases(contig, start, stop, mask, quality, mapq=0):
    found = {c: Counter() for c in "ACGTN"}
    for r in of_contig(contig):
        if r[1] & (mask | 4) or r[4] < mapq or r[7] is None:
            continue
        for p, q in files.blocks(r):
            if r[7][q] >= quality:
                found[r[6][q] if r[6][q] in "ACGT" else "N"][p] += 1
    return {c: [n[p] for p in range(start, stop)] for c, n in found.items()}


def test_records_come_back(small):
    got = list(small)
    assert len(got) == len(files.RECORDS)
    for a, r in zip(got, files.RECORDS):
        assert (a.query_name, a.flag, a.reference_id, a.reference_start, a.mapping_quality) == r[:5]
        assert (a.cigarstring or "") == r[5] and a.query_sequence == r[6] and a.query_qualities == (r[7] or [])
        assert (a.next_reference_id, a.next_reference_start, a.template_length) == r[8:11]
        assert {k: v for k, _, v in r[11]} == a.tags and a.is_reverse == bool(r[1] & 16)
        ops = [(files.OPS.index(op), n) for n, op in files.ops_of(r[5])]
        assert a.cigartuples == ops and a.reference_end == (files.span(r)[1] if r[5] else None)
    with pytest.raises(KeyError):
        got[0].get_tag("ZZ")
    assert [r.query_name for r in regions.unplaced(small.dataframe()).collect()] == [r[0] for r in files.RECORDS if r[2] < 0]


def test_header_and_names(small):
    assert small.references == tuple(NAMES) and small.lengths == tuple(LENGTHS.values())
    assert small.header["SQ"][1] == {"SN": "beta", "LN": 900} and small.header["HD"]["SO"] == "coordinate"
    assert [x["ID"] for x in small.header["RG"]] == ["lane0", "lane1"]
    assert locusflow.AlignmentFile is AlignmentFile and locusflow.version() == locusflow.__version__
    with pytest.raises(AttributeError):
        locusflow.nothing


def test_count(small):
    rng = random.Random(5)
    for contig, start, stop in [("alpha", 0, 2600), ("gamma", 0, 70), ("beta", 100, 100)] + [
        (c, s, s + rng.choice([1, 40, 300])) for c in ("alpha", "beta") for s in rng.sample(range(800), 3)
    ]:
        found = overlapping(contig, start, stop) if start < stop else []
        assert small.count(contig, start, stop) == len(found)
        assert small.count(contig, start, stop, read_callback="all") == sum(not r[1] & MASK_ALL for r in found)


def test_depth_blocks(small):
    for contig in ("beta", "gamma"):
        at, want = 0, []
        for n in brute_depth(contig, 0, LENGTHS[contig]):
            if want and want[-1][2] == n:
                want[-1] = (want[-1][0], want[-1][1] + 1, n)
            else:
                want.append((at, 1, n))
            at += 1
        assert small.depth_blocks(contig) == want
    assert small.depth_blocks("alpha", 5, 5) == []


def test_runs_over_tile_borders(spark):
    border = 1 << 14
    rows = [("r1", 0, "c", border - 5, 9, "10M", "ACGTACGTAC", [30] * 10), ("r2", 0, "c", border - 3, 9, "3M2D40000N4M", "ACGTACG", [30] * 7),
            ("r3", 0, "c", 10, 9, "50000M", "A" * 50000, [30] * 50000), ("r4", 0, "c", border, 9, "5M", "ACGNt", [30] * 5)]
    df = spark.createDataFrame(rows, "query_name string, flag int, reference_name string, reference_start long, mapping_quality int, cigar string, query_sequence string, query_qualities array<tinyint>")
    depth, letters = Counter(), Counter()
    for _, _, _, start, _, cigar, seq, _ in rows:
        for p, q in files.blocks((0, 0, 0, start, 0, cigar)):
            depth[p] += 1
            letters[p, seq[q].upper() if seq[q].upper() in "ACGT" else "N"] += 1
    for a, b in ((0, 60_000), (border - 1, border + 1), (border, 2 * border)):
        got = {r.pos: r.depth for r in stats.depth(df, "c", a, b).collect()}
        assert got == {p: depth[p] for p in range(a, b)}
        found = stats.depth_blocks(df, "c", a, b).orderBy("start").collect()
        assert sum(r.length for r in found) == b - a and all(x.depth != y.depth for x, y in zip(found, found[1:]))
        counts = stats.pileup_counts(df, "c", a, b).collect()
        assert len(counts) == b - a and all(r[c] == letters[r.pos, c] for r in counts for c in "ACGTN")


def test_random_regions(small):
    rng = random.Random(20)
    for _ in range(5):
        contig = rng.choice(["alpha", "beta"])
        start = rng.randrange(LENGTHS[contig])
        stop = min(LENGTHS[contig], start + rng.choice([1, 7, 100, 500]))
        assert small.depth_numpy(contig, start, stop).tolist() == brute_depth(contig, start, stop)
        want = brute_bases(contig, start, stop, MASK_PILEUP, 10, 20)
        got = small.pileup_counts(contig, start, stop, min_base_quality=10, min_mapping_quality=20)
        assert {c: got[c].tolist() for c in "ACGTN"} == want
        assert got["depth"].tolist() == [sum(x) for x in zip(*want.values())]
        want = brute_bases(contig, start, stop, MASK_ALL, 15)
        assert [x.tolist() for x in small.count_coverage(contig, start, stop)] == [want[c] for c in "ACGT"]
        assert [a.query_name for a in small.fetch(contig, start, stop)] == [r[0] for r in overlapping(contig, start, stop)]


def test_partitioning_does_not_matter(small):
    df = small.dataframe()
    got = [sorted(map(tuple, stats.pileup_counts(df.repartition(n), "alpha", 0, 700).collect())) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2]


def test_batches_and_parallel_fetch(small):
    n = len(files.RECORDS)
    assert [len(b) for b in small.iter_batches(10)] == [10] * (n // 10) + [n % 10] * (n % 10 > 0)
    assert [a.query_name for b in small.iter_batches(7) for a in b] == [r[0] for r in files.RECORDS]
    wanted = [("alpha", 0, 400), ("alpha", 400, 600), ("alpha", 550, 580), ("beta", 0, 900), ("alpha", 1200, 1300)]
    merged = [("alpha", 0, 600), ("alpha", 1200, 1300), ("beta", 0, 900)]
    got = small.parallel_fetch(wanted)
    assert [a.query_name for a in got] == [r[0] for w in merged for r in overlapping(*w)]
    with pytest.raises(ValueError):
        small.parallel_fetch([("alpha", 5500, 5200)])
    assert list(small.fetch("alpha", 5500, 5200)) == [] and small.parallel_fetch([]) == []


def test_errors(spark, small, tmp_path):
    for call in (
        lambda: small.count("delta"), lambda: small.count("alpha", -1), lambda: small.count("alpha", 50, 40),
        lambda: small.count("alpha", read_callback="other"), lambda: small.depth_numpy("alpha", threads=0),
        lambda: AlignmentFile(small.filename, "wb", spark=spark),
    ):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(OSError):
        AlignmentFile(str(tmp_path / "none.bam"), spark=spark)
    path = str(tmp_path / "plain.bam")
    files.write_bam(path, index=False)
    plain = AlignmentFile(path, spark=spark)
    with pytest.raises(ValueError, match="index"):
        plain.count("alpha")
    assert sum(len(b) for b in plain.iter_batches(100)) == len(files.RECORDS)
    plain.close()
    with pytest.raises(ValueError):
        plain.count("alpha")


def test_equal_rows_and_arrays(spark, tmp_path):
    row = lambda n, at, tags=(): (n, 0, 0, at, 9, "4M", "ACGT", None, -1, -1, 0, list(tags))
    tags = [(f"T{k}", "B" + k, [1, 2]) for k in "cCsSiI"] + [("Tf", "Bf", [1.5, 2.5]), ("TA", "A", "x")]
    path = str(tmp_path / "dup.bam")
    files.write_bam(path, [row("a", 10), row("a", 10), row("b", 10, tags), row("c", 100)])
    f = AlignmentFile(path, spark=spark)
    assert [a.query_name for a in f.parallel_fetch([("alpha", 0, 50)])] == ["a", "a", "b"]
    third = [a for a in f.fetch("alpha", 0, 50)][2]
    assert third.get_tag("Ti").typecode == "i" and list(third.get_tag("Tf")) == [1.5, 2.5] and third.get_tag("TA") == "x"
    assert f.depth_numpy("alpha", 10, 12).tolist() == [3, 3]
    assert f.pileup_counts("alpha", 10, 12)["depth"].tolist() == [0, 0]  # no qualities


@pytest.mark.parametrize("index", ["bai", "csi"])
def test_split_scan_reads_each_record_once(spark, tmp_path, monkeypatch, index):
    rows = [(f"r{k}", 0, 0, k * 700, 9, "10M", "ACGTACGTAC", [30] * 10, -1, -1, 0, []) for k in range(400)]
    rows.insert(200, ("wide", 0, 0, 139_400, 9, "5M60000N5M", "ACGTACGTAC", [30] * 10, -1, -1, 0, []))
    path = str(tmp_path / "big.bam")
    files.write_bam(path, rows, (("alpha", 300_000), ("beta", 10)), block=400, index=index)
    bam.register(spark)
    df = spark.read.format("bam").option("split", "1000").load(path)
    assert df.rdd.getNumPartitions() > 4
    assert [r.query_name for r in df.select("query_name").toLocalIterator()] == [r[0] for r in rows]
    f = AlignmentFile(path, spark=spark)
    for start, stop in ((140_000, 150_000), (190_000, 200_000), (0, 1), (299_000, 300_000)):
        want = [r[0] for r in rows if r[3] < stop and files.span(r)[1] > start]
        assert [a.query_name for a in f.fetch("alpha", start, stop)] == want
    assert f.count("beta") == 0 and f._scan(("beta", 0, 10)).count() == 0
    monkeypatch.setattr(bam, "CHUNK", 100)  # records span chunks of plain bytes
    reader = bam.BamReader({"path": path})
    names = [x for b in reader.read(bam.BamPartition(*_whole(path))) for x in b.column("query_name").to_pylist()]
    assert names == [r[0] for r in rows]


def _whole(path):
    with bam.open_file(path) as file:
        reader = bam.BgzfReader(file)
        bam.read_header(reader)
        return reader.tell(), None


def test_operations_in_a_tag(spark, tmp_path):
    rng = random.Random(4)
    cigar = "".join(f"{rng.randrange(1, 3)}{op}" for _ in range(35_000) for op in ("M", rng.choice("DIN=X")))
    size = sum(n for n, op in files.ops_of(cigar) if op in "MIS=X")
    whole = ("long", 0, 0, 100, 9, cigar, "".join(rng.choice("ACGT") for _ in range(size)), [30] * size, -1, -1, 0, [("NM", "C", 3), ("ZB", "Bs", [1, -2])])
    fake = ("fake", 0, 0, 120, 9, "4S30N", "ACGT", [30] * 4, -1, -1, 0, [("CH", "BI", [64]), ("ZZ", "Z", "CGBI")])  # looks so, has no tag
    both = [whole, fake, ("plain", 0, 0, 130, 9, "20M", "A" * 20, [30] * 20, -1, -1, 0, [("CG", "BI", [16])])]
    path = str(tmp_path / "long.bam")
    files.write_bam(path, both, (("alpha", 300_000),))
    f = AlignmentFile(path, spark=spark)
    got = list(f)
    assert [x.cigarstring for x in got] == [r[5] for r in both]
    assert got[0].tags.keys() == {"NM", "ZB"} and set(got[2].tags) == {"CG"} and [x.reference_end for x in got] == [files.span(r)[1] for r in both]
    n = Counter(p for r in both for p, _ in files.blocks(r))
    stop = files.span(whole)[1]
    assert f.depth_numpy("alpha", 90, stop + 5).tolist() == [n[p] for p in range(90, stop + 5)]
    assert [f.count("alpha", a, a + 1) for a in (99, 100, stop - 1, stop)] == [0, 1, 1, 0]
    pile = f.pileup_counts("alpha", 100, 200)
    want = Counter((p, whole[6][q]) for p, q in files.blocks(whole)) + Counter((p, "A") for p, _ in files.blocks(both[2]))
    assert all(pile[c].tolist() == [want[p, c] for p in range(100, 200)] for c in "ACGT")


@pytest.mark.parametrize("index", ["bai", "csi", None])
def test_regions_by_options_and_by_filters(spark, tmp_path, index):
    rows = [(f"r{k}", 0, int(k >= 300), k % 300 * 700, 9, "10M", "ACGTACGTAC", [30] * 10, -1, -1, 0, []) for k in range(400)]
    rows.insert(200, ("wide", 0, 0, 139_400, 9, "5M60000N5M", "ACGTACGTAC", [30] * 10, -1, -1, 0, []))
    path = str(tmp_path / "big.bam")
    files.write_bam(path, rows, (("alpha", 300_000), ("beta", 300_000)), block=400, index=index)
    bam.register(spark)
    c = F.col
    whole = spark.read.format("bam").option("split", "100").load(path)
    for name, start, stop in (("alpha", 190_000, 200_000), ("beta", 0, 1400), ("alpha", 0, 1), ("gamma", 0, 10)):
        want = [r[0] for r in rows if ["alpha", "beta"][r[2]] == name and r[3] < stop and files.span(r)[1] > start]
        asked = whole.filter((c("reference_name") == name) & (c("reference_start") < stop) & (c("span_end") > start))
        assert [r.query_name for r in asked.select("query_name", "reference_name", "reference_start", "span_end").collect()] == want
        assert [r.query_name for r in regions.fetch(whole, name, start, stop).collect()] == want
        if index and name != "gamma":
            part = spark.read.format("bam").options(split=100, contig=name, start=start, stop=stop).load(path)
            assert [r.query_name for r in regions.fetch(part, name, start, stop).collect()] == want
            assert part.rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    late = whole.filter((c("reference_name") == "alpha") & (c("reference_start") >= 200_000) & (c("reference_start") <= 207_000))
    assert [r.query_name for r in late.collect()] == [r[0] for r in rows if r[2] == 0 and 200_000 <= r[3] <= 207_000]
    assert whole.filter(c("reference_start") < 700).count() == 2 and whole.count() == 401


def plain_tags(data):
    """name: (type, i, f, s, ia, fa)"""
    out, at = {}, 0
    codes = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        value = [kind, None, None, None, None, None]
        if kind in "ZH":
            end = data.index(0, at)
            value[3], at = data[at:end].decode(), end + 1
        elif kind == "A":
            value[3], at = chr(data[at]), at + 1
        elif kind == "B":
            code, (n,) = chr(data[at]), struct.unpack_from("<i", data, at + 1)
            form = f"<{n}{codes[code]}"
            value[0], value[5 if code == "f" else 4] = "B" + code, list(struct.unpack_from(form, data, at + 5))
            at += 5 + struct.calcsize(form)
        else:
            value[2 if kind == "f" else 1] = struct.unpack_from("<" + codes[kind], data, at)[0]
            at += struct.calcsize("<" + codes[kind])
        out[name] = tuple(value)
    return out


def test_tags_of_many_records_equal_one_at_a_time():
    rng = random.Random(6)
    value = {
        "A": lambda: rng.choice("xY*"), "Z": lambda: rng.choice(["", "text", "x" * 300]), "f": lambda: rng.choice([0.5, -2.0]),
        "c": lambda: rng.randrange(-128, 128), "C": lambda: 200, "s": lambda: -30000, "S": lambda: 60000, "i": lambda: -(2**31), "I": lambda: 2**32 - 1,
    }
    records = []
    for k in range(300):
        tags = []
        for j in range(rng.choice([0, 0, 1, 3, 12])):
            name = rng.choice([f"T{'abcdefghijkl'[j]}", "NM", "RG"])
            kind = rng.choice([*value, "B"])
            if kind == "B":
                sub = rng.choice("cCsSiIf")
                tags.append((name, "B" + sub, [value[sub]() for _ in range(rng.choice([0, 1, 7]))]))
            else:
                tags.append((name, kind, value[kind]()))
        records.append(b"".join(files._tag(*t) for t in tags))
    raw = np.frombuffer(b"\0" + b"".join(records) + b"abc", np.uint8)
    ends = 1 + np.cumsum([len(x) for x in records])
    tags = Tags(raw, ends - [len(x) for x in records], ends)
    tags.drop_repeated()
    kind = to_arrow_schema(ALIGNMENTS).field("tags").type
    got = [{name: tuple(v.values()) for name, v in x} for x in tags.column(len(records), kind).to_pylist()]
    assert got == [plain_tags(x) for x in records]
    none = Tags(raw, ends[:0], ends[:0])
    none.drop_repeated()
    assert none.column(0, kind).to_pylist() == [] and Tags(raw, ends[:2], ends[:2]).column(2, kind).to_pylist() == [[], []]


@pytest.mark.parametrize("index", ["bai", "csi", None])
def test_unplaced_reads_are_read_from_the_end(spark, tmp_path, index):
    placed = [(f"r{k}", 0, 0, k * 100, 9, "10M", "ACGTACGTAC", [30] * 10, -1, -1, 0, []) for k in range(500)]
    lost = [(f"u{k}", 4, -1, -1, 0, "", "ACGT", [9] * 4, -1, -1, 0, []) for k in range(30)]
    path = str(tmp_path / "x.bam")
    files.write_bam(path, placed + lost, (("alpha", 300_000),), block=500, index=index)
    f = AlignmentFile(path, spark=spark)
    assert [r.query_name for r in f.unplaced_df().collect()] == [r[0] for r in lost]
    if index:
        reader = bam.BamReader({"path": path, "unplaced": "true"})
        whole = bam.BamReader({"path": path})
        at = [r.partitions()[0].begin for r in (whole, reader)]
        assert at[1] > at[0] and [n for p in reader.partitions() for b in reader.read(p) for n in b["query_name"].to_pylist()] == [r[0] for r in lost]


def test_json_lines_with_their_header(spark, small, tmp_path):
    header = bam.header_of(small.filename)
    dump.write_json_lines(small.dataframe(), str(tmp_path / "out"), header)
    lines = [x for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text().splitlines()]
    first, *rest = map(json.loads, lines)
    assert first["references"] == NAMES and [x["query_name"] for x in rest] == [r[0] for r in files.RECORDS]
    assert all(x["tags"].get("RG") == dict((k, v) for k, _, v in r[11]).get("RG") for x, r in zip(rest, files.RECORDS))


def test_cram_is_recognised(spark, tmp_path):
    assert cram.is_cram_path("a/B.CRAM") and not cram.is_cram_path("a.bam")
    (tmp_path / "x.fa").write_text(">alpha\nACGT\n")
    assert cram.sibling_fasta(str(tmp_path / "x.cram")) == str(tmp_path / "x.fa") and cram.sibling_fasta(str(tmp_path / "y.cram")) is None
    for mode in ("rb", "rc"):
        with pytest.raises((OSError, ValueError)):
            AlignmentFile(str(tmp_path / "y.cram"), mode, spark=spark)


def _itf8(x):
    if x < 0x80:
        return bytes([x])
    if x < 0x4000:
        return bytes([0x80 | x >> 8, x & 255])
    return bytes([0xC0 | x >> 16, x >> 8 & 255, x & 255])


@pytest.mark.parametrize("major,method", [(3, 0), (3, 1), (2, 1), (3, 2), (3, 3)])
def test_header_of_a_cram_file(tmp_path, major, method):
    text = "@HD\tVN:1.6\n@SQ\tSN:alpha\tLN:2600\tM5:x:y\n" + "".join(f"@SQ\tSN:c{k}\tLN:{k + 1}\n" for k in range(900)) + "@RG\tID:lane0\n"
    plain = struct.pack("<i", len(text)) + text.encode() + b"\0" * 50
    packed = [bytes, gzip.compress, bz2.compress, lzma.compress][method](plain)
    crc = b"crc." if major >= 3 else b""
    block = bytes([method, 0]) + _itf8(0) + _itf8(len(packed)) + _itf8(len(plain)) + packed + crc
    container = _itf8(0) * 4 + b"\0\0" + _itf8(1) + _itf8(1) + _itf8(0) + crc
    path = tmp_path / "x.cram"
    path.write_bytes(b"CRAM" + bytes([major, 0]) + b"name".ljust(20, b"\0") + struct.pack("<i", len(block)) + container + block)
    header = cram.header_of(str(path))
    assert header.names[:2] == ["alpha", "c0"] and header.lengths[0] == 2600 and len(header.names) == 901
    assert header.to_dict()["SQ"][0] == {"SN": "alpha", "LN": 2600, "M5": "x:y"} and header.to_dict()["RG"] == [{"ID": "lane0"}]
    path.write_bytes(b"CRUM" + bytes(60))
    with pytest.raises(OSError):
        cram.header_of(str(path))


def test_intervals():
    with pytest.raises(ValueError):
        Interval.of(5, 4)
    assert Interval.of(4, 4).is_empty and Interval.of(4, 4).to_1based() is None
    assert Interval.of_1based(1, 10) == (0, 10) and Interval(0, 10).to_1based() == (1, 10)
    assert Interval(0, 10).overlap(8, 20) == (8, 10) and Interval(0, 10).overlap(10, 20) is None
    assert resolve(LENGTHS, "beta", 1500, 1200) == ("beta", 900, 900)


def test_memory_of_sums_does_not_follow_their_number():
    from locusflow.functions.runs import Tally

    rng = np.random.default_rng(3)
    blocks = [(rng.integers(0, 3, 200_000) << 39) + rng.integers(0, 150_000, 200_000) for _ in range(30)]
    tally, sent, want = Tally(), [], Counter()
    tracemalloc.start()
    try:
        for block in blocks:
            sent.append(tally.add(block.copy()))
        sent.append(tally.take())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
    for keys, sums in filter(None, sent):
        assert (keys[1:] > keys[:-1]).all()
        want.update(dict(zip(keys.tolist(), sums.tolist())))
    keys, sums = np.unique(np.concatenate(blocks), return_counts=True)
    assert want == dict(zip(keys.tolist(), sums.tolist()))
    mixed = Tally(6)
    assert mixed.add(np.array([5, 3, 5])) is None and mixed.add(np.array([3, 9]), np.array([-1, 4])) is None
    assert [x.tolist() for x in mixed.take()] == [[3, 5, 9], [0, 2, 4]] and len(mixed.take()[0]) == 0
