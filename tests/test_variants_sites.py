"""Variant files of four kinds, candidate sites, recounts and the command line."""

import random
import struct

import files
import numpy as np
import pytest

from locusflow import cli
from locusflow.api import VariantFile
from locusflow.operators import recount
from locusflow.sources import bam, bgzf, sites, vcf
from locusflow.sources.bgzf import compress


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    return files.write_variants(tmp_path_factory.mktemp("vcf"))


def value(key, values):
    number, kind = files._META[key]
    if kind == "Flag":
        return True
    found = tuple(float(np.float32(x)) if kind == "Float" else x for x in values)
    return found[0] if number == "1" else found


@pytest.mark.parametrize("kind", range(4))
def test_variants(spark, paths, kind):
    with VariantFile(paths[kind], spark=spark) as f:
        assert f.samples == ["one", "two"] and f.header.lengths == dict(files.CONTIGS)
        got = list(f)
        assert len(got) == len(files.VARIANTS)
        for v, w in zip(got, files.VARIANTS):
            contig, pos, name, ref, alts, qual, filters, info, samples = w
            assert (v.chrom, v.pos, v.start, v.id, v.ref, v.alts) == (files.CONTIGS[contig][0], pos, pos - 1, name, ref, tuple(alts))
            assert v.alleles == (ref, *alts) and v.stop == files.variant_stop(w) and v.filter == filters
            assert v.qual == (None if qual is None else float(np.float32(qual)))
            assert v.info == {k: value(k, x) for k, x in info.items()}, (v.info, info)
            assert len(v.samples) == 2
            for name, (gt, dp, ad) in zip(("one", "two"), samples):
                assert v.samples[name] == {"GT": gt[:2], "DP": dp, "AD": tuple(ad)}
        with pytest.raises(KeyError):
            got[0].samples[-1]
        for region in (("alpha", 0, 300), ("alpha", 900, 901), ("alpha", 500, 500), ("beta", 100, 800), ("beta",), ("gamma",), ("alpha", 1000)):
            start, stop = (*region[1:], *[0, 3000][len(region) - 1 :])[:2]
            want = [v[1] for v in files.VARIANTS if files.CONTIGS[v[0]][0] == region[0] and start < stop and v[1] - 1 < stop and files.variant_stop(v) > start]
            assert [v.pos for v in f.fetch(*region)] == want, region
        for bad in (("delta",), ("alpha", -1, 5), ("alpha", 9, 5)):
            with pytest.raises(ValueError):
                f.fetch(*bad)


def test_a_region_reads_a_part_of_an_indexed_file(spark, paths):
    for path in paths[1:]:
        whole, part = vcf.read_lines(spark, path), vcf.read_lines(spark, path, "beta", 0, 200)
        assert 0 < part.filter("value not like '#%'").count() < whole.filter("value not like '#%'").count() / 2
        assert vcf.read_lines(spark, path, "gamma", 0, 70).filter("value not like '#%'").count() == 0


@pytest.mark.parametrize("block", [37, 400, 60_000])
def test_lines_of_splits_are_those_of_the_file(spark, tmp_path, block):
    lines = [f"line {k} " + "x" * (k * 37 % 300) for k in range(150)] + ["", "", "last"]
    path = str(tmp_path / "lines.vcf.gz")
    data = ("\n".join(lines) + "\n").encode()
    packed = bgzf.compress(data[:5000], block) + bgzf.compress(data[5000:], block)  # an empty member inside
    with open(path, "wb") as f:
        f.write(packed)
    bgzf.register(spark)
    for split in (100, 777, 1 << 30):
        df = spark.read.format("bgzf_lines").option("split", str(split)).load(path)
        assert [r.value for r in df.toLocalIterator()] == lines


def test_missing_values_and_open_ends(spark, tmp_path):
    path = tmp_path / "plain.vcf"
    path.write_text(
        "##fileformat=VCFv4.2\n##contig=<ID=q>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n"
        "q\t10\tx;y\tA\t.\t.\t.\tDB;X=.;AC=1;ZZ=007\tGT:AD\t./1:3\t.:.\nq\t20\t.\tAC\tA\t1\tPASS\tEND=40\t.\n"
    )
    f = VariantFile(str(path), spark=spark)
    assert [v.pos for v in f.fetch("q")] == [10, 20] and [v.pos for v in f.fetch("q", 0, 15)] == [10]
    first, second = f.fetch()
    assert first.alts == () and first.qual is None and first.filter == []
    assert first.info == {"DB": True, "AC": (1,), "ZZ": "007"}  # reserved keys have their types, others are texts
    assert first.id == "x;y" and first.samples["A"] == {"GT": (None, 1), "DP": None, "AD": (3,)}
    assert second.stop == 40 and len(second.samples) == 0
    with pytest.raises(ValueError):
        VariantFile(str(tmp_path / "x.txt"), spark=spark)


def plain_counts(contig, pos0, quality=0, mapq=0):
    found = dict.fromkeys("ACGTN", 0)
    for r in files.RECORDS:
        if r[2] >= 0 and files.CONTIGS[r[2]][0] == contig and not r[1] & 0xF04 and r[4] >= mapq and r[7]:
            for p, q in files.blocks(r):
                if p == pos0 and r[7][q] >= quality:
                    found[r[6][q] if r[6][q] in "ACGT" else "N"] += 1
    return found


def test_recount(spark, tmp_path, capsys):
    path, where = str(tmp_path / "some.bam"), tmp_path / "sites.bed"
    files.write_bam(path)
    at = sorted({p for r in files.RECORDS[:12] if not r[1] & 0xF04 for p, _ in list(files.blocks(r))[:3]})
    bed = [(p, "ACGT"[p % 4], "CGTA"[p % 4]) for p in at]
    text = "chrom\tstart\tstop\tx\n#c\n\n" + "".join(f"alpha\t{p}\t{p + 1}\t{a}>{b}\n" for p, a, b in bed)
    text += f"alpha\t{at[0]}\t{at[0] + 1}\tA>CC\nalpha\t{at[0] + 1}\tA\tC\nbeta\t890\tG\tA\n"
    where.write_text(text)
    for quality, mapq in ((0, 0), (20, 30)):
        got = recount.recount(bam.read_bam(spark, path), sites.read_sites(spark, str(where)), "s", quality, mapq).orderBy("site_idx").collect()
        want = [("alpha", p, a, b) for p, a, b in bed] + [("alpha", at[0], "A", "CC"), ("alpha", at[0], "A", "C"), ("beta", 889, "G", "A")]
        assert len(got) == len(want) and [r.site_idx for r in got] == list(range(3, 3 + len(want)))
        for r, (contig, p, a, b) in zip(got, want):
            n = plain_counts(contig, p, quality, mapq)
            assert (r.chrom, r.pos, r.ref, r.alt) == (contig, p + 1, a, b) and {c: r[c] for c in "ACGTN"} == n
            alt = n[b] if len(b) == 1 else 0
            assert r.DP == sum(n.values()) and r.ALT_COUNT == alt and r.AF == (alt / r.DP if r.DP else 0.0)
    assert cli.main(["recount", "--bam", path, "--sites", str(where), "--sample", "s"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == len(want) + 1 and lines[1].split("\t")[:4] == ["s", "alpha", str(at[0] + 1), bed[0][1]]
    assert cli.main(["dump-records", "--bam", path, "--limit", "2"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    where.write_text("alpha\t0\tA\tC\n")
    with pytest.raises(Exception, match="invalid site in line 1"):
        sites.read_sites(spark, str(where)).collect()


def test_sites_are_numbered_across_splits(spark, tmp_path):
    where = tmp_path / "many.tsv"
    where.write_text("".join(f"c\t{k + 1}\tA\tC\n" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sites.read_sites(spark, str(where)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.site_idx, r.pos0) for r in got) == [(k, k) for k in range(3000)]


def test_output_table(spark, tmp_path):
    path = str(tmp_path / "some.bam")
    files.write_bam(path)
    p = next(p for r in files.RECORDS if not r[1] & 0xF04 and r[2] == 0 and r[7] for p, _ in files.blocks(r))
    n = plain_counts("alpha", p)
    table = spark.createDataFrame([(0, "alpha", p, "A", "A")], "site_idx long, chrom string, pos0 long, ref string, alt string")
    recount.to_tsv(recount.recount(bam.read_bam(spark, path), table, "s").coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    depth = sum(n.values())
    row = ["s", "alpha", p + 1, "A", *[n[c] for c in "ACGTN"], depth, n["A"], f"{n['A'] / depth:.6f}", "A"]
    assert text == "\t".join(recount.OUTPUT) + "\n" + "\t".join(map(str, row)) + "\n"


def test_parts_of_a_table_follow_each_other(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = [(k, "s", "c", k + 1, "A", *[k % 5] * 5, 5 * (k % 5), k % 5, 0.25, "C") for k in range(3000)]
    form = "site_idx long, sample string, chrom string, pos long, ref string, A long, C long, G long, T long, N long, DP long, ALT_COUNT long, AF double, alt string"
    df = spark.createDataFrame(rows, form).repartition(7)
    out = tmp_path / "out"
    want = "\t".join(recount.OUTPUT) + "\n" + "".join("\t".join([*map(str, r[1:12]), f"{r[12]:.6f}", r[13]]) + "\n" for r in rows)
    recount.to_tsv(df, str(out))
    parts = sorted(x.name for x in out.iterdir())
    assert len(parts) > 3 and all(x.startswith("part-") for x in parts) and "".join((out / x).read_text() for x in parts) == want
    with pytest.raises(FileExistsError):
        recount.to_tsv(df, str(out))
    recount.to_tsv(df.filter("site_idx < 1000"), f"file://{out}", "overwrite")
    assert "".join(x.read_text() for x in sorted(out.iterdir())) == "".join(want.splitlines(True)[:1001])
    recount.to_tsv(df.filter("site_idx >= 1000"), str(out), "append")
    assert "".join(x.read_text() for x in sorted(out.iterdir())) == want
    recount.to_tsv(df.limit(0), str(tmp_path / "none"))
    assert "".join(x.read_text() for x in sorted((tmp_path / "none").iterdir())) == "\t".join(recount.OUTPUT) + "\n"


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from locusflow.sources.lines import write_lines

    out = tmp_path / "out"
    df = spark.range(100, numPartitions=4).selectExpr("if(id = 77, raise_error('bad row'), cast(id as string)) as value")
    with pytest.raises(Exception, match="bad row"):
        write_lines(df, str(out), "head")
    assert not out.exists() or list(out.iterdir()) == []


def test_typed_info_over_all_kinds_of_files(spark, tmp_path):
    from locusflow.api import VariantFile

    found = []
    for path in files.write_variants(tmp_path):
        f = VariantFile(path, spark=spark)
        df = f.typed_dataframe()
        kinds = {x.name: x.dataType.simpleString() for x in df.schema["info"].dataType}
        assert (kinds["DP"], kinds["AF"], kinds["NOTE"], kinds["SHIFT"], kinds["FLAT"]) == ("int", "array<float>", "string", "array<int>", "boolean")
        rare = df.filter("info.AF[0] > 0.1 and info.DP < 200").select("chrom", "pos")
        found.append(sorted(map(tuple, rare.collect())))
        assert [(r.info.DP, r.info.SHIFT, r.info.FLAT, r.info.NOTE) for r in df.collect()] == [
            (v[7]["DP"][0], v[7].get("SHIFT"), True if "FLAT" in v[7] else None, v[7].get("NOTE", [None])[0]) for v in files.VARIANTS]
    want = sorted((files.CONTIGS[v[0]][0], v[1]) for v in files.VARIANTS if v[7].get("AF", [0])[0] > 0.1 and v[7]["DP"][0] < 200)
    rows = [[r.asDict(recursive=True) for r in VariantFile(path, spark=spark).typed_dataframe().collect()] for path in files.write_variants(tmp_path)]
    assert rows[0] == rows[1] == rows[2] == rows[3]
    assert found == [want] * 4 and 0 < len(want) < len(files.VARIANTS)
    line = "alpha\t5\t.\tA\tC\t.\t.\tDP=x7;AF=0.5,.;ODD=1,2;NS=3\t.\t"
    row = vcf.with_typed_info(vcf.parse(spark.createDataFrame([(line,)], "value string")), vcf.read_header(files.write_variants(tmp_path)[0])).first()
    assert row.info.DP is None and row.info.AF == [0.5, None] and row.info.NS == 3 and row.more_info == {"ODD": "1,2"}


def _value(rng, kind, n):
    """Bytes of a typed value, some of it missing or cut short."""
    if kind == 7:
        text = rng.choice([b"", b".", b"deep", b"a,b,.", b"x" * rng.choice([14, 15, 300])])
        return _head(7, len(text)) + text
    if kind == 5:
        bits = [rng.choice([0x7F800001, struct.unpack("<I", struct.pack("<f", rng.choice([0.5, -2.25, 0.1, 1e-7])))[0]]) for _ in range(n)]
        return _head(5, n) + struct.pack(f"<{n}I", *_cut(rng, bits, 0x7F800002))
    code, low = {1: ("b", -128), 2: ("h", -32768), 3: ("i", -(2**31))}[kind]
    values = [low if rng.random() < 0.3 else rng.randrange(-100, 100) for _ in range(n)]
    return _head(kind, n) + struct.pack(f"<{n}{code}", *_cut(rng, values, low + 1))


def _cut(rng, values, end):
    keep = rng.randrange(1, len(values) + 1) if len(values) > 1 and rng.random() < 0.4 else len(values)
    return values[:keep] + [end] * (len(values) - keep)


def _head(kind, n):
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind, 1 << 4 | 2]) + struct.pack("<h", n)


@pytest.mark.parametrize("seed", [1, 2])
def test_columns_of_bcf_equal_its_text(spark, tmp_path, seed):
    from locusflow.sources import bcf

    rng = random.Random(seed)
    head, _ = files.bcf_bytes()
    key = {k: i for i, k in enumerate(files.KEYS)}
    records = []
    for k in range(400):
        alts = [rng.choice(["C", "GT", "<DEL>", "*"]) for _ in range(rng.choice([0, 1, 1, 3]))]
        ref = rng.choice(["A", "ACGT" * 5])
        chosen = rng.sample(["DP", "AF", "NOTE", "SHIFT", "FLAT", "END"], rng.randrange(6))
        info = b""
        for name in chosen:
            info += _head(1, 1) + bytes([key[name]])
            info += {"DP": lambda: _value(rng, rng.choice([1, 2, 3]), 1), "AF": lambda: _value(rng, 5, rng.choice([1, 2, 20])),
                     "NOTE": lambda: _value(rng, 7, 0), "SHIFT": lambda: _value(rng, rng.choice([1, 2, 3]), rng.choice([1, 2])),
                     "FLAT": lambda: bytes([0]), "END": lambda: _head(3, 1) + struct.pack("<i", 5000 + k)}[name]()
        bits = rng.choice([0x7F800001, struct.unpack("<I", struct.pack("<f", 12.5))[0]])
        formats = rng.choice([[], ["GT"], ["DP", "GT"], ["GT", "DP", "AD"], ["AD"]])
        each = b""
        for name in formats:
            size = {"GT": rng.choice([1, 2]), "DP": 1, "AD": rng.choice([1, 3])}[name]
            kind = 1 if name == "GT" else rng.choice([1, 2])
            one = [_value(rng, kind, size)[1:] for _ in range(2)]
            if name == "GT":
                one = [bytes(rng.choice([0, 1, 2, 3, 4, 5]) for _ in range(size)) for _ in range(2)]
            each += _head(1, 1) + bytes([key[name]]) + _head(kind, size) + b"".join(one)
        shared = struct.pack("<iiiIII", k % 2, k, len(ref), bits, len(chosen) | (1 + len(alts)) << 16, 2 | len(formats) << 24)
        shared += _value(rng, 7, 0) if rng.random() < 0.5 else _head(7, 2) + b"id"
        shared += b"".join(_head(7, len(x)) + x.encode() for x in [ref, *alts])
        shared += rng.choice([bytes([0]), _head(1, 1) + b"\0", _head(1, 2) + b"\1\2"]) + info
        records.append(struct.pack("<II", len(shared), len(each)) + shared + each)
    path = str(tmp_path / "x.bcf")
    with open(path, "wb") as f:
        f.write(compress(head + b"".join(records), 900))
    text = vcf.with_typed_info(vcf.parse(bcf.read_lines(spark, path)), vcf.read_header(path))
    columns = vcf.read_typed(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in columns.schema] == [(f.name, f.dataType.simpleString()) for f in text.schema]
    got, want = columns.collect(), text.collect()
    assert len(got) == len(want) == 400
    for a, b in zip(got, want):
        assert a.asDict(recursive=True) == b.asDict(recursive=True)
    split = spark.read.format("bcf").option("split", "700").load(path)
    assert split.rdd.getNumPartitions() > 5 and [r.pos for r in split.collect()] == [r.pos for r in want]
