"""Writers of small test files, and the reads and variants in them: made by a seeded generator, so that every
expectation comes from a plain computation over the rows."""

import random
import re
import struct
from collections import defaultdict

from locusflow.sources.bgzf import BgzfReader, compress

CONTIGS = (("alpha", 2600), ("beta", 900), ("gamma", 70))  # gamma has no reads
LETTERS, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SHAPES = ["31M", "13M3D9M", "7S16M2I11M", "9M45N14M", "6=1X13=4S", "2H18M", "5M1P8M1I6M", "3S22M2H", "1M1D1M1I1M"]
FLAGS = [0, 16, 99, 147, 83, 163, 256, 512, 1024, 2048, 1040, 321]


def ops_of(cigar):
    return [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def _reads():
    """name, flag, contig, start, mapq, CIGAR, sequence, qualities, next contig, next start, size, tags"""
    rng = random.Random(41)
    rows = []
    for k in range(54):
        contig = int(k % 3 == 0)
        cigar = SHAPES[k % len(SHAPES)]
        size = sum(n for n, op in ops_of(cigar) if op in "MIS=X")
        tags = [("NM", "C", k % 5), ("RG", "Z", f"lane{k % 2}"), ("XF", "f", k / 4)][: k % 4]
        rows.append((
            f"read-{k:02d}", FLAGS[k % len(FLAGS)], contig, rng.randrange(CONTIGS[contig][1] - 100), rng.randrange(61), cigar,
            "".join(rng.choice("ACGTACGTN") for _ in range(size)),
            None if k % 13 == 5 else [rng.randrange(2, 42) for _ in range(size)],
            contig if k % 2 else -1, rng.randrange(100) if k % 2 else -1, rng.randrange(-200, 200), tags,
        ))
    rows += [(f"lost-{k}", 4 | 1, k % 2, 333 + k, 0, "", "GATTACA", [9] * 7, -1, -1, 0, []) for k in range(3)]
    rows.sort(key=lambda r: (r[2], r[3]))
    return rows + [(f"nowhere-{k}", 4, -1, -1, 0, "", "CCATG"[: 5 - k], [7] * (5 - k), -1, -1, 0, []) for k in range(2)]


RECORDS = _reads()


def _tag(name, kind, value):
    head = name.encode() + kind[0].encode()
    if kind == "Z":
        return head + value.encode() + b"\0"
    if kind == "A":
        return head + value.encode()
    if kind[0] == "B":
        code = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[kind[1]]
        return head + kind[1].encode() + struct.pack(f"<i{len(value)}{code}", len(value), *value)
    code = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[kind]
    return head + struct.pack("<" + code, value)


def encode(r):
    name, flag, ref, pos, mapq, cigar, seq, qual, nref, npos, size, tags = r
    ops = ops_of(cigar)
    codes = [LETTERS.index(x) for x in seq] + [0] * (len(seq) % 2)
    if len(ops) > 65535:  # more than the field can count: the operations stand in a tag
        tags = [*tags, ("CG", "BI", [n << 4 | OPS.index(op) for n, op in ops])]
        ops = [(len(seq), "S"), (sum(n for n, op in ops if op in "MDN=X"), "N")]
    body = struct.pack(
        "<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), nref, npos, size
    )
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for n, op in ops)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body += bytes(qual) if qual is not None else b"\xff" * len(seq)
    body += b"".join(_tag(*t) for t in tags)
    return struct.pack("<i", len(body)) + body


def write_bam(path, records=RECORDS, contigs=CONTIGS, index=True, block=60_000):
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in contigs)
    text += "@RG\tID:lane0\tSM:pool\n@RG\tID:lane1\tSM:pool\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    for n, k in contigs:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    data = compress(head + b"".join(map(encode, records)), block)
    with open(path, "wb") as f:
        f.write(data)
    if index:
        where = _places(path, len(head), [(r[2], *span(r)) for r in records], 1)
        with open(path + (".csi" if index == "csi" else ".bai"), "wb") as f:
            f.write(compress(_csi(where, len(contigs))) if index == "csi" else _bai(where, len(contigs)))


def _places(path, skip, spans, sizes):
    """contig, start, stop, first and last virtual offset of each record; sizes: how many sizes stand before one."""
    out = []
    with open(path, "rb") as f:
        reader = BgzfReader(f)
        reader.read(skip)
        for s in spans:
            begin = reader.tell()
            reader.read(sum(struct.unpack(f"<{sizes}I", reader.read(4 * sizes))))
            out.append((*s, begin, reader.tell()))
    return [x for x in out if x[0] >= 0]


def bin_of(start, stop, shift, depth):
    """The smallest bin that holds a span, and its level."""
    for level in range(depth, -1, -1):
        size = shift + 3 * (depth - level)
        if start >> size == stop - 1 >> size:
            return ((1 << 3 * level) - 1) // 7 + (start >> size), level
    raise ValueError


def _csi(where, n, shift=7, depth=4, aux=b""):
    """An index with windows of 128 positions."""
    bins, least = defaultdict(list), {}
    for contig, start, stop, begin, end in where:
        bins[contig, bin_of(start, stop, shift, depth)[0]].append((begin, end))
        for level in range(depth + 1):
            size, first = shift + 3 * (depth - level), ((1 << 3 * level) - 1) // 7
            for k in range(start >> size, (stop - 1 >> size) + 1):
                least.setdefault((contig, first + k), begin)
    out = b"CSI\1" + struct.pack("<iii", shift, depth, len(aux)) + aux + struct.pack("<i", n)
    for k in range(n):
        mine = [(b, c) for (contig, b), c in bins.items() if contig == k]
        out += struct.pack("<i", len(mine))
        for b, chunks in mine:
            out += struct.pack("<IQi", b, least[k, b], len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
    return out


def _bai(where, n):
    lines, bins = defaultdict(dict), defaultdict(list)
    for contig, start, stop, begin, end in where:
        for w in range(start >> 14, (stop - 1 >> 14) + 1):
            lines[contig].setdefault(w, begin)
        bins[contig, bin_of(start, stop, 14, 5)[0]].append((begin, end))
    out = b"BAI\1" + struct.pack("<i", n)
    for k in range(n):
        mine = [(b, c) for (contig, b), c in bins.items() if contig == k]
        out += struct.pack("<i", len(mine))
        for b, chunks in mine:
            out += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        size = max(lines[k], default=-1) + 1
        out += struct.pack("<i", size) + b"".join(struct.pack("<Q", lines[k].get(w, 0)) for w in range(size))
    return out


def blocks(r):
    """(reference position, place in the read) of each aligned base."""
    at, q = r[3], 0
    for n, op in ops_of(r[5]):
        if op in "M=X":
            yield from ((at + i, q + i) for i in range(n))
        at += n if op in "MDN=X" else 0
        q += n if op in "MIS=X" else 0


def span(r):
    return r[3], r[3] + max(1, 0 if r[1] & 4 else sum(n for n, op in ops_of(r[5]) if op in "MDN=X"))


KEYS = ["PASS", "weak", "noisy", "DP", "AF", "NOTE", "SHIFT", "FLAT", "END", "GT", "AD"]
_META = {
    "DP": ("1", "Integer"), "AF": ("A", "Float"), "NOTE": ("1", "String"), "SHIFT": ("2", "Integer"), "FLAT": ("0", "Flag"),
    "END": ("1", "Integer"),
}


def _variants():
    """contig, pos, id, ref, alts, qual, filters, info, [(genotype, depth, allele depths)] of two samples"""
    rng = random.Random(43)
    rows = []
    for k in range(40):
        contig = int(k % 4 == 0)
        ref = "".join(rng.choice("ACGT") for _ in range(1 + k % 3))
        alts = ["".join(rng.choice("ACGT") for _ in range(1 + (k + j) % 4)) for j in range(k % 3)]
        info = {"DP": [rng.randrange(300)]}
        if alts:
            info["AF"] = [rng.choice([0.5, 0.125, 0.3, 1.0, 0.0625]) for _ in alts]
        if k % 5 == 0:
            info["NOTE"] = [rng.choice(["0012", "nan", "1_000", "deep"])]
        if k % 7 == 0:
            info["SHIFT"] = [-3, 700 + k]
        if k % 6 == 0:
            info["FLAT"] = []
        pos = rng.randrange(1, CONTIGS[contig][1] - 60)
        if k % 11 == 3:
            info["END"] = [pos + 50]
        qual = [None, 12345.678, 7.5, 1234567.0, 60.0][k % 5]
        filters = [["PASS"], ["weak"], ["noisy", "weak"], []][k % 4]
        samples = [((rng.randrange(2), rng.randrange(2), k % 2), rng.randrange(99), [rng.randrange(50) for _ in [0, *alts]]),
                   ((None, 1, 0), rng.randrange(99), [rng.randrange(50) for _ in [0, *alts]])]
        rows.append((contig, pos, f"v{k}" if k % 3 else None, ref, alts, qual, filters, info, samples))
    return sorted(rows, key=lambda v: (v[0], v[1]))


VARIANTS = _variants()


def _text(x):
    return f"{x:.10g}"


def genotype(gt):
    return "|/"[not gt[2]].join("." if a is None else str(a) for a in gt[:2])


def vcf_text():
    out = ["##fileformat=VCFv4.3"] + [f"##contig=<ID={n},length={k}>" for n, k in CONTIGS]
    out += [f'##FILTER=<ID={x},Description="x">' for x in KEYS[:3]]
    out += [f'##INFO=<ID={k},Number={n},Type={t},Description="x">' for k, (n, t) in _META.items()]
    out += [f'##FORMAT=<ID={k},Number={n},Type={t},Description="x">' for k, n, t in (("GT", 1, "String"), ("DP", 1, "Integer"), ("AD", "R", "Integer"))]
    out.append("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\ttwo")
    for contig, pos, name, ref, alts, qual, filters, info, samples in VARIANTS:
        fields = [k if not v else f"{k}={','.join(map(_text if k == 'AF' else str, v))}" for k, v in info.items()]
        columns = [f"{genotype(gt)}:{dp}:{','.join(map(str, ad))}" for gt, dp, ad in samples]
        out.append("\t".join([CONTIGS[contig][0], str(pos), name or ".", ref, ",".join(alts) or ".", "." if qual is None else _text(qual),
                              ";".join(filters) or ".", ";".join(fields), "GT:DP:AD", *columns]))
    return "\n".join(out) + "\n"


def _typed(values, kind=None):
    if isinstance(values, str):
        raw, kind = values.encode(), 7
    elif kind == 5:
        raw = struct.pack(f"<{len(values)}f", *values)
    else:
        kind, raw = 3, struct.pack(f"<{len(values)}i", *values)
    size = len(values)
    return (bytes([15 << 4 | kind, 1 << 4 | 1, size]) if size > 14 else bytes([size << 4 | kind])) + raw


def bcf_bytes():
    """The header's part and the records of the variants as BCF."""
    text = "".join(x + "\n" for x in vcf_text().splitlines() if x.startswith("#")) + "\0"
    key = {k: i for i, k in enumerate(KEYS)}
    head = b"BCF\2\2" + struct.pack("<I", len(text)) + text.encode()
    records = []
    for contig, pos, name, ref, alts, qual, filters, info, samples in VARIANTS:
        bits = 0x7F800001 if qual is None else struct.unpack("<I", struct.pack("<f", qual))[0]
        shared = struct.pack("<iiiIII", contig, pos - 1, len(ref), bits, len(info) | (1 + len(alts)) << 16, 2 | 3 << 24)
        shared += _typed(name or "") + b"".join(_typed(x) for x in [ref, *alts])
        shared += _typed([key[x] for x in filters]) if filters else bytes([0])
        for k, v in info.items():
            shared += _typed([key[k]])
            shared += bytes([0]) if not v else _typed(v[0]) if k == "NOTE" else _typed(v, 5 if k == "AF" else None)
        each = _typed([key["GT"]]) + bytes([2 << 4 | 1])
        for (a, b, phased), _, _ in samples:
            each += bytes([0 if a is None else (a + 1) << 1, (b + 1) << 1 | phased])
        each += _typed([key["DP"]]) + bytes([1 << 4 | 1]) + bytes(dp for _, dp, _ in samples)
        n = 1 + len(alts)
        each += _typed([key["AD"]]) + bytes([n << 4 | 1]) + b"".join(bytes(ad) for _, _, ad in samples)
        records.append(struct.pack("<II", len(shared), len(each)) + shared + each)
    return head, records


def variant_stop(v):
    return v[7]["END"][0] if "END" in v[7] else v[1] - 1 + len(v[3])


def write_variants(folder, block=150):
    """The same variants as .vcf, .vcf.gz with a .tbi, .vcf.bgz with a .csi, and .bcf with a .csi."""
    text = vcf_text()
    spans = [(v[0], v[1] - 1, variant_stop(v)) for v in VARIANTS]
    names = b"".join(n.encode() + b"\0" for n, _ in CONTIGS[:2])
    aux = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(names)) + names
    (folder / "some.vcf").write_text(text)
    lines = [x + "\n" for x in text.splitlines()]
    for name in ("some.vcf.gz", "some.vcf.bgz"):
        (folder / name).write_bytes(compress(text.encode(), block))
        where = []
        with open(folder / name, "rb") as f:
            reader = BgzfReader(f)
            for line in lines:
                begin = reader.tell()
                reader.read(len(line))
                if not line.startswith("#"):
                    where.append((*spans[len(where)], begin, reader.tell()))
        if name.endswith(".gz"):
            data = _bai(where, 2)
            (folder / (name + ".tbi")).write_bytes(compress(b"TBI\1" + data[4:8] + aux + data[8:]))
        else:
            (folder / (name + ".csi")).write_bytes(compress(_csi(where, 2, aux=aux)))
    head, records = bcf_bytes()
    (folder / "some.bcf").write_bytes(compress(head + b"".join(records), block))
    where = _places(str(folder / "some.bcf"), len(head), spans, 2)
    (folder / "some.bcf.csi").write_bytes(compress(_csi(where, 2)))
    return [str(folder / x) for x in ("some.vcf", "some.vcf.gz", "some.vcf.bgz", "some.bcf")]
