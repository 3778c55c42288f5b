"""Files without an index, cut anywhere: each record once, whatever their bytes imitate."""

import random
import struct

import files
import numpy as np
import pytest

from locusflow.sources import bam, bcf, boundaries
from locusflow.sources.bgzf import compress

CONTIGS = (("alpha", 100_000), ("beta", 900))


def reads(seed, n, imitate):
    """Reads of which some hold whole records, several in a row, or random bytes in a tag."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        size = rng.choice([0, 5, 36, 150])
        tags = [("NM", "C", k % 7)] if k % 2 else []
        if imitate and rows and rng.random() < 0.4:
            held = b"".join(files.encode(r) for r in rng.sample(rows, min(len(rows), rng.choice([1, 1, 3]))))
            tags.append(("ZZ", "BC", list(held[rng.choice([0, 0, 1, 4]) :] + rng.randbytes(rng.choice([0, 0, 9])))))
        elif rng.random() < 0.2:
            tags.append(("ZR", "BC", list(rng.choice([b"\0", b"\xff", b"\1\0\0\0"]) * rng.randrange(400))))
        cigar = f"{size}M" if size else ""
        rows.append((f"read{k}", 0 if size else 4, 0, k * 3, 9, cigar, "".join(rng.choice("ACGT") for _ in range(size)),
                     [30] * size if rng.random() < 0.7 else None, -1, -1, 0, tags))
    return rows


def scanned(path, split):
    reader = bam.BamReader({"path": path, "split": str(split)})
    parts = reader.partitions()
    found = [[x for b in reader.read(p) for x in b.column("query_name").to_pylist()] for p in parts]
    return [x for some in found for x in some], len(parts), sum(map(bool, found))


@pytest.mark.parametrize("imitate", [False, True])
@pytest.mark.parametrize("block", [97, 700, 20_000])
def test_bam_without_index_is_split(tmp_path, monkeypatch, imitate, block):
    for seed, look in ((0, 5000), (1, 5000), (2, 1 << 18)):
        monkeypatch.setattr(boundaries, "LOOK", look)
        rows, path = reads(seed, 200, imitate), str(tmp_path / f"{seed}.bam")
        files.write_bam(path, rows, CONTIGS, index=False, block=block)
        for split in (700, 1 << 25):
            names, parts, full = scanned(path, split)
            assert names == [r[0] for r in rows]
            assert split > 700 or parts > 8 and (full > 8 or block > 1000)


def test_one_long_record_over_many_cuts(tmp_path):
    rows = reads(5, 60, True)
    held = b"".join(map(files.encode, rows[:30]))
    rows.insert(30, ("long", 4, -1, -1, 0, "", "", [], -1, -1, 0, [("ZL", "BC", list(held * 12))]))
    path = str(tmp_path / "long.bam")
    files.write_bam(path, rows, CONTIGS, index=False, block=500)
    assert scanned(path, 3000)[0] == [r[0] for r in rows]


def test_a_cut_in_a_record_longer_than_what_is_looked_back_to_fails(tmp_path, monkeypatch):
    """Bytes that imitate records, in a record that reaches over all of it: an error or the right rows, never others."""
    monkeypatch.setattr(boundaries, "LOOK", 64)
    rows = reads(6, 40, False)
    held = b"".join(map(files.encode, rows[:30]))
    rows.insert(20, ("long", 4, -1, -1, 0, "", "", [], -1, -1, 0, [("ZL", "BC", list(held * 5))]))
    path = str(tmp_path / "long.bam")
    files.write_bam(path, rows, CONTIGS, index=False, block=150)
    failed = 0
    for split in (333, 1000, 5000):
        try:
            assert scanned(path, split)[0] == [r[0] for r in rows]
        except OSError as e:
            assert "index" in str(e)
            failed += 1
    assert failed, "the case must be met"


def test_empty_and_cut_off_files(tmp_path):
    path = str(tmp_path / "none.bam")
    files.write_bam(path, [], CONTIGS, index=False)
    assert scanned(path, 20)[0] == []
    rows = reads(7, 80, False)
    files.write_bam(path, rows, CONTIGS, index=False, block=200)
    whole = open(path, "rb").read()
    with bam.open_file(path) as file:
        plain = bam.BgzfReader(file).read(1 << 30)
    with open(path, "wb") as f:
        f.write(compress(plain[:-7], 200))
    assert len(whole) > 2000 and scanned(path, 150)[0] == scanned(path, 1 << 30)[0] == [r[0] for r in rows[:-1]]


def test_words_at_every_place():
    raw = np.frombuffer(random.Random(1).randbytes(103), np.uint8)
    for n in (0, 3, 4, 5, 6, 7, 8, 103):
        want = [struct.unpack_from("<i", raw[:n].tobytes(), k)[0] for k in range(n - 3)]
        assert boundaries.words_at(raw[:n]).tolist() == want


@pytest.mark.parametrize("split", [40, 300, 5000])
def test_bcf_without_index_is_split(tmp_path, split):
    head, records = files.bcf_bytes()
    imitation = b"".join(records[3:5])
    record = records[2]
    n, m = struct.unpack_from("<II", record)
    shared = bytearray(record[8 : 8 + n])
    infos = struct.unpack_from("<I", shared, 16)[0]
    struct.pack_into("<I", shared, 16, infos + 1)
    shared += files._typed([files.KEYS.index("NOTE")]) + bytes([15 << 4 | 7, 1 << 4 | 3]) + struct.pack("<I", len(imitation)) + imitation
    odd = struct.pack("<II", len(shared), m) + shared + record[8 + n :]
    many = (records + [odd]) * 6
    path = str(tmp_path / "x.bcf")
    with open(path, "wb") as f:
        f.write(compress(head + b"".join(many), 170))

    def lines(size):
        reader = bcf._BcfReader({"path": path, "split": str(size)})
        parts = reader.partitions()
        return [x for p in parts for b in reader.read(p) for x in b.column("value").to_pylist()], len(parts)

    monkey = bcf.line_of
    try:
        bcf.line_of = lambda shared, each, keys, contigs: shared.hex() + ":" + each.hex()
        got, parts = lines(split)
        assert got == [f"{r[8:8 + struct.unpack_from('<I', r)[0]].hex()}:{r[8 + struct.unpack_from('<I', r)[0]:].hex()}" for r in many]
        assert parts > (1 if split > 1000 else 8)
    finally:
        bcf.line_of = monkey
