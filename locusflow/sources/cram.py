"""CRAM files: recognising them and reading their header. Their records are not decoded (see README)."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

from .bam import Header
from .bgzf import open_file


def is_cram_path(path: str) -> bool:
    return path.lower().endswith(".cram")


def sibling_fasta(path: str) -> str | None:
    """The FASTA file with the same stem, if there is one."""
    stem = path.rsplit(".", 1)[0]
    for end in (".fa", ".fasta", ".fna"):
        try:
            with open_file(stem + end):
                return stem + end
        except (FileNotFoundError, OSError):
            continue
    return None


def _itf8(data: bytes, at: int) -> tuple[int, int]:
    """A number of 1 to 5 bytes: leading ones of the first tell how many follow."""
    first = data[at]
    extra = 0
    while extra < 4 and first & 0x80 >> extra:
        extra += 1
    value = first & (0xFF >> (extra + 1)) if extra < 4 else first & 0x0F
    for k in range(extra):
        part = data[at + 1 + k]
        value = value << 8 | part if k < 3 else value << 4 | part & 0x0F
    return value, at + 1 + extra


def header_of(path: str) -> Header:
    with open_file(path) as file:
        start = file.read(26)
        if start[:4] != b"CRAM":
            raise OSError("not a CRAM file")
        size = struct.unpack("<i", file.read(4))[0]
        data = file.read(size + 256)
    at = 0
    for _ in range(4):
        _, at = _itf8(data, at)
    # record counter and bases are LTF8; in a header container both are one zero byte
    at += 2
    _, at = _itf8(data, at)
    marks, at = _itf8(data, at)
    for _ in range(marks):
        _, at = _itf8(data, at)
    at += 4 if start[4] >= 3 else 0
    method = data[at]
    at += 2
    _, at = _itf8(data, at)
    packed, at = _itf8(data, at)
    _, at = _itf8(data, at)
    body = data[at : at + packed]
    plain = {0: bytes, 1: lambda x: zlib.decompress(x, 31), 2: bz2.decompress, 3: lzma.decompress}[method](body)
    text = plain[4 : 4 + struct.unpack_from("<i", plain)[0]].rstrip(b"\0").decode()
    rows = [dict(f.split(":", 1) for f in x.split("\t")[1:]) for x in text.splitlines() if x.startswith("@SQ")]
    return Header(text, [r["SN"] for r in rows], [int(r["LN"]) for r in rows])
