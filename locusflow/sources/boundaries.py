"""Where records begin in BGZF files without an index.

A file is cut anywhere; the first record behind a cut is found by looking back: from some members before it, the first
place is sought from which a chain of consistent records leads over the cut, and the chain is followed. Bytes that
imitate records (a record's bytes inside a tag, say) lead to a chain as well, but one that joins the true chain where
the record that holds them ends, so what is found is right unless one record reaches over all that was looked back to.
Even then rows are never wrong: the task before a cut must come to the very place that the task behind it begins with,
and the first task begins where the header ends; one that comes to another place fails.
"""

from __future__ import annotations

import struct
from typing import Protocol

import numpy as np

from .bgzf import BgzfReader, member_from

LOOK = 1 << 18  # packed bytes that are looked back at first
CHAIN = 8  # consistent records that a place must lead to, if the file has as many
MORE = 1 << 20  # plain bytes read at a time


class Shape(Protocol):
    """What records look like."""

    def places(self, raw: np.ndarray) -> np.ndarray:
        """Ascending places in plain bytes at which a record may begin."""

    def size(self, data: bytearray, at: int) -> int:
        """Bytes of the record there; 0: it is none; -1: its first bytes are not all there."""


def words_at(raw: np.ndarray) -> np.ndarray:
    """The little-endian 32-bit number at every place (as many as fit)."""
    n = max(0, len(raw) - 3)
    out = np.empty(n, np.int32)
    for k in range(min(4, n)):
        part = raw[k : k + (n - k + 3) // 4 * 4].view("<i4")
        out[k::4] = part
    return out


class BamShape:
    HEAD = 36  # bytes before a record's name

    def __init__(self, contigs: int) -> None:
        self.contigs = contigs

    def places(self, raw: np.ndarray) -> np.ndarray:
        words = words_at(raw)
        n = len(words) - 32
        if n <= 0:
            return np.zeros(0, np.int64)
        size, ref, pos, seq, next_ref, next_pos = (words[k : k + n] for k in (0, 4, 8, 20, 24, 28))
        good = (size >= 33) & (ref >= -1) & (ref < self.contigs) & (pos >= -1) & (seq >= 0)
        good &= (next_ref >= -1) & (next_ref < self.contigs) & (next_pos >= -1) & (raw[12 : 12 + n] > 0)
        return np.flatnonzero(good)

    def size(self, data: bytearray, at: int) -> int:
        if at + self.HEAD > len(data):
            return -1
        size, ref, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
        if not (-1 <= ref < self.contigs and -1 <= next_ref < self.contigs and pos >= -1 and next_pos >= -1):
            return 0
        if l_name < 1 or l_seq < 0 or size < 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq:
            return 0
        upto = at + self.HEAD + l_name
        if upto > len(data):
            return -1
        name = data[at + self.HEAD : upto]
        if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
            return 0
        if upto + 4 * n_ops > len(data):
            return -1
        return 4 + size if all(c & 15 <= 8 for c in data[upto : upto + 4 * n_ops : 4]) else 0


class BcfShape:
    HEAD = 33  # bytes up to the kind of a record's name

    def __init__(self, contigs: int, samples: int) -> None:
        self.contigs, self.samples = contigs, samples

    def places(self, raw: np.ndarray) -> np.ndarray:
        words = words_at(raw)
        n = len(words) - 29
        if n <= 0:
            return np.zeros(0, np.int64)
        shared, each, contig, pos, length, samples = (words[k : k + n] for k in (0, 4, 8, 12, 16, 28))
        good = (shared >= 25) & (each >= 0) & (contig >= 0) & (contig < self.contigs) & (pos >= -1) & (length >= 0)
        return np.flatnonzero(good & (samples & 0xFFFFFF == self.samples))

    def size(self, data: bytearray, at: int) -> int:
        if at + self.HEAD > len(data):
            return -1
        shared, each, contig, pos, length, _, counts, samples = struct.unpack_from("<IIiiiIII", data, at)
        if not (0 <= contig < self.contigs and pos >= -1 and length >= 0 and samples & 0xFFFFFF == self.samples):
            return 0
        alleles, formats = counts >> 16, samples >> 24
        if shared < 24 + 1 + alleles + 2 * (counts & 0xFFFF) or (each > 0) != (formats > 0 and self.samples > 0):
            return 0
        return 8 + shared + each if data[at + 32] & 15 in (0, 7) else 0


class _Plain:
    """Plain bytes of a file from a virtual offset on, read as they are asked for."""

    def __init__(self, file, begin: int) -> None:
        self.blocks = BgzfReader(file, begin).blocks()
        self.data, self.starts, self.members = bytearray(), [], []
        self.ended = False

    def grow(self, size: int) -> None:
        """To at least so many bytes, if the file has them."""
        while len(self.data) < size and not self.ended:
            block = next(self.blocks, None)
            if block is None:
                self.ended = True
                return
            place, plain, skip = block
            self.starts.append(len(self.data) - skip)
            self.members.append(place)
            self.data += plain[skip:]

    def upto(self, member: int) -> int:
        """Reads up to a member and says where its bytes begin (the end of all, if it is not there)."""
        while not self.ended and (not self.members or self.members[-1] < member):
            self.grow(len(self.data) + 1)
        k = int(np.searchsorted(self.members, member))
        return self.starts[k] if k < len(self.members) else len(self.data)

    def offset(self, at: int) -> int:
        """The virtual offset of a place."""
        k = int(np.searchsorted(self.starts, at, side="right")) - 1
        return self.members[k] << 16 | at - self.starts[k]


def _followed(plain: _Plain, shape: Shape, at: int, border: int, sure: bool) -> int | None:
    """The first record at the border or behind it on the chain from a place, the end of all bytes if there is none;
    None if the chain breaks."""
    found, seen = None, 0
    while found is None or seen < CHAIN and not sure:
        while (size := shape.size(plain.data, at)) < 0 and not plain.ended:
            plain.grow(len(plain.data) + MORE)
        if size < 0 or plain.ended and at + size > len(plain.data):  # the file ends here
            return (len(plain.data) if found is None else found) if seen or sure or at == len(plain.data) else None
        if size == 0:
            return None
        found = at if found is None and at >= border else found
        at, seen = at + size, seen + 1
        if at >= len(plain.data):
            plain.grow(at + MORE)
    return found


def first_record(file, shape: Shape, first: int, at: int, size: int) -> int:
    """The virtual offset of the first record that begins in a member at a place of the file (of ``size`` bytes) or
    behind it; its end, if there is none. first: the virtual offset of the file's first record."""
    member = member_from(file, at, size)
    if member << 16 <= first:
        return first
    look = LOOK
    while member < size:
        back = at - look
        sure = back <= first >> 16
        begin = first if sure else member_from(file, back, size) << 16
        plain = _Plain(file, begin)
        border = plain.upto(member)
        places = [0] if sure else shape.places(np.frombuffer(bytes(plain.data[:border]), np.uint8)).tolist()
        for place in places:
            if (found := _followed(plain, shape, place, border, sure)) is not None:
                return plain.offset(found) if found < len(plain.data) else size << 16
        if sure:
            raise OSError("a record is not what records are")
        look *= 8  # one record reaches over all of it
    return size << 16


def ranges(size: int, split: int) -> list[tuple[int, int]]:
    """Places of a file at which it is cut."""
    cuts = list(range(0, size, split)) or [0]
    return list(zip(cuts, [*cuts[1:], size]))
