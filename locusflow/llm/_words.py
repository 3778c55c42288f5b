"""Words and word shingles as 64-bit hashes, for many texts at once.

A word is a maximal run of bytes other than ASCII white space in the lower-cased UTF-8 text. A
shingle is ``size`` consecutive words; a text with fewer words (but at least one) has one shingle,
of all of them. A text without words (null, empty, white space) has none.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np


LETTERS = re.compile(r"[^\W\d_]+")
#: Numbers that are no digits, as \u00bd and \u2167, which the pattern takes for letters.
_NUMBERS = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
_IS_NUMBER = np.zeros(sys.maxunicode + 1, bool)
_IS_NUMBER[_NUMBERS] = True


def no_numbers(text: str) -> str:
    """The text with a sign that is no letter for each of these numbers."""
    if text.isascii() or not _IS_NUMBER[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
        return text
    return text.translate(dict.fromkeys(_NUMBERS, "_"))


def words_of(chunks: list[str]) -> list[list[str]]:
    """The lower-cased runs of letters of each of many pieces without white space."""
    whole = no_numbers(" ".join(chunks)).split(" ") if chunks else []
    return [LETTERS.findall(x.lower()) for x in whole]


PIECE = 1 << 19  # bytes hashed at a time, whatever the length of a text
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3: every bit of the input reaches every bit of the result."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _tables() -> list[np.ndarray]:
    if not _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        for base in (_BASE, inverse):
            table = np.full(PIECE + 2, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in at most PIECE bytes."""
    power, inverse = _tables()
    raw = np.frombuffer(data, np.uint8)
    edge = np.ones(len(raw) + 2, np.int8)
    edge[1:-1] = _SPACE[raw]
    step = np.diff(edge)
    start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * power[: len(raw)], out=total[1:])
    value = (total[end] - total[start]) * inverse[start]
    return start, mix(value ^ ((end - start).astype(np.uint64) << _U(48)))


def _pieces(data: bytes):
    """Cuts at white space. A single word longer than PIECE is cut into pieces of that length."""
    at = 0
    while len(data) - at > PIECE:
        cut = max(data.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t"))
        cut = cut if cut > at else at + PIECE
        yield data[at:cut]
        at = cut
    yield data[at:] if at else data


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets at which each text's begin (one more at the end)."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            start, value = _hash_piece(b" ".join(held))
            at = np.cumsum([0] + [len(x) + 1 for x in held])
            np.add.at(counts, owners, np.diff(np.searchsorted(start, at)))
            hashes.append(value)
        held.clear()
        owners.clear()
        size = 0

    for k, text in enumerate(texts):
        if text:
            for piece in _pieces(text.lower().encode("utf-8", "surrogatepass")):
                if size + len(piece) + 1 > PIECE:
                    flush()
                held.append(piece)
                owners.append(k)
                size += len(piece) + 1
    flush()
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), offsets


def shingle_hashes(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, repeats included, and the offsets of each text's."""
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    padded = np.where(counts > 0, np.maximum(counts, size), 0)
    at = np.concatenate([[0], np.cumsum(padded)])
    line = np.zeros(at[-1] + size, np.uint64)
    line[np.arange(len(words)) + np.repeat(at[:-1] - offsets[:-1], counts)] = words
    value = np.zeros(at[-1], np.uint64)
    for k in range(size):
        value *= _U(_BASE)
        value += line[k : k + at[-1]]
    owned = np.where(padded > 0, padded - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(owned)])
    pick = np.arange(out[-1]) + np.repeat(at[:-1] - out[:-1], owned)
    return mix(value[pick]), out


def batches(texts: list, most: int = 1 << 20):
    """Slices of texts with at most so many characters (a longer text is alone)."""
    begin = size = 0
    for k, text in enumerate(texts):
        n = len(text) if text else 0
        if k > begin and size + n > most:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
