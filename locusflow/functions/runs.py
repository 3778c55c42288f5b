"""Aligned runs of many reads at once, as arrays: what tasks do inside an Arrow batch.

A run is a stretch of the reference that bases of a read stand on. CIGAR texts of a whole batch are parsed
together; bases are expanded a bounded number at a time, whatever the length of a read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .alignments import CIGAR_OPS, ON_BOTH, ON_QUERY, ON_REFERENCE

STEP = 1 << 17  # bases expanded at a time: a MB for each array over them
PHRED = 33  # what SAM adds to a quality to make it a letter
LETTERS = "ACGT"
OTHER = len(LETTERS)


def _marks(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters.encode())] = True
    return out


_REFERENCE, _BOTH, _QUERY, _OPS = map(_marks, (ON_REFERENCE, ON_BOTH, ON_QUERY, CIGAR_OPS))
_CODES = np.full(256, OTHER, np.int64)
for _k, _c in enumerate(LETTERS):
    _CODES[[ord(_c), ord(_c.lower())]] = _k


class Runs(NamedTuple):
    """row: the read's place in its batch; lo: the first position; size; q: the first base's place in the read."""

    row: np.ndarray
    lo: np.ndarray
    size: np.ndarray
    q: np.ndarray

    def take(self, at: np.ndarray) -> Runs:
        return Runs(*(x[at] for x in self))

    def within(self, start: int, stop: int) -> Runs:
        """Cut to a region."""
        low = np.maximum(self.lo, start)
        size = np.minimum(self.lo + self.size, stop) - low
        return Runs(self.row, low, size, self.q + low - self.lo).take(size > 0)

    def pieces(self, most: int) -> Runs:
        """Runs longer than ``most`` are cut into several."""
        n = -(-self.size // most)
        if (n <= 1).all():
            return self
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, lo, size, q = (np.repeat(x, n) for x in self)
        return Runs(row, lo + k * most, np.minimum(most, size - k * most), q + k * most)


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and the offsets of each (one more at the end); nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def lists_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all lists of a column (null: the least), and begin and end of each list; nulls are empty."""
    values = column.values.cast(pa.int16())
    if values.null_count:
        values = pc.fill_null(values, np.iinfo(np.int16).min)
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    end = offsets[1:].copy()
    if column.null_count:
        none = column.is_null().to_numpy(zero_copy_only=False)
        end[none] = offsets[:-1][none]
    return values.to_numpy(zero_copy_only=False), offsets[:-1], end


def qualities_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Qualities of all reads of a column, begin and end of each read's, and what is to be taken off them (33 of texts)."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        data, offsets = text_of(column)
        return data, offsets[:-1], offsets[1:], PHRED
    return *lists_of(column), 0


def parse_cigars(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, letter and length of every operation of a column of CIGAR texts."""
    data, offsets = text_of(column)
    data = data[offsets[0] : offsets[-1]]
    at = np.flatnonzero(_OPS[data])  # the letter behind each number
    row = np.searchsorted(offsets[1:] - offsets[0], at, side="right")
    begin = np.concatenate([[0], at[:-1] + 1]) if len(at) else at
    digit = data.astype(np.int64) - ord("0")
    digit[(digit < 0) | (digit > 9)] = 0
    place = np.repeat(at, at - begin + 1) - np.arange(len(data) if len(at) == 0 else at[-1] + 1) - 1
    value = digit[: len(place)] * 10 ** np.maximum(place, 0)
    length = np.add.reduceat(value, begin) if len(at) else at
    return row, data[at], length


def reference_lengths(cigars: pa.Array) -> pa.Array:
    """How many positions of the reference each CIGAR takes; nulls take none."""
    row, letter, length = parse_cigars(cigars)
    taken = np.bincount(row, np.where(_REFERENCE[letter], length, 0), len(cigars))
    return pa.array(taken.astype(np.int64))


def aligned_runs(cigars: pa.Array, starts: np.ndarray) -> Runs:
    """The runs of a batch of reads, in the order of reads and operations."""
    row, letter, length = parse_cigars(cigars)
    on_reference, on_query = np.where(_REFERENCE[letter], length, 0), np.where(_QUERY[letter], length, 0)
    first = np.searchsorted(row, row, side="left")
    totals = []
    for x in (on_reference, on_query):
        before = np.cumsum(x) - x
        totals.append(before - before[first])
    runs = Runs(row, starts[row] + totals[0], length, totals[1])
    return runs.take(_BOTH[letter] & (length > 0))


def bases(
    runs: Runs, sequences: pa.Array, qualities: pa.Array, min_quality: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, position and code (of LETTERS, or OTHER) of every base whose quality is high enough; bases without a
    quality are left out. qualities: lists of numbers, or texts (Phred + 33)."""
    text, offsets = text_of(sequences)
    numbers, begin, end, above = qualities_of(qualities)
    least = max(min_quality + above, np.iinfo(np.int16).min + 1)
    runs = runs.pieces(STEP)
    upto = np.cumsum(runs.size)
    cuts = np.searchsorted(upto, np.arange(STEP, (upto[-1] if len(upto) else 0) + STEP, STEP), side="right")
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(upto)]):
        if a == b:
            continue
        row, lo, size, q = (np.repeat(x[a:b], runs.size[a:b]) for x in runs)
        within = np.arange(len(row)) - np.repeat(np.cumsum(runs.size[a:b]) - runs.size[a:b], runs.size[a:b])
        q += within
        have = (q < offsets[row + 1] - offsets[row]) & (q < end[row] - begin[row])
        if not have.all():
            row, lo, within, q = row[have], lo[have], within[have], q[have]
        good = numbers[begin[row] + q] >= least
        row, q = row[good], q[good]
        yield row, (lo + within)[good], _CODES[text[offsets[row] + q]]


class Tally:
    """Sums of weights by key. About ``most`` keys are held at a time, and half as many sums at most, so memory does not
    follow the rows of a task."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.most, self.waiting = most, 0
        self.parts: list[tuple[np.ndarray, np.ndarray | None]] = []
        self.held = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """Sums to be sent on, if too many keys are held. Without weights a key counts one."""
        self.parts.append((keys, weights))
        self.waiting += len(keys)
        if self.waiting + len(self.held[0]) <= self.most:
            return None
        self._merge()
        return self.take() if len(self.held[0]) > self.most // 2 else None

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All sums held, by ascending key."""
        self._merge()
        found, self.held = self.held, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return found

    def _merge(self) -> None:
        for plain in (True, False):
            some = [x for x in self.parts if (x[1] is None) == plain and len(x[0])]
            if some:
                keys = np.concatenate([x[0] for x in some])
                found = _counted(keys) if plain else _summed(keys, np.concatenate([x[1] for x in some]))
                if len(self.held[0]):
                    found = _summed(*(np.concatenate(x) for x in zip(self.held, found)))
                self.held = found
        self.parts, self.waiting = [], 0


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each key begins; keys are sorted and at least one."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key and how often it is there; sorts keys in place."""
    keys.sort()
    first = _firsts(keys)
    return keys[first], np.diff(first, append=len(keys))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")  # fast on two sorted parts
    keys = keys[order]
    first = _firsts(keys)
    return keys[first], np.add.reduceat(weights[order], first)
