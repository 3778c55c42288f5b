"""Intervals: 0-based, half-open. The only place that adds or subtracts one for 1-based text formats."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Interval(NamedTuple):
    start: int
    stop: int

    @classmethod
    def of(cls, start: int, stop: int) -> Interval:
        if start < 0 or stop < 0:
            raise ValueError("coordinates must not be negative")
        if start > stop:
            raise ValueError(f"start {start} is greater than stop {stop}")
        return cls(start, stop)

    @classmethod
    def of_1based(cls, first: int, last: int) -> Interval:
        """From a 1-based interval with both ends."""
        if first < 1:
            raise ValueError("1-based coordinates start at 1")
        return cls.of(first - 1, last)

    def to_1based(self) -> tuple[int, int] | None:
        return None if self.is_empty else (self.start + 1, self.stop)

    @property
    def size(self) -> int:
        return self.stop - self.start

    @property
    def is_empty(self) -> bool:
        return self.start == self.stop

    def contains(self, position: int) -> bool:
        return self.start <= position < self.stop

    def overlap(self, start: int, stop: int) -> Interval | None:
        low, high = max(self.start, start), min(self.stop, stop)
        return Interval(low, high) if low < high else None


class Region(NamedTuple):
    contig: str
    start: int
    stop: int


def resolve(
    lengths: dict[str, int], contig: str, start: int | None = None, stop: int | None = None
) -> Region:
    """A region within a contig: both ends are clamped to its length first, then compared."""
    if contig not in lengths:
        raise ValueError(f"unknown contig: {contig}")
    if any(x is not None and x < 0 for x in (start, stop)):
        raise ValueError("coordinates must not be negative")
    length = lengths[contig]
    low = min(0 if start is None else start, length)
    high = min(length if stop is None else stop, length)
    return Region(contig, *Interval.of(low, high))


def clamp_checked(lengths: dict[str, int], contig: str, start: int, stop: int) -> Region:
    """As resolve, but start and stop are compared as they were given (multi-region fetches)."""
    Interval.of(start, stop)
    return resolve(lengths, contig, start, stop)


def overlaps(start: Column, stop: Column, low, high) -> Column:
    return (start < F.lit(high)) & (stop > F.lit(low))


def one_based(start: Column) -> Column:
    return start + 1


def zero_based(position: Column) -> Column:
    return position - 1
