"""Tags of many BAM records at once: the k-th tag of every record is read in the k-th step, so the number of steps is
the largest number of tags of a record, whatever the number of records; values become Arrow columns by type."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Fixed values of the format: numbers' types and how they stand in bytes.
NUMBERS = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}
_SIZES = np.zeros(256, np.int64)
for _c, _kind in NUMBERS.items():
    _SIZES[ord(_c)] = np.dtype(_kind).itemsize
_SIZES[ord("A")] = 1


class Tags:
    """row: the record; name and kind (bytes); sub: the kind of an array's numbers; at, n: place and number of what a
    value consists of (bytes of texts, numbers of arrays, 1). In the order of records and of tags in them."""

    def __init__(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.raw = raw
        zeros = np.flatnonzero(raw == 0)
        at, row = begin.astype(np.int64), np.arange(len(begin))
        steps = []
        while True:
            more = at < end[row]
            row, at = row[more], at[more]
            if not len(row):
                break
            kind, value = raw[at + 2], at + 3
            n, size = np.ones(len(row), np.int64), _SIZES[kind].copy()
            text = (kind == ord("Z")) | (kind == ord("H"))
            n[text] = zeros[np.searchsorted(zeros, value[text])] - value[text]
            size[text] = n[text] + 1
            array = kind == ord("B")
            sub = np.where(array, raw[value], 0)
            n[array] = self._numbers("<u4", value[array] + 1)
            size[array] = 5 + n[array] * _SIZES[sub[array]]
            if (size == 0).any():
                raise OSError("a tag of unknown type")
            name = raw[at].astype(np.int64) << 8 | raw[at + 1]
            steps.append((row, name, kind, sub, value + np.where(array, 5, 0), n))
            at = value + size
        empty = np.zeros(0, np.int64)
        row, *rest = (np.concatenate(x) for x in zip(*steps)) if steps else (empty,) * 6
        order = np.argsort(row, kind="stable")
        self.row = row[order]
        self.name, self.kind, self.sub, self.at, self.n = (x[order] for x in rest)

    def _numbers(self, kind: str, at: np.ndarray) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return self.raw[at[:, None] + np.arange(size)].reshape(-1).view(kind) if len(at) else np.zeros(0, kind)

    def take(self, keep: np.ndarray) -> None:
        for c in ("row", "name", "kind", "sub", "at", "n"):
            setattr(self, c, getattr(self, c)[keep])

    def drop_repeated(self) -> None:
        """Of tags that a record repeats the last stays."""
        key = self.row << 16 | self.name
        last = len(key) - 1 - np.unique(key[::-1], return_index=True)[1]
        if len(last) < len(key):
            self.take(np.sort(last))

    def column(self, records: int, kind: pa.MapType) -> pa.Array:
        """A map of name to (type, i, f, s, ia, fa) for each record."""
        fields = [self._types(), self._whole(), self._float(), self._text(), self._list(False), self._list(True)]
        item = kind.item_type
        items = pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(fields, item)], fields=list(item))
        letters = np.stack([self.name >> 8, self.name & 255], 1).astype(np.uint8).reshape(-1)
        keys = _texts(letters, 2 * np.arange(len(self.name) + 1))
        ends = np.searchsorted(self.row, np.arange(records + 1))
        return pa.MapArray.from_arrays(pa.array(ends.astype(np.int32)), keys, items).cast(kind)

    def _types(self) -> pa.Array:
        array = self.kind == ord("B")
        ends = np.append(0, np.cumsum(1 + array))
        out = np.zeros(ends[-1], np.uint8)
        out[ends[:-1]] = self.kind
        out[ends[:-1][array] + 1] = self.sub[array]
        return _texts(out, ends)

    def _whole(self) -> pa.Array:
        out, have = np.zeros(len(self.kind), np.int64), np.zeros(len(self.kind), bool)
        for c, kind in NUMBERS.items():
            mine = np.flatnonzero(self.kind == ord(c))
            if c != "f" and len(mine):
                out[mine], have[mine] = self._numbers(kind, self.at[mine]), True
        return pa.array(out, mask=~have)

    def _float(self) -> pa.Array:
        mine = self.kind == ord("f")
        out = np.zeros(len(mine), np.float32)
        out[mine] = self._numbers("<f4", self.at[mine])
        return pa.array(out, mask=~mine)

    def _text(self) -> pa.Array:
        mine = np.isin(self.kind, list(b"AZH"))
        n = np.where(mine, self.n, 0)
        ends = np.append(0, np.cumsum(n))
        place = np.repeat(self.at - ends[:-1], n) + np.arange(ends[-1])
        return _texts(self.raw[place], ends, mine)

    def _list(self, floats: bool) -> pa.Array:
        mine = (self.kind == ord("B")) & ((self.sub == ord("f")) == floats)
        n = np.where(mine, self.n, 0)
        ends = np.append(0, np.cumsum(n))
        out = np.zeros(ends[-1], np.float32 if floats else np.int64)
        for c, kind in NUMBERS.items():
            some = np.flatnonzero(mine & (self.sub == ord(c)) & (n > 0))
            if len(some):
                k = np.arange(n[some].sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                at = np.repeat(self.at[some], n[some]) + k * np.dtype(kind).itemsize
                out[np.repeat(ends[some], n[some]) + k] = self._numbers(kind, at)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=pa.array(~mine))


def _texts(data: np.ndarray, ends: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    buffers = [bits, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, buffers)
