"""BCF records of a chunk of bytes as Arrow columns: the k-th value of every record is read in the k-th step, so numbers
never become text. The columns are those of ``vcf.with_typed_info`` over the same records as text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .vcf import RESERVED, VariantHeader

TEXT, FLOAT = 7, 5
_WIDTHS = np.array([0, 1, 2, 4, 0, 4, 0, 1, *[0] * 8], np.int64)
_WHOLE = {1: "<i1", 2: "<i2", 3: "<i4"}
#: Fixed values of the format: a missing number and a vector's end, as bits.
_MISSING = {1: -128, 2: -32768, 3: -(1 << 31)}
_NO_FLOAT, _END_FLOAT = 0x7F800001, 0x7F800002


def schema_of(header: VariantHeader) -> T.StructType:
    kinds = {"Integer": T.IntegerType(), "Float": T.FloatType(), "Flag": T.BooleanType()}
    info = T.StructType()
    for key, (number, kind) in sorted({**RESERVED, **header.info}.items()):
        one = kinds.get(kind, T.StringType())
        info.add(key, one if kind == "Flag" or number == "1" else T.ArrayType(one))
    text, whole = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
    sample = T.StructType().add("gt", whole).add("dp", "integer").add("ad", whole)
    form = T.StructType().add("chrom", "string").add("pos", "long").add("start", "long").add("stop", "long").add("id", "string")
    form = form.add("ref", "string").add("alts", text).add("alleles", text).add("qual", "float").add("filter", text)
    return (
        form.add("format", text).add("info", info).add("samples", T.ArrayType(sample))
        .add("more_info", T.MapType(T.StringType(), T.StringType()))
    )


class _Values:
    """Typed values of some records: row, kind, n (numbers, or bytes of a text), at (their place)."""

    def __init__(self, row: np.ndarray, kind: np.ndarray, n: np.ndarray, at: np.ndarray) -> None:
        self.row, self.kind, self.n, self.at = row, kind, n, at

    def take(self, keep: np.ndarray) -> _Values:
        return _Values(*(x[keep] for x in (self.row, self.kind, self.n, self.at)))

    @staticmethod
    def joined(parts: list[_Values]) -> _Values:
        """By row, those of a row in the order of the parts."""
        empty = np.zeros(0, np.int64)
        columns = [np.concatenate([getattr(p, c) for p in parts] or [empty]) for c in ("row", "kind", "n", "at")]
        order = np.argsort(columns[0], kind="stable")
        return _Values(*(c[order] for c in columns))


class Chunk:
    def __init__(self, raw: np.ndarray) -> None:
        self.raw = raw

    def numbers(self, kind: str, at: np.ndarray) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return self.raw[at[:, None] + np.arange(size)].reshape(-1).view(kind) if len(at) else np.zeros(0, kind)

    def described(self, row: np.ndarray, at: np.ndarray) -> tuple[_Values, np.ndarray]:
        """The typed values at some places, and the places behind them."""
        head = self.raw[at].astype(np.int64)
        kind, n, at = head & 15, head >> 4, at + 1
        long = np.flatnonzero(n == 15)
        codes = self.raw[at[long]] & 15
        for code, form in _WHOLE.items():  # of long ones the size follows, as a number
            mine = long[codes == code]
            n[mine] = self.numbers(form, at[mine] + 1)
            at[mine] += 1 + np.dtype(form).itemsize
        return _Values(row, kind, n, at), at + n * _WIDTHS[kind]

    def flat(self, values: _Values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All whole numbers of the values one after another, which are there, and the offsets of each value's; ends of
        vectors are gone. Other kinds have none."""
        n = np.where(np.isin(values.kind, list(_WHOLE)), values.n, 0)
        owner = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out, there, end = np.zeros(len(owner), np.int64), np.ones(len(owner), bool), np.zeros(len(owner), bool)
        for code, form in _WHOLE.items():
            mine = np.flatnonzero(values.kind[owner] == code)
            got = self.numbers(form, values.at[owner[mine]] + k[mine] * np.dtype(form).itemsize).astype(np.int64)
            out[mine], there[mine], end[mine] = got, got != _MISSING[code], got == _MISSING[code] + 1
        return self._kept(out, there, end, owner, len(n))

    def floats(self, values: _Values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.where(values.kind == FLOAT, values.n, 0)
        owner = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bits = self.numbers("<u4", values.at[owner] + 4 * k)
        return self._kept(bits.view("<f4"), bits != _NO_FLOAT, bits == _END_FLOAT, owner, len(n))

    @staticmethod
    def _kept(out, there, end, owner, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = ~end
        return out[keep], there[keep], np.searchsorted(owner[keep], np.arange(n + 1))

    def texts(self, values: _Values) -> pa.Array:
        """Null for what is empty or "."."""
        n = np.where(values.kind == TEXT, values.n, 0)
        ends = np.append(0, np.cumsum(n))
        data = self.raw[np.repeat(values.at - ends[:-1], n) + np.arange(ends[-1])]
        found = pa.Array.from_buffers(
            pa.string(), len(n), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
        )
        plain = [x.rstrip("\0") for x in found.to_pylist()] if (data == 0).any() else found.to_pylist()
        return pa.array([None if x in ("", ".") else x for x in plain], pa.string())


def _spread(n: int, rows: np.ndarray, values: pa.Array) -> pa.Array:
    """A column of n rows with values at some of them, nulls at the others."""
    place = np.full(n, -1, np.int64)
    place[rows] = np.arange(len(rows))
    return values.take(pa.array(place, mask=place < 0))


def _lists(offsets: np.ndarray, values: pa.Array, absent: np.ndarray | None = None) -> pa.Array:
    mask = None if absent is None else pa.array(absent)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=mask)


def _numbers_of(out, there, offsets, kind: pa.DataType, single: bool) -> pa.Array:
    """Lists of numbers, or the numbers of lists of one; a list of one missing number is null."""
    n, first = np.diff(offsets), np.minimum(offsets[:-1], max(0, len(out) - 1))
    alone = n == 1
    absent = (n == 0) | (alone & ~there[first]) if len(out) else np.ones(len(n), bool)
    if single:
        values = out[first] if len(out) else np.zeros(len(n), out.dtype)
        return pa.array(values, mask=absent | ~alone).cast(kind)
    return _lists(offsets, pa.array(out, mask=~there).cast(kind), absent)


def decode(raw: np.ndarray, at: np.ndarray, keys: list[str], contigs: list[str], header: VariantHeader) -> pa.RecordBatch:
    """The rows of the records that begin at ``at`` (their sizes)."""
    form = to_arrow_schema(schema_of(header))
    chunk, n = Chunk(raw), len(at)
    every = np.arange(n)
    field = lambda k, kind="<i4": chunk.numbers(kind, at + 8 + 4 * k)
    start, counts, formats = field(1).astype(np.int64), field(4, "<u4").astype(np.int64), field(5, "<u4").astype(np.int64)
    qual, alleles, infos = field(3, "<u4"), counts >> 16, counts & 0xFFFF
    name, place = chunk.described(every, at + 32)
    held, key_of, info = [], [], []
    for k in range(int(alleles.max(initial=0))):
        some = np.flatnonzero(alleles > k)
        found, place[some] = chunk.described(some, place[some])
        held.append(found)
    passed, place = chunk.described(every, place)
    for k in range(int(infos.max(initial=0))):
        some = np.flatnonzero(infos > k)
        number, behind = chunk.described(some, place[some])
        found, place[some] = chunk.described(some, behind)
        key_of.append(chunk.flat(number)[0])
        info.append(found)
    names = pa.array(keys, pa.string())
    letters = _Values.joined(held)
    letter_texts, first = chunk.texts(letters), np.searchsorted(letters.row, np.arange(n + 1))
    late = letters.row[1:] == letters.row[:-1] if len(letters.row) else np.zeros(0, bool)
    alts = np.flatnonzero(np.append(False, late)) if len(letters.row) else np.zeros(0, np.int64)
    filters, _, filter_ends = chunk.flat(passed)
    fields, more = {}, form.field("info").type
    codes = np.concatenate(key_of or [np.zeros(0, np.int64)])
    rows = _Values(*(np.concatenate([getattr(x, c) for x in info] or [np.zeros(0, np.int64)]) for c in ("row", "kind", "n", "at")))
    declared = {**RESERVED, **header.info}
    for f in more:
        mine = rows.take(codes == keys.index(f.name)) if f.name in keys else rows.take(codes < 0)
        number, kind = declared[f.name]
        if kind == "Flag":
            values = pa.array(np.ones(len(mine.row), bool))
        elif kind == "Integer":
            values = _numbers_of(*chunk.flat(mine), pa.int32(), number == "1")
        elif kind == "Float":
            values = _numbers_of(*chunk.floats(mine), pa.float32(), number == "1")
        else:
            values = chunk.texts(mine)
            if number != "1":
                split = [None if x is None else [None if y in ("", ".") else y for y in x.split(",")] for x in values.to_pylist()]
                values = pa.array(split, pa.list_(pa.string()))
        fields[f.name] = _spread(n, mine.row, values).cast(f.type)
    ended = fields["END"].to_numpy(zero_copy_only=False) if "END" in fields and pa.types.is_integer(fields["END"].type) else np.full(n, np.nan)
    given = ~np.isnan(ended.astype(np.float64))
    stop = np.where(given, np.where(given, ended, 0), start + field(2)).astype(np.int64)
    format_lists, samples = _samples(chunk, at, formats, keys, form.field("samples").type)
    columns = {
        "chrom": pa.array(contigs, pa.string()).take(pa.array(field(0))),
        "pos": pa.array(start + 1), "start": pa.array(start), "stop": pa.array(stop),
        "id": chunk.texts(name), "ref": letter_texts.take(pa.array(np.minimum(first[:-1], max(0, len(letter_texts) - 1)))),
        "alts": _lists(np.searchsorted(letters.row[alts], np.arange(n + 1)), letter_texts.take(pa.array(alts))),
        "alleles": _lists(first, letter_texts),
        "qual": pa.array(qual.view("<f4"), mask=qual == _NO_FLOAT),
        "filter": _lists(filter_ends, names.take(pa.array(filters))),
        "format": _lists(format_lists[0], names.take(pa.array(format_lists[1]))),
        "info": pa.StructArray.from_arrays([fields[f.name] for f in more], fields=list(more)),
        "samples": samples, "more_info": pa.array([[]] * n, form.field("more_info").type),
    }
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in form], schema=form)


def _samples(chunk: Chunk, at: np.ndarray, formats: np.ndarray, keys: list[str], kind: pa.ListType):
    """Offsets and numbers of the keys of FORMAT, and the column of samples."""
    n, people, many = len(at), formats & 0xFFFFFF, formats >> 24
    place = at + 8 + chunk.numbers("<u4", at).astype(np.int64)
    key_rows, key_codes, found = [], [], {}
    wanted = {keys.index(x): x for x in ("GT", "DP", "AD") if x in keys}
    for k in range(int(many.max(initial=0))):
        some = np.flatnonzero(many > k)
        number, behind = chunk.described(some, place[some])
        values, _ = chunk.described(some, behind)
        place[some] = values.at + values.n * _WIDTHS[values.kind] * people[some]
        codes = chunk.flat(number)[0]
        key_rows.append(some)
        key_codes.append(codes)
        for code, name in wanted.items():
            found.setdefault(name, []).append(values.take(codes == code))
    row = np.concatenate(key_rows or [np.zeros(0, np.int64)])
    order = np.argsort(row, kind="stable")
    codes = np.concatenate(key_codes or [np.zeros(0, np.int64)])[order]
    shown = np.where(many > 0, people, 0)  # records without FORMAT have no samples
    ends = np.append(0, np.cumsum(shown))
    columns = []
    for name, single in (("GT", False), ("DP", True), ("AD", False)):
        values = _Values.joined(found.get(name, []))
        each = shown[values.row]
        person = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        size = np.repeat(values.n * _WIDTHS[values.kind], each)
        one = _Values(np.repeat(ends[values.row], each) + person, *(np.repeat(x, each) for x in (values.kind, values.n)), np.repeat(values.at, each) + person * size)
        out, there, offsets = chunk.flat(one)
        if name == "GT":
            there, out = there & (out >> 1 > 0), (out >> 1) - 1
        got = _numbers_of(out, there, offsets, pa.int32(), single)
        columns.append(_spread(int(ends[-1]), one.row, got))
    items = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind.value_type)], fields=list(kind.value_type))
    return (np.searchsorted(row[order], np.arange(n + 1)), codes), _lists(ends, items)
