"""Secret scans by one deterministic automaton over all rules.

A rule is a head and a body: it matches its head followed by one or more body bytes, as many as there
are; matches of a kind are leftmost and do not overlap, and one with fewer than ``least`` body bytes
is dropped (what it covers stays covered). A rule may have a tail, which a match takes in as well if it
follows: that of a private key runs from its BEGIN line to its END line.

All rules, read backward, are compiled into one automaton by subset construction and minimisation. One pass
over the bytes of a text, from the last to the first, is in an accepting state of a rule exactly where a
match of that rule can begin: no start is tried in vain. A match then takes its head, by the transition
array of its rule's head, and the run of its body, and the next one begins behind it. So the work is linear in
the text, whatever it holds. (Of a rule without a head only starts with ``least`` body bytes are accepted.
Tails are regular expressions, tried behind each match of their rule; no place is read again for another match.)

Spans are code points, end exclusive, sorted by start and then by the order of the rules. Null and
empty texts have none. Texts are scanned whole, whatever their length; rows that repeat are scanned each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import accumulate
from operator import getitem
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import tune
from .automaton import Automaton


class Tail(NamedTuple):
    """What a match takes in behind it: any number of header fields (``field`` and the rest of its line), then a run of
    ``body`` and ``end``; or, without an end there, ``open``."""

    field: str
    body: str
    end: str
    open: str


class Rule(NamedTuple):
    kind: str
    head: str
    body: str
    least: int
    tail: Tail | None = None


# What follows the BEGIN line of a private key. Line breaks may be written as escapes, lines may have
# margins (indents, quotes, marks of comments). With an END line, the key is what leads to it over header
# fields and a key's characters; without one, the lines of base64 that follow, or runs of 40 and more.
_BREAK = r"[\x20\t\"',+;]*+(?:\\(?:r\\n|[nr])(?:[\x20\t\"',+;]*+\r?\n)?+|\r?\n|\r)"
_MARGIN = r"[\x20\t>#|*\"',+]*+"
_LINE = rf"{_MARGIN}[A-Za-z0-9+/=]++(?=[\x20\t\"',+;]*+(?:[\r\n\\]|\Z))"
_LATER = rf"(?:{_BREAK}{_MARGIN})++[A-Za-z0-9+/=]{{16,}}+(?=[\x20\t\"',+;]*+(?:[\r\n\\]|\Z))"
KEY = Tail(
    field=r"(?:\\[nr]|[\s>#|*\"',+])++[A-Z][A-Za-z0-9-]*+:\x20",
    body=r"(?:[A-Za-z0-9+/=_\s\\\"'>#|*,]|\.{2,}+|-(?!---))*+",
    end=r"-{4,}+END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-*+",
    open=rf"(?:{_BREAK}{_LINE}|{_LATER}|{_MARGIN}[A-Za-z0-9+/=]{{40,}}+)++",
)

BASE = (
    Rule(
        "assign",
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?",
        "[A-Za-z0-9+/_.=-]",
        8,
    ),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32),
)
#: Tokens with a public, fixed prefix, and private keys.
MORE = (
    Rule("github", "gh[oprsu]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 10),
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?----", "-", 1, KEY),
)
RULES = BASE + MORE
MASK = "[SECRET]"
BLOCK = 2048  # bytes


class _Tails:
    """The tails of one rule in a text. Places that several matches lead to are read once: where a field's line ends,
    the fields from there on, a run of the body, an end, an open tail."""

    def __init__(self, data: bytes, tail: Tail) -> None:
        self.data, self.tail = data, tail
        self.fields: dict[int, int] = {}
        self.closed: dict[int, int] = {}
        self.opened: dict[int, int] = {}
        self.line, self.run = (0, -1), (0, -1)

    def end(self, free: int) -> int:
        """Where the match that has come to ``free`` ends with its tail; ``free`` if it has none."""
        at = self._behind_fields(free)
        begin, stop = self.run
        if not begin <= at <= stop:
            stop = self.tail.body.match(self.data, at).end()
            self.run = at, stop
        if stop not in self.closed:
            m = self.tail.end.match(self.data, stop)
            self.closed[stop] = m.end() if m else -1
        if self.closed[stop] >= 0:
            return self.closed[stop]
        if at not in self.opened:
            m = self.tail.open.match(self.data, at)
            self.opened[at] = m.end() if m else -1
        return self.opened[at] if self.opened[at] >= 0 else free

    def _behind_fields(self, at: int) -> int:
        passed = []
        while at not in self.fields:
            passed.append(at)
            m = self.tail.field.match(self.data, at)
            if not m:
                break
            at = self._line_end(m.end())
        last = self.fields.get(at, at)
        self.fields.update(dict.fromkeys(passed, last))
        return last

    def _line_end(self, at: int) -> int:
        begin, stop = self.line
        if not begin <= at <= stop:
            m = _LINE_END.search(self.data, at)
            stop = m.start() if m else len(self.data)
            self.line = at, stop
        return stop


_LINE_END = re.compile(rb"[\r\n\\]")


class _Compiled:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        whole = Automaton([r.head + r.body if r.head else f"{r.body}{{{r.least}}}" for r in rules], search=True, backward=True)
        #: The same states twice: those of a block are passed until one accepts, then listed.
        self.every, self.until, self.start = whole.rows(), whole.rows(stop=True), whole.start
        self.heads = [(a.rows()[a.start] if r.head else None) for r in rules for a in [Automaton([r.head])]]
        bodies = [Automaton([r.body]) for r in rules]
        inside = [a.accepts[a.moves[a.start, a.classes]] > 0 for a in bodies]
        self.bodies = [bytes(x.astype(np.uint8)) for x in inside]
        self.tails = [Tail(*(re.compile(x.encode()) for x in r.tail)) if r.tail else None for r in rules]

    def starts(self, data: bytes) -> list[list[int]]:
        """Where matches of each rule can begin, ascending."""
        found: list[list[int]] = [[] for _ in self.rules]
        back = data[::-1]
        state, n = self.start, len(data)
        for begin in range(0, n, BLOCK):
            block = back[begin : begin + BLOCK]
            if not self.every[state][256]:
                row = reduce(getitem, block, self.until[state])
                if not row[256]:
                    state = row[257]
                    continue
            row = self.every[state]
            for k, row in enumerate(accumulate(block, getitem, initial=row)):
                if k and (bits := row[256]):
                    at = n - begin - k
                    for kind in self.kinds(bits):
                        found[kind].append(at)
            state = row[257]
        for x in found:
            x.reverse()
        return found

    @staticmethod
    @lru_cache(4096)
    def kinds(bits: int) -> list[int]:
        return [k for k in range(bits.bit_length()) if bits >> k & 1]

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """start, rule and end, in bytes, of every match."""
        out = []
        for k, starts in enumerate(self.starts(data)):
            if not starts:
                continue
            least, tail, head = self.rules[k].least, self.tails[k], self.heads[k]
            body = data.translate(self.bodies[k])
            tail = _Tails(data, tail) if tail else None
            free = 0
            for at in starts:
                if at < free:
                    continue
                begin = self._head_end(head, body, data, at)
                free = body.find(0, begin)
                free = free if free >= 0 else len(data)
                if free - begin >= least:
                    free = tail.end(free) if tail else free
                    out.append((at, k, free))
        out.sort()
        return out

    @staticmethod
    def _head_end(head: list | None, body: bytes, data: bytes, at: int) -> int:
        """The end of the longest head from a start that a body byte follows."""
        if head is None:
            return at
        row, i, end = head, at, at
        while i < len(data):
            if row[256] and body[i]:
                end = i
            row = row[data[i]]
            if not row[257]:  # the dead state
                break
            i += 1
        return end


@lru_cache(4)
def _compiled(rules: tuple[Rule, ...]) -> _Compiled:
    return _Compiled(rules)


def find_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = _compiled(rules).matches(data)
    if found and not text.isascii():
        place = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        return [(rules[k].kind, int(place[a]) - 1, int(place[e - 1])) for a, k, e in found]
    return [(rules[k].kind, a, e) for a, k, e in found]


def redact(text: str | None, spans: list[tuple[str, int, int]], mask: str = MASK) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by the mask."""
    if not spans:
        return text
    out, at, until = [], 0, -1
    for _, begin, end in spans:
        if begin >= until:
            if until >= 0:
                at = until
            out += [text[at:begin], mask]
        until = max(until, end)
    return "".join([*out, text[until:]])


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def with_spans(
    df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mask: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """df (or its columns ``keep``) with a column ``spans``; with a mask, the text column is redacted
    too. A narrow operation: no shuffle. An existing column ``spans`` is replaced, others are kept as they
    are, whatever their names."""
    tune(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c != "spans"]
    into = T.StructType([df.schema[c] for c in keep] + [T.StructField("spans", SPANS)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(text).to_pylist()
            spans = [find_spans(t, rules) for t in texts]
            columns = {c: part.column(c) for c in keep}
            if mask is not None:
                columns[text] = pa.array(
                    [redact(t, s, mask) for t, s in zip(texts, spans)], part.column(text).type
                )
            rows = [[{"kind": k, "start": a, "end": e} for k, a, e in s] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(rows, _ARROW)], names=[*columns, "spans"]
            )

    return df.select(*{*keep, text}).mapInArrow(run, into)


def digest(spans: str = "spans"):
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
