"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree are its adjacent pairs, valued rank first and position second; an inner
node has the least of its two children. The root is the leftmost lowest-rank pair. Merging it changes
three leaves (the pair, the one it swallows, the one before it), each a point update of logarithmic
depth; a word is done when no leaf has a rank. Words are merged side by side, those of similar length
in one array; a word of LONG bytes or more has a tree of its own, in lists.

Text is normalised and cut into words as the vocabulary's file says: NFC, lower case, white space
dropped, contractions, runs of letters, single digits, runs of others; a word's last byte carries the
end-of-word mark. Special tokens in the raw text become their ids. Null and empty texts have no ids.
Texts and words may be of any length; rows that repeat are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._chunks import Memo, byte_letters
from ._shared import tune
from ._words import batches

_NONE = np.int64(1 << 62)
_SLOTS = 20
_STEP = 1 << 16  # symbols merged side by side
LONG = 1 << 12
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[^\\S\x1c-\x1f]+")
#: Latin letters up to U+017F are cut here; a chunk with others, or with the one whose lower case is
#: not among them, by the library.
_FAR = re.compile("[^\x00-ſ]|İ")
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\n{_LETTERS}{_DIGITS}]+|\n"
)


class Bpe:
    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [(a, b) if isinstance(m, list) else tuple(m.split(" ")) for m in merges for a, b in [m]]
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.keys = np.full(1 << _SLOTS, -1, np.int64)
        self.ranks = np.full(1 << _SLOTS, -1, np.int64)
        self.probes = 1
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << 32 | vocab[b]
            slot = int(self._slot(np.array([key]))[0])
            n = 1
            while self.keys[slot] >= 0 and self.keys[slot] != key:
                slot = slot + 1 & (1 << _SLOTS) - 1
                n += 1
            if self.keys[slot] < 0:
                self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, n)
        self._library = None
        self._ranks: dict[int, int] = {}
        self._text = text
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo = Memo(self._chunks, 24 << 20)
        self.words = Memo(self.merge)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _FACTOR) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Rank and position of pairs as one number, or none."""
        keys = left << 32 | right
        slot = self._slot(keys)
        rank = np.full(len(keys), -1, np.int64)
        for _ in range(self.probes):
            same = self.keys[slot] == keys
            rank[same] = self.ranks[slot[same]]
            slot = slot + 1 & (1 << _SLOTS) - 1
        return np.where(rank >= 0, rank * size + at, _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """ids of each word, given by its bytes, as little-endian 32-bit integers."""
        out = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        sizes = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            if size >= LONG:
                for i in of.tolist():
                    out[i] = self._merge_long(words[i], size)
                continue
            step = max(1, _STEP // size)
            for k in range(0, len(of), step):
                part = of[k : k + step]
                self._merge([words[i] for i in part], lengths[part], size, out, part.tolist())
        return out

    def _merge(self, words: list[bytes], lengths: np.ndarray, size: int, out: list, part: list[int]) -> None:
        n = len(words)
        raw = np.zeros((n, size), np.uint8)
        place = np.arange(size)
        inside = place < lengths[:, None]
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.zeros((n, size + 1), np.int64)
        ids[:, :size] = self.inner[raw]
        rows = np.arange(n)
        ids[rows, lengths - 1] = self.last[raw[rows, lengths - 1]]
        after = np.tile(np.arange(1, size + 2), (n, 1))  # positions; those past the end are lengths
        before = np.tile(np.arange(-1, size), (n, 1))
        alive = inside
        tree = np.full((n, 2 * size), _NONE)
        w, at = np.nonzero(inside[:, 1:])
        tree[w, size + at] = self._leaf(ids[w, at], ids[w, at + 1], at, size)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        w = np.flatnonzero(tree[:, 1] < _NONE)
        while len(w):
            root = tree[w, 1]
            at = root % size
            ids[w, at] = self.into[root // size]
            gone = after[w, at]
            nxt = after[w, gone]
            alive[w, gone] = False
            after[w, at] = nxt
            before[w, np.minimum(nxt, size)] = at
            tree[w, size + gone] = _NONE
            has = nxt < lengths[w]
            tree[w, size + at] = _NONE
            a, b = w[has], at[has]
            tree[a, size + b] = self._leaf(ids[a, b], ids[a, nxt[has]], b, size)
            prev = before[w, at]
            has = prev >= 0
            a, b = w[has], prev[has]
            tree[a, size + b] = self._leaf(ids[a, b], ids[a, at[has]], b, size)
            nodes = [size + at, size + gone, size + np.maximum(prev, 0)]
            level = size
            while level > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[w, x] = np.minimum(tree[w, 2 * x], tree[w, 2 * x + 1])
                level //= 2
            w = w[tree[w, 1] < _NONE]
        packed = ids[:, :size][alive].astype("<u4").tobytes()
        begin = 0
        for i, end in zip(part, (4 * np.cumsum(alive.sum(1))).tolist()):
            out[i] = packed[begin:end]
            begin = end

    def _merge_long(self, word: bytes, size: int) -> bytes:
        if not self._ranks:
            have = self.keys >= 0
            self._ranks = dict(zip(self.keys[have].tolist(), self.ranks[have].tolist()))
        ranks, into, n, none = self._ranks, self.into.tolist(), len(word), int(_NONE)
        symbols = self.inner[np.frombuffer(word, np.uint8)]
        symbols[-1] = self.last[word[-1]]
        made = np.full(2 * size, _NONE)
        made[size : size + n - 1] = self._leaf(symbols[:-1], symbols[1:], np.arange(n - 1), size)
        level = size
        while level > 1:
            made[level // 2 : level] = np.minimum(made[level : 2 * level : 2], made[level + 1 : 2 * level : 2])
            level //= 2
        tree, ids = made.tolist(), symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(at: int, value: int) -> None:
            node = size + at
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                value = a if a < b else b
                if tree[node] == value:
                    return
                tree[node] = value

        def leaf(a: int, b: int) -> int:
            rank = ranks.get(ids[a] << 32 | ids[b], -1)
            return rank * size + a if rank >= 0 else none

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            nxt = after[gone]
            ids[at] = into[rank]
            ids[gone] = -1
            after[at] = nxt
            before[nxt] = at
            put(gone, none)
            put(at, leaf(at, nxt) if nxt < n else none)
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _library_words(self, chunk: str) -> list[str]:
        """Words of a chunk outside Latin letters: the library's own normaliser and splitter decide."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._text)
            self._bytes = {x: b for b, x in enumerate(byte_letters())}
        normal = self._library.normalizer.normalize_str(chunk)
        words = [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]
        return [bytes(self._bytes[x] for x in w) for w in words]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        cut: list[list] = [[]] * len(chunks)
        plain = []
        for k, chunk in enumerate(chunks):
            if "<|" in chunk and self._split:
                words: list = []
                for x in self._split.split(chunk):
                    words += [self._one(self.special[x])] if x in self.special else self._library_words(x)
                cut[k] = words
            elif not chunk.isascii() and _FAR.search(chunk):
                cut[k] = self._library_words(chunk)
            else:
                plain.append(k)
        words, at = [], 0
        for x in _WORDS.findall("\n".join([chunks[k] for k in plain]).lower()):
            if x == "\n":
                cut[plain[at]] = words
                words = []
                at += 1
            else:
                words.append(x.encode())
        if plain:
            cut[plain[at]] = words
        known = self.words.have({x for words in cut for x in words if x.__class__ is bytes})
        return [
            known[words[0]]
            if len(words) == 1 and words[0].__class__ is bytes
            else b"".join([known[x] if x.__class__ is bytes else x[0] for x in words])
            for words in cut
        ]

    @staticmethod
    def _one(i: int) -> tuple[bytes]:
        """A special token's id, in a tuple to tell it from a word's bytes."""
        return (i.to_bytes(4, "little"),)

    def decode(self, packed: bytes) -> str:
        """The names of ids (little-endian 32-bit), joined by spaces: the vocabulary has no decoder."""
        names = self.names
        return " ".join([names[i] for i in memoryview(packed).cast("I")])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids of whole texts as little-endian 32-bit integers."""
        cut = [
            [] if not t else [x for x in _SPACES.split(t) if x] if _CONTROL.search(t) else t.split()
            for t in texts
        ]
        memo = self.memo.have({x for chunks in cut for x in chunks})
        return [b"".join([memo[x] for x in chunks]) for chunks in cut]


_made: dict[str, Bpe] = {}


def bpe_of(file: str) -> Bpe:
    """One for each file and Python worker."""
    if file not in _made:
        _made[file] = Bpe(file)
    return _made[file]


def with_tokens(
    df: DataFrame, file: str, text: str = "text", keep: list[str] | None = None, decoded: bool = True
) -> DataFrame:
    """The columns ``keep`` of df (all if None) with ``ids`` (binary, little-endian 32-bit) and, if asked
    for, ``decoded``, the text that the ids decode to. A narrow operation: no shuffle. Existing columns of
    these names are replaced; rows that repeat are encoded each.

    file: the vocabulary, at the same path on every executor.
    """
    tune(df.sparkSession)
    new = ["ids", "decoded"][: 1 + decoded]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    into = T.StructType(
        [df.schema[c] for c in keep]
        + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())][: 1 + decoded]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(file)
        for part in parts:
            texts = part.column(text).to_pylist()
            for begin, end in batches(texts):
                piece = part.slice(begin, end - begin)
                found = bpe.encode(texts[begin:end])
                columns = [pa.array(found, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in keep] + columns, names=[*keep, *new]
                )

    return df.select(*{*keep, text}).mapInArrow(run, into)
