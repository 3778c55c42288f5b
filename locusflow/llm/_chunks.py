"""Encoding of whole texts by their repeated pieces.

Byte-level BPE with the usual pattern never joins its words, and Latin letters, digits, signs and white space show where
they end. A text is cut there (elsewhere before a single space between two other characters), each distinct piece is
encoded once, and the results are joined: the ids are those of the whole text. Pieces are found, told apart, looked up
and joined as Arrow arrays, so what repeats costs no Python object.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that Python or a tokenizer takes for white space, but for the space and the newline.
_RARE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts with such, or with a run of white space before what may be a special token, in the syntax of Arrow's expressions.
_ODD = _RARE.pattern + r"|[ \n]{2}<\|"
#: A piece that can be a line of a text: no white space but for one space at its start.
_ONE = re.compile(r" ?\S+")


#: Bytes of an encoder's pieces: many of them are rare, and encoding them again is most of the work.
HELD = 32 << 20
#: Bytes of text, about, that are encoded together: pieces that repeat in them are looked up once.
GROUP = 8 << 20


class Memo:
    """Values of pieces, computed in groups. Two generations of about ``most`` bytes each are kept: what was
    used lately stays, memory is bounded. (The pieces of one call are all held until the next.)"""

    #: Bytes of a piece's entry besides its text and value: the objects' heads and the table's slot.
    ENTRY = 200

    def __init__(
        self, compute: Callable[[list[str]], Iterable], most: int = 8 << 20, weigh: Callable[[object], int] = len
    ) -> None:
        """weigh: about how many bytes a value takes."""
        self.compute, self.most, self.weigh = compute, most, weigh
        self.new: dict = {}
        self.old: dict = {}
        self.size = 0

    def have(self, pieces: set) -> dict:
        """A dictionary with all these pieces (and others)."""
        missing = pieces.difference(self.new)  # looks up these pieces; with keys() it would go through all that are held
        if missing:
            if self.size > self.most:
                self.old, self.new, self.size = self.new, {}, 0
                missing = pieces
            old = self.old
            known = missing & old.keys() if old else ()
            todo = list(missing.difference(known))
            values = list(self.compute(todo))
            self.new.update(zip(todo, values, strict=True))
            held = [old[x] for x in known]
            self.new.update(zip(known, held))
            self.size += self.ENTRY * len(missing) + sum(map(len, missing))
            self.size += sum(map(self.weigh, values)) + sum(map(self.weigh, held))
        return self.new


_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_OTHER, _LETTER, _DIGIT, _SIGN, _SPACE, _NEWLINE, _LEAD = range(7)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes, and of the characters of two bytes up to U+017F by their bytes."""
    letter, digit = re.compile(f"[{_LETTERS}]"), re.compile(f"[{_DIGITS}]")

    def kind(c: int) -> int:
        if c <= 32 or 127 <= c <= 160 or c in (ord("'"), 0xAD):
            return {32: _SPACE, 10: _NEWLINE}.get(c, _OTHER)
        return _LETTER if letter.match(chr(c)) else _DIGIT if digit.match(chr(c)) else _SIGN

    single = [kind(c) for c in range(128)] + [_LEAD if 0xC2 <= b <= 0xC5 else _OTHER for b in range(128, 256)]
    return np.array(single, np.uint8), np.array([kind(c) for c in range(128, 384)], np.uint8).reshape(4, 64)


_KINDS, _PAIRS = _kinds()


def joined(values: pa.Array, at: np.ndarray) -> pa.LargeBinaryArray:
    """Values ``at[k]`` to ``at[k + 1]`` put together, for each k, without a copy."""
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset :][at] if len(values) else np.zeros(len(at), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends), values.buffers()[2]])


class Held:
    """Encoded bytes of pieces, computed in groups and held in two Arrow arrays: a rare piece takes about 30 bytes.
    Beyond ``most`` bytes only the pieces of the last call stay."""

    def __init__(self, compute: Callable[[list[str]], Iterable[bytes]], most: int = HELD) -> None:
        self.compute, self.most = compute, most
        self.pieces, self.values = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def of(self, pieces: pa.Array) -> pa.LargeBinaryArray:
        """The bytes of each piece; pieces may repeat."""
        found = pieces.dictionary_encode()
        distinct = found.dictionary
        at = pc.index_in(distinct, self.pieces)
        missing = at.is_null()
        todo = distinct.filter(missing)
        if len(todo):
            place = at.fill_null(0).to_numpy().astype(np.int64)
            place[missing.to_numpy(zero_copy_only=False)] = np.arange(len(todo)) + len(self.pieces)
            at = pa.array(place)
            values = pa.array(self.compute(todo.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
            self.pieces = pa.concat_arrays([self.pieces, todo])
            self.values = pa.concat_arrays([self.values, values])
        values = self.values.take(at)
        if self.pieces.nbytes + self.values.nbytes > self.most:
            self.pieces, self.values = distinct, values
        return values.take(found.indices)


def _edges(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 of texts with no white space but spaces and newlines (``ends``: where texts begin
    and end), and the end. As in the pattern, of white space before another character all but the last is a piece, and
    the last one, if a newline; a space belongs to what follows. That is cut into words if it holds Latin letters,
    digits and signs only, no apostrophe (contractions) and no ``<|`` (special tokens)."""
    kind = _KINDS[raw]
    lead = np.flatnonzero(kind == _LEAD)  # of two bytes
    kind[lead] = kind[lead + 1] = _PAIRS[raw[lead] - 0xC2, raw[lead + 1] & 0x3F]
    newline = kind == _NEWLINE
    white = (kind == _SPACE) | newline
    last = white.copy()
    last[:-1] &= ~white[1:]
    last[ends[ends > 0] - 1] = False
    edge = np.zeros(len(raw) + 1, bool)
    edge[:-1] = last
    edge[1:] |= last & newline
    edge[1:-1] |= white[1:] & ~white[:-1]
    edge[ends] = True
    whole = np.flatnonzero(edge)
    edge[1:-1] |= (kind[1:] != kind[:-1]) & ~white[1:] & ~white[:-1]
    other = kind == _OTHER
    other[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    other = np.unique(np.searchsorted(whole, np.flatnonzero(other), "right"))
    if len(other):
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[whole[other - 1] + 1] += 1
        inside[whole[other]] -= 1
        edge &= np.cumsum(inside[:-1], dtype=np.int8) == 0
    return np.flatnonzero(edge)


class TextEncoder:
    """compute: gives the encoded bytes of each of a list of strings."""

    def __init__(self, compute: Callable[[list[str]], Iterable[bytes]], most: int = HELD) -> None:
        self.held = Held(compute, most)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_array(pa.array([x or "" for x in texts], pa.string())).to_pylist()

    def encode_array(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """The encoded bytes of each text; texts: strings, none null, of less than 2 GB in all."""
        texts = texts.cast(pa.string())
        odd = pc.match_substring_regex(texts, _ODD)
        if not odd.true_count:
            return self._plain(texts)
        out = pa.concat_arrays([self._plain(texts.filter(pc.invert(odd))), self._odd(texts.filter(odd).to_pylist())])
        is_odd = odd.to_numpy(zero_copy_only=False)
        return out.take(pa.array(np.argsort(np.argsort(is_odd, kind="stable"))))

    def _plain(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """Of texts with no white space but spaces and newlines."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends.astype(np.int64) - ends[0]
        at = _edges(raw, ends)
        pieces = pa.Array.from_buffers(
            pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)]
        )
        return joined(self.held.of(pieces), np.searchsorted(at, ends))

    def _odd(self, texts: list[str]) -> pa.LargeBinaryArray:
        pieces, ends = [], [0]
        for text in texts:
            first, *rest = _CUT.split(text)
            pieces.append(first)
            pieces += [" " + x for x in rest]
            ends.append(len(pieces))
        return joined(self.held.of(pa.array(pieces, pa.string())), np.array(ends))


def grouped(batches: Iterable[pa.RecordBatch], most: int = GROUP) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in batches with about so many bytes of text (a longer text is alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        begin = 0
        for k, n in enumerate(pc.binary_length(batch.column("text")).fill_null(0).to_pylist()):
            n += 16  # an empty text's row
            if size and size + n > most:
                yield _one([*held, batch.slice(begin, k - begin)])
                held, size, begin = [], 0, k
            size += n
        held.append(batch.slice(begin))
    if size:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*[p.columns for p in parts])], schema=parts[0].schema)


#: White space of the pattern, so much of it that a library's recursion would not end well.
LONG_SPACE = 4096
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def without_long_spaces(
    encode: Callable[[str], list[int]], single: Callable[[str], list[int]], least: int = LONG_SPACE
) -> Callable[[str], list[int]]:
    """encode, with long runs of white space cut out first. Of a run before another character the pattern takes all
    but the last as a piece, and at a text's end all; ``single`` encodes a piece."""
    runs = re.compile(f"[{_SPACES}]{{{least},}}")

    def whole(text: str) -> list[int]:
        out, at = [], 0
        for run in runs.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += encode(text[at : run.start()])
            out += single(text[run.start() : end])
            at = end
        return out + encode(text[at:]) if at else encode(text)

    return whole


def by_lines(encode: Callable[[str], list[int]], lines: int = 8000) -> Callable[[list[str]], list[bytes]]:
    """ids (as 16-bit integers) of many pieces in few calls: pieces without white space inside are encoded
    as lines of one text, whose newlines keep them apart."""
    newline = encode("\n")[0]

    def compute(pieces: list[str]) -> list[bytes]:
        out = [b""] * len(pieces)
        plain = []
        for k, x in enumerate(pieces):
            if _ONE.fullmatch(x) and not _RARE.search(x):
                plain.append(k)
            elif x:
                out[k] = np.array(encode(x), "<u2").tobytes()
        for a in range(0, len(plain), lines):
            part = plain[a : a + lines]
            ids = np.array(encode("\n".join([pieces[k] for k in part])), "<u2")
            packed = ids.tobytes()
            ends = (np.flatnonzero(ids == newline) * 2).tolist() + [len(packed)]
            begin = 0
            for k, end in zip(part, ends, strict=True):
                out[k] = packed[begin:end]
                begin = end + 2
        return out

    return compute


#: A piece of printable Latin characters, of which none is white space, behind one space at most.
_PLAIN = re.compile(" ?[!-~¡-¬®-ſ]+")
_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^ \n{_LETTERS}{_DIGITS}]+|\n"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the letters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + others.index(b)) for b in range(256)]


def byte_bpe(file: str) -> Callable[[list[str]], list[bytes]]:
    """ids, as 16-bit integers, by the tokenizers library; special tokens in a text are recognised as
    the library does by default.

    Pieces of Latin letters, digits and signs are cut into words here, which go to the library's model; every
    other piece goes through its whole encoding.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids need more than 16 bits")
    tokenizer.no_padding()
    tokenizer.no_truncation()
    model = tokenizer.model
    letters = dict(enumerate(byte_letters()))
    space = letters[32]
    packed = [i.to_bytes(2, "little") for i in range(1 << 16)]

    def compute(pieces: list[str]) -> list[bytes]:
        out = []
        for x in pieces:
            if _PLAIN.fullmatch(x) and "<|" not in x:
                ids = b""
                for word in _WORDS.findall(x):
                    if word.isascii():  # of these characters only the space has another letter
                        word = space + word[1:] if word[0] == " " else word
                    else:
                        word = word.encode().decode("latin-1").translate(letters)
                    ids += b"".join([packed[t.id] for t in model.tokenize(word)])
                out.append(ids)
            elif x:
                ids = tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids
                out.append(np.array(ids, "<u2").tobytes())
            else:
                out.append(b"")
        return out

    return compute


def rank_bpe(file: str) -> Callable[[list[str]], list[bytes]]:
    """By the tiktoken library, from a file of ranks; no special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding, single = (
        tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for name, pattern in (("ranks", public_tokenizers.PATTERN), ("piece", "(?s:.+)"))
    )
    return by_lines(without_long_spaces(encoding.encode_ordinary, single.encode_ordinary))
