"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. The probability of a word
is the sum, over all ways to cut it into pieces, of the products of their probabilities; a forward
algorithm over the positions of the word takes that sum. A text's score in a language is the sum of its
words' log probabilities, and the prediction is the language of the highest score (equal priors). A text's
words are independent, so each distinct word is scored once and looked up afterwards.

Words are maximal runs of letters, lower-cased, with the vocabulary's word mark before them. A letter that
is no piece alone can always be passed at the probability of an unknown piece.

Fitting takes a bounded sample, about SAMPLE texts of each language by a hash of the id, and ROUNDS of
expectation-maximisation, a task for each language: expected piece counts over all segmentations
(forward-backward) of the distinct words, from even probabilities on. Counts are smoothed with ALPHA of the
pooled distribution. A model has a number for each piece and language (32,000 pieces: 256 KB a language); languages are
loaded, sent and scored in blocks of LANGUAGES, each block's best and sum carried on to the next, so no process holds
more. Words are scored in groups bounded by letters times languages.

Defined results: a null text and one without letters is ``und`` with score 0; so is every text when
nothing was learned. The score is the posterior probability of the prediction. Of languages with equal
scores the first by code point is predicted. Texts and words are scored whole, whatever their length. Rows that
repeat are scored each; only lang, text and doc_id are looked at to learn, only text to predict.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._chunks import Memo
from ._shared import small, tune, written
from ._words import LETTERS, batches, no_numbers, words_of

SAMPLE, ROUNDS, ALPHA = 1500, 4, 0.5
LANGUAGES = 128  # of a block
SMALLEST = -290  # power of ten below which a word's least probability is not computed plainly, but by logarithms
LONGER = 512  # letters from which a word is scored by itself
UNKNOWN = "und"
_MARK = "▁"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 18


def vocabulary(file: str) -> list[str]:
    """Lower-case pieces of letters, with or without the word mark, of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)]
    return [
        p
        for p in pieces
        if p and p == p.lower() and (LETTERS.fullmatch(no_numbers(p.lstrip(_MARK))) or p == _MARK)
        and _MARK not in p[1:]
    ]


class Lattice:
    """Finds the pieces in many words at once by the rolling hashes of their substrings."""

    def __init__(self, pieces: list[str]) -> None:
        self.n = len(pieces)  # the id of an unknown letter
        self.longest = max(map(len, pieces), default=1)
        self.keys = np.zeros(1 << _SLOTS, np.uint64)
        self.ids = np.full(1 << _SLOTS, -1, np.int32)
        self.probes = 1
        for i, p in enumerate(pieces):
            h = np.zeros(1, np.uint64)
            for c in p:
                h = self._add(h, np.array([ord(c)], np.uint64))
            slot, n = int(self._slot(h)[0]), 1
            while self.ids[slot] >= 0:
                slot, n = slot + 1 & (1 << _SLOTS) - 1, n + 1
            self.keys[slot], self.ids[slot] = h[0], i
            self.probes = max(self.probes, n)

    @staticmethod
    def _add(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h + c + np.uint64(1)) * _FACTOR
        return h ^ (h >> np.uint64(29))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _FACTOR) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def edges_of(self, word: str) -> list[list[tuple[int, int]]]:
        """Length and id of the pieces at each start of one word, all starts side by side."""
        codes = _matrix([word])[0][0]
        h = np.zeros(len(codes), np.uint64)
        out: list[list[tuple[int, int]]] = [[] for _ in codes]
        for size in range(1, min(self.longest, len(codes)) + 1):
            h = self._add(h[: len(codes) - size + 1], codes[size - 1 :])
            found = self._find(h)
            if size == 1:
                found = np.where(found < 0, self.n, found)
            for start in np.flatnonzero(found >= 0).tolist():
                out[start].append((size, int(found[start])))
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        slot = self._slot(h)
        found = np.full(len(h), -1, np.int32)
        for _ in range(self.probes):
            same = self.keys[slot] == h
            found[same] = self.ids[slot[same]]
            slot = slot + 1 & (1 << _SLOTS) - 1
        return found

    def edges(self, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """codes: (words, letters), padded. For each start and length of a piece: the words that have a
        piece there and its ids. Starts ascend."""
        width = codes.shape[1]
        for start in range(width):
            inside = np.flatnonzero(lengths > start)
            h = np.zeros(len(inside), np.uint64)
            for size in range(1, min(self.longest, width - start) + 1):
                fits = lengths[inside] >= start + size
                if not fits.all():
                    inside, h = inside[fits], h[fits]
                if not len(inside):
                    break
                h = self._add(h, codes[inside, start + size - 1])
                found = self._find(h)
                if size == 1:
                    found = np.where(found < 0, self.n, found)
                have = found >= 0
                if have.any():
                    yield start, size, inside[have], found[have]


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.zeros((len(words), int(lengths.max())), np.uint64)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer(
        "".join(words).encode("utf-32-le", "surrogatepass"), "<u4"
    )
    return codes, lengths


def _groups(words: list[str], most: int = 1 << 17) -> Iterator[np.ndarray]:
    """Indices of words of similar length, so many letters a group at most (a longer word is alone)."""
    order = np.argsort([len(w) for w in words], kind="stable")
    begin = 0
    while begin < len(order):
        end = begin + 1
        step = max(1, most // len(words[order[begin]]))
        end = min(len(order), begin + step)
        while end > begin + 1 and (end - begin) * len(words[order[end - 1]]) > 2 * most:
            end = begin + (end - begin) // 2
        yield order[begin:end]
        begin = end


class Model:
    """log probabilities: (pieces + 1) x languages."""

    def __init__(self, pieces: list[str], languages: list[str], probs: np.ndarray) -> None:
        self.pieces, self.languages, self.probs = pieces, languages, probs
        self._ready: tuple | None = None

    def __getstate__(self):
        return self.pieces, self.languages, self.probs

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def _lattice(self) -> Lattice:
        if self._ready is None:
            self._ready = (Lattice(self.pieces), Memo(self.score_chunks, weigh=lambda v: 0 if v is None else 100 + v.nbytes))
        return self._ready[0]

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each (marked) word in each language, summed over all segmentations."""
        lattice = self._lattice()
        out = np.zeros((len(words), len(self.languages)))
        short = []
        for i, word in enumerate(words):
            if len(word) >= LONGER:
                out[i] = _forward_long(lattice, word, self.probs)
            else:
                short.append(i)
        for part in _groups([words[i] for i in short], (1 << 19) // max(4, len(self.languages))):
            at = np.array(short)[part]
            codes, lengths = _matrix([words[i] for i in at])
            out[at] = _forward(lattice, codes, lengths, self.probs)[1]
        return out

    def score_chunks(self, chunks: list[str]) -> list[np.ndarray | None]:
        cut = words_of(chunks)
        distinct = sorted({w for words in cut for w in words})
        scores = self.score_words([_MARK + w for w in distinct]).astype(np.float32) if distinct else []
        row = {w: k for k, w in enumerate(distinct)}
        return [
            None if not words else scores[row[words[0]]] if len(words) == 1
            else scores[[row[w] for w in words]].sum(0)
            for words in cut
        ]

    def totals(self, texts: list[str | None]) -> list[tuple[str, float, float] | None]:
        """The best language of each text, its total, and the sum of all exp(total - best); None without letters."""
        self._lattice()
        cut = [t.split() if t else [] for t in texts]
        step = max(1, (1 << 23) // max(4, len(self.languages)))  # chunks scored at a time
        many = sum(map(len, cut)) > step
        memo = {} if many else self._ready[1].have({x for chunks in cut for x in chunks})
        out = []
        for chunks in cut:
            total, seen = np.zeros(len(self.languages)), False
            for k in range(0, len(chunks), step):
                part = chunks[k : k + step]
                if many:
                    memo = self._ready[1].have(set(part))
                found = [s for x in part if (s := memo[x]) is not None]
                if found:
                    total, seen = total + np.sum(found, 0, dtype=np.float64), True
            if not seen or not self.languages:
                out.append(None)
                continue
            best = int(total.argmax())
            out.append((self.languages[best], float(total[best]), float(np.exp(total - total[best]).sum())))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [(x[0], 1 / x[2]) if x else (UNKNOWN, 0.0) for x in self.totals(texts)]

    def blocks(self) -> Iterator[Model]:
        yield self


class Models:
    """A model of many languages, of which a block at a time is loaded from a table (lang, probs)."""

    def __init__(self, pieces: list[str], languages: list[str], learned: DataFrame) -> None:
        """languages: sorted."""
        self.pieces, self.languages, self.learned = pieces, languages, learned
        total = sum(self._loaded(names).sum(1, keepdims=True) for names in self._names())
        self.pooled = total / len(languages)

    def _names(self) -> Iterator[list[str]]:
        for k in range(0, len(self.languages), LANGUAGES):
            yield self.languages[k : k + LANGUAGES]

    def _loaded(self, names: list[str]) -> np.ndarray:
        rows = self.learned.filter(F.col("lang").isin(names)).collect()  # at most LANGUAGES rows
        found = {r.lang: r.probs for r in rows}
        even = np.full(len(self.pieces) + 1, 1 / (len(self.pieces) + 1))
        return np.array([found.get(x, even) for x in names]).T

    def blocks(self) -> Iterator[Model]:
        for names in self._names():
            probs = 0.98 * self._loaded(names) + 0.02 * self.pooled  # no piece is impossible in a language
            yield Model(self.pieces, names, probs)


def _forward(lattice: Lattice, codes: np.ndarray, lengths: np.ndarray, probs: np.ndarray):
    """Forward probabilities of all positions, rescaled as they are completed; log totals; scales; edges."""
    n, width = codes.shape
    alpha = np.zeros((width + 1, n, probs.shape[1]))
    alpha[0] = 1
    scale = np.zeros((n, probs.shape[1]))
    total = np.zeros((n, probs.shape[1]))
    last = -1
    for start, size, rows, ids in lattice.edges(codes, lengths):
        if start != last:  # nothing reaches this position any more: rescale it and what lies ahead
            last = start
            if start % 16 == 0 and start:
                by = np.maximum(alpha[start], 1e-300)
                alpha[start : start + lattice.longest] /= by
                scale += np.where(lengths[:, None] >= start, np.log(by), 0)
        alpha[start + size, rows] += alpha[start, rows] * probs[ids]
    total = np.log(np.maximum(alpha[lengths, np.arange(n)], 1e-300)) + scale
    return alpha, total


def _forward_long(lattice: Lattice, word: str, probs: np.ndarray) -> np.ndarray:
    """The log totals of one word, rescaled as its positions are completed."""
    edges = lattice.edges_of(word)
    alpha = np.zeros((len(word) + 1, probs.shape[1]))
    alpha[0] = 1
    scale = np.zeros(probs.shape[1])
    for start, pieces in enumerate(edges):
        row = alpha[start]
        if start % 16 == 0 and start:
            by = np.maximum(row, 1e-300)
            alpha[start : start + lattice.longest] /= by
            scale += np.log(by)
        for size, i in pieces:
            alpha[start + size] += row * probs[i]
    return np.log(np.maximum(alpha[-1], 1e-300)) + scale


def _expected(lattice: Lattice, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts by forward-backward, for one language (probs: one column). A word is taken by logarithms if
    as many letters of the least probability would come near the smallest double."""
    out = np.zeros((lattice.n + 1, 1))
    least = SMALLEST / min(-1.0, np.log10(max(float(probs.min()), 1e-300)))
    long = [k for k, w in enumerate(words) if len(w) >= least]
    for k in long:
        _expected_long(lattice, words[k], counts[k, 0], probs, out)
    if long:
        short = np.setdiff1d(np.arange(len(words)), long)
        words, counts = [words[k] for k in short], counts[short]
    for part in _groups(words):
        codes, lengths = _matrix([words[i] for i in part])
        edges = list(lattice.edges(codes, lengths))
        n, width = codes.shape
        shape = (width + 1, n, probs.shape[1])
        alpha, beta = np.zeros(shape), np.zeros(shape)
        alpha[0] = 1
        for start, size, rows, ids in edges:
            alpha[start + size, rows] += alpha[start, rows] * probs[ids]
        whole = alpha[lengths, np.arange(n)]
        beta[lengths, np.arange(n)] = counts[part] / np.maximum(whole, 1e-300)
        for start, size, rows, ids in reversed(edges):
            onward = beta[start + size, rows] * probs[ids]
            beta[start, rows] += onward
            np.add.at(out, ids, alpha[start, rows] * onward)
    return out


def _expected_long(lattice: Lattice, word: str, count: float, probs: np.ndarray, out: np.ndarray) -> None:
    """The same for one word, by logarithms: no product is too small."""
    edges = [(start, size, i) for start, pieces in enumerate(lattice.edges_of(word)) for size, i in pieces]
    log = np.log(np.maximum(probs[[i for _, _, i in edges], 0], 1e-300)).tolist()
    alpha, beta = [-np.inf] * (len(word) + 1), [-np.inf] * (len(word) + 1)
    alpha[0] = beta[-1] = 0.0
    for (start, size, _), x in zip(edges, log):
        alpha[start + size] = np.logaddexp(alpha[start + size], alpha[start] + x)
    for (start, size, _), x in zip(reversed(edges), reversed(log)):
        beta[start] = np.logaddexp(beta[start], beta[start + size] + x)
    for (start, size, i), x in zip(edges, log):
        out[i, 0] += count * np.exp(alpha[start] + x + beta[start + size] - alpha[-1])


def learn(lattice: Lattice, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Probabilities of the pieces (and of an unknown letter, the last) from distinct marked words."""
    mine = np.full((lattice.n + 1, 1), 1 / (lattice.n + 1))
    for _ in range(ROUNDS if words else 0):
        got = _expected(lattice, words, counts[:, None], mine) + ALPHA / 10
        mine = got / got.sum()
    return mine[:, 0]


def fit(documents: DataFrame, file: str, sample: int = SAMPLE) -> Model | Models:
    """documents: doc_id, text, lang; those with a null lang or text teach nothing."""
    spark = documents.sparkSession
    tune(spark)
    known = documents.filter("lang is not null and text is not null")
    sizes = written(known.groupBy("lang").count(), "languages")
    pieces = vocabulary(file)
    shares = sizes.select("lang", (F.lit(float(sample)) / F.col("count")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    texts = known.select("doc_id", "lang", "text").join(small(shares), "lang").filter(draw < F.col("share"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in parts:
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                seen.update((lang, w) for w in LETTERS.findall(no_numbers(text.lower())))
        keys = list(seen)
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield pa.record_batch(
                [pa.array(x) for x in zip(*part)] + [pa.array([seen[x] for x in part], pa.int64())],
                names=["lang", "word", "n"],
            )

    counted = texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def of_language(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        words, counts = [_MARK + w for w in rows["word"]], rows["n"].to_numpy(np.float64)
        probs = learn(Lattice(vocabulary(file)), words, counts)
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "probs": [probs]})

    learned = written(counted.groupBy("lang").applyInPandas(of_language, "lang string, probs array<double>"), "learned")
    languages = sorted(r.lang for r in sizes.select("lang").collect())  # names only
    if not languages:
        return Model(pieces, [], np.full((len(pieces) + 1, 1), 1 / (len(pieces) + 1)))
    return Models(pieces, languages, learned)


def with_language(documents: DataFrame, model: Model | Models, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of documents (all if None) with lang_pred and score. Only the text is read for
    them. A narrow operation, a step for each block of languages; existing columns of these names are replaced."""
    spark = documents.sparkSession
    tune(spark)
    new = T.StructType().add("lang_pred", "string").add("score", "double")
    steps = T.StructType().add("_lang", "string").add("_best", "double").add("_sum", "double")
    keep = [c for c in (documents.columns if keep is None else keep) if c not in new.names + steps.names]
    rows = documents.select(*{*keep, "text"})

    def step(block: Model, first: bool, last: bool):
        shared = spark.sparkContext.broadcast(block)  # vocabulary x LANGUAGES: bounded
        own = keep if last else rows_names
        into = T.StructType([documents.schema[c] for c in own] + (new if last else steps).fields)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                texts = part.column("text").to_pylist()
                for begin, end in batches(texts):
                    found = shared.value.totals(texts[begin:end])
                    piece = part.slice(begin, end - begin)
                    if not first:
                        before = zip(*(piece.column(c).to_pylist() for c in steps.names))
                        found = [_better(a if a[0] is not None else None, b) for a, b in zip(before, found)]
                    if last:
                        ended = [(x[0], 1 / x[2]) if x else (UNKNOWN, 0.0) for x in found]
                    else:
                        ended = [x or (None, None, None) for x in found]
                    kinds = [pa.string(), pa.float64(), pa.float64()]
                    columns = zip(kinds, zip(*ended)) if ended else zip(kinds, [()] * len(kinds))
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(c) for c in own] + [pa.array(x, kind) for kind, x in columns],
                        names=into.names,
                    )

        return run, into

    rows_names = list(rows.columns)
    blocks = list(range(max(1, -(-len(model.languages) // LANGUAGES)))) if isinstance(model, Models) else [0]
    for k, block in zip(blocks, model.blocks()):
        rows = rows.mapInArrow(*step(block, k == 0, k == blocks[-1]))
    return rows


def _better(a: tuple[str, float, float] | None, b: tuple[str, float, float] | None):
    """The best of two blocks, the sums of both measured from it; the first of equals."""
    if a is None or b is None:
        return a or b
    if b[1] > a[1]:
        return b[0], b[1], b[2] + a[2] * math.exp(a[1] - b[1])
    return a[0], a[1], a[2] + b[2] * math.exp(b[1] - a[1])
