"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit storage.

Every shingle is hashed once. The top bits of the hash name a bin, the rest compete for the bin's
minimum. An empty bin takes the value of the first non-empty bin in its own fixed random order of
bins, so two texts that both miss a bin borrow alike. Of each bin ``bits`` low-order bits are kept,
packed; equal low bits of unequal minima happen with probability 2**-bits, which the likeness
subtracts.

Defined results: null, empty and blank texts have no shingles and the empty fingerprint; two empty
fingerprints have likeness 1, an empty and another one 0. Texts of one to four words have one
shingle. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import tune
from ._words import batches, shingle_hashes
from .ordering import in_ranges

BINS, BITS, WORDS = 512, 4, 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_orders: dict[int, np.ndarray] = {}


def _order(bins: int) -> np.ndarray:
    """[i, j]: the place of bin j in the order in which the empty bin i looks for a value."""
    if bins not in _orders:
        made = np.random.Generator(np.random.PCG64(20240229))
        _orders[bins] = np.stack([made.permutation(bins) for _ in range(bins)]).astype(np.uint16)
    return _orders[bins]


def fingerprint_texts(
    texts: list[str | None], bins: int = BINS, bits: int = BITS, words: int = WORDS
) -> list[bytes]:
    """Packed fingerprints of whole texts. bins: a power of two; bits: 1, 2, 4 or 8."""
    out: list[bytes] = []
    for begin, end in batches(texts):
        out += _fingerprint(texts[begin:end], bins, bits, words)
    return out


def _fingerprint(texts: list, bins: int, bits: int, words: int) -> list[bytes]:
    hashes, offsets = shingle_hashes(texts, words)
    counts = np.diff(offsets)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    cell = np.repeat(np.arange(len(texts)) * bins, counts) + (hashes >> shift).astype(np.int64)
    least = np.full(len(texts) * bins, _EMPTY)
    np.minimum.at(least, cell, hashes & np.uint64((1 << int(shift)) - 1))
    least = least.reshape(len(texts), bins)
    order = _order(bins)
    for k in np.flatnonzero(counts):
        row = least[k]
        empty = row == _EMPTY
        if empty.any():
            full = np.flatnonzero(~empty)
            row[empty] = row[full[order[np.ix_(empty, full)].argmin(1)]]
    low = (least & np.uint64((1 << bits) - 1)).astype(np.uint8)
    per = 8 // bits
    packed = np.zeros((len(texts), bins // per), np.uint8)
    for k in range(per):
        packed |= low[:, k::per] << np.uint8(bits * (per - 1 - k))
    return [packed[k].tobytes() if counts[k] else b"" for k in range(len(texts))]


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of the shingle sets, corrected for chance matches, from 0 to 1."""
    if not a or not b:
        return float(a == b)
    differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    per = 8 // bits
    mask = np.uint8((1 << bits) - 1)
    equal = sum(int(((differ >> np.uint8(bits * k)) & mask == 0).sum()) for k in range(per))
    chance = 2.0**-bits
    return min(1.0, max(0.0, (equal / (len(differ) * per) - chance) / (1 - chance)))


def with_fingerprints(
    df: DataFrame, text: str = "text", bins: int = BINS, bits: int = BITS, words: int = WORDS
) -> DataFrame:
    """df with a column ``fingerprint`` (binary, packed) of the text column. No shuffle."""
    tune(df.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = fingerprint_texts(part.column(text).to_pylist(), bins, bits, words)
            columns = [c for c in part.schema.names if c != "fingerprint"]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in columns] + [pa.array(marks, pa.binary())],
                names=[*columns, "fingerprint"],
            )

    kept = df.drop("fingerprint")
    return kept.mapInArrow(run, kept.withColumn("fingerprint", F.lit(b"")).schema)


NEIGHBOURS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def neighbour_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter of code points is replaced
    by as many from the start of the next document's text (ascending doc_id, after the last the first).

    Null ids come first, equal ids by a hash of the text, null texts count as empty. Documents are dealt once
    into ranges of ids; every range also gets the row that follows it. Other columns are not looked at.
    """
    tune(documents.sparkSession)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return in_ranges(rows, "doc_id", "text", guests=True).select(
        "doc_id", "text", "_guest"
    ).mapInArrow(_neighbours, NEIGHBOURS)


def _neighbours(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    last: tuple | None = None  # id, text and fingerprint of the row that waits for its next
    ended = False
    for part in parts:
        for begin, end in batches(part.column("text").to_pylist()):
            piece = part.slice(begin, end - begin)
            ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
            guest = piece.column("_guest").to_pylist()
            if ended:
                return
            if 1 in guest:  # only the first guest counts: it follows the last row of this range
                ended = True
                cut = guest.index(1) + 1
                ids, texts = ids[:cut], texts[:cut]
            marks = fingerprint_texts(texts)
            if last is not None:
                ids.insert(0, last[0])
                texts.insert(0, last[1])
                marks.insert(0, last[2])
            edited = []
            for mine, follows in zip(texts, texts[1:]):
                n = len(mine) // 4
                edited.append(mine[: len(mine) - n] + follows[:n])
            if edited:
                theirs = fingerprint_texts(edited)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[:-1], pa.int64()),
                        pa.array([len(x) for x in texts[:-1]], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                        pa.array([x.hex() for x in marks[:-1]]),
                        pa.array([x.hex() for x in theirs]),
                        pa.array([likeness(a, b) for a, b in zip(marks, theirs)], pa.float64()),
                        pa.array([likeness(a, b) for a, b in zip(marks, marks[1:])], pa.float64()),
                    ],
                    schema=schema,
                )
            last = (ids[-1], texts[-1], marks[-1])
