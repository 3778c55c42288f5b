"""Token files: Arrow IPC files of fixed-size-list batches.

A file holds sequences of equal length: ``ids`` (fixed_size_list<uint16>), ``mask`` (true for tokens,
false for padding) and ``ends`` (true for a document's last token), both fixed_size_list<bool>, one bit
a token. Documents follow each other without gaps and may span sequences; only a file's last sequence
is padded. A record batch has ROWS sequences, so sequence i is row i % ROWS of batch i // ROWS, and a
memory-mapped file gives it without a copy. Beside each file stands one with the ids of its documents.

Documents are dealt once into ranges of ascending doc_id; each range is one file. Null texts count as
empty, null ids come first, equal ids are ordered by a hash of the text (a frequent one spans files). An empty
table writes no file. Texts may be of any length; rows that repeat are
documents each. Only the columns doc_id and text are looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import TextEncoder, grouped
from ._files import make_dir, place
from ._shared import new_path, tune, written
from .ordering import in_ranges

LENGTH, ROWS = 2048, 64
MANIFEST = "shard int, path string, documents long, tokens long"


def _schema(length: int) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.uint16(), length)),
            ("mask", pa.list_(pa.bool_(), length)),
            ("ends", pa.list_(pa.bool_(), length)),
        ]
    )


class Writer:
    """Writes documents' ids (uint16 bytes) one after another; memory: one record batch."""

    def __init__(self, path: str, length: int = LENGTH, rows: int = ROWS) -> None:
        system, name = place(path)
        self.sink, self.doc_sink = system.open_output_stream(name), system.open_output_stream(name + ".docs")
        self.length, self.size = length, length * rows
        self.schema = _schema(length)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.doc_schema = pa.schema([("doc_id", pa.int64())])
        self.doc_file = pa.ipc.new_file(self.doc_sink, self.doc_schema)
        self.held = bytearray()
        self.ends: list[int] = []
        self.documents = self.tokens = 0

    def add(self, doc_ids: list[int | None], packed: list[bytes]) -> None:
        """packed: each document's ids, its last token included."""
        for x in packed:
            self.held += x
            self.ends.append(len(self.held) // 2 - 1)
            self.tokens += len(x) // 2
            while len(self.held) >= 2 * self.size:
                self._batch(self.size)
        self.documents += len(doc_ids)
        self.doc_file.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64())], schema=self.doc_schema))

    def _batch(self, tokens: int) -> None:
        total = -(-tokens // self.length) * self.length
        ids = np.zeros(total, np.uint16)
        ids[:tokens] = np.frombuffer(bytes(self.held[: 2 * tokens]), "<u2")
        mask = np.zeros(total, bool)
        mask[:tokens] = True
        ends = np.zeros(total, bool)
        ends[[x for x in self.ends if x < tokens]] = True
        bits = [
            pa.Array.from_buffers(
                pa.bool_(), total, [None, pa.py_buffer(np.packbits(x, bitorder="little").tobytes())]
            )
            for x in (mask, ends)
        ]
        columns = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), *bits)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))
        del self.held[: 2 * tokens]
        self.ends = [x - tokens for x in self.ends if x >= tokens]

    def close(self) -> None:
        if self.held:
            self._batch(len(self.held) // 2)
        for x in (self.file, self.sink, self.doc_file, self.doc_sink):
            x.close()


class Sequences:
    """Random access to a file's sequences; views into the mapped file where it is local."""

    def __init__(self, path: str, rows: int = ROWS) -> None:
        system, name = place(path)
        self.source = (
            pa.memory_map(name) if system.type_name == "local" else system.open_input_file(name)
        )
        self.reader, self.rows = pa.ipc.open_file(self.source), rows

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, mask and ends of all tokens of each record batch."""
        for k in range(self.reader.num_record_batches):
            b = self.reader.get_batch(k)
            yield (
                b.column(0).flatten().to_numpy(),
                b.column(1).flatten().to_numpy(zero_copy_only=False),
                b.column(2).flatten().to_numpy(zero_copy_only=False),
            )

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids and mask of sequence i."""
        b = self.reader.get_batch(i // self.rows)
        return b.column(0)[i % self.rows].values.to_numpy(), b.column(1)[i % self.rows].values


def write_token_files(
    documents: DataFrame, encoder: Callable[[], TextEncoder], end: int, folder: str | None = None
) -> DataFrame:
    """Encodes every text, appends the id ``end`` and writes the files; their manifest, itself a written
    table with a row for each file. A task that runs again writes a file of its own; only the file of
    the one that counts is in the manifest."""
    spark = documents.sparkSession
    tune(spark)
    folder = folder or new_path(spark, "token-files")
    make_dir(folder)
    stop = end.to_bytes(2, "little")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = coder = None
        shard = 0
        for part in grouped(parts):
            if out is None:
                shard = part.column("_range")[0].as_py()
                path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.arrow"
                out, coder = Writer(path), encoder()
            packed = [x + stop for x in coder.encode_array(part.column("text")).to_pylist()]
            out.add(part.column("doc_id").to_pylist(), packed)
        if out is not None:
            out.close()
            yield pa.record_batch(
                [pa.array([shard], pa.int32()), pa.array([path]), pa.array([out.documents]), pa.array([out.tokens])],
                names=["shard", "path", "documents", "tokens"],
            )

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = in_ranges(rows, "doc_id", "text").select("doc_id", "text", "_range")
    return written(dealt.mapInArrow(run, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Each document's place and checksum, read back from the files of a manifest: doc_id, start (tokens
    of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    spark = manifest.sparkSession
    tune(spark)
    rows, start = [], 0
    for k, m in enumerate(manifest.orderBy("shard").collect()):  # a row a file
        rows.append((k, m.path, start))
        start += m.tokens
    files = spark.createDataFrame(rows, "place int, path string, start long")
    return files.repartitionById(max(1, len(rows)), F.col("place")).mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for path, start in zip(part.column("path").to_pylist(), part.column("start").to_pylist()):
            system, name = place(path)
            with system.open_input_file(name + ".docs") as source:
                names = pa.ipc.open_file(source).read_all().column("doc_id").to_pylist()
            at = n = crc = 0
            for ids, mask, ends in Sequences(path).batches():
                tokens = memoryview(ids[mask].astype("<u4").tobytes())
                begin, out = 0, []
                for end in (np.flatnonzero(ends[mask]) + 1).tolist():
                    n += end - begin
                    crc = zlib.crc32(tokens[4 * begin : 4 * end], crc)
                    out.append((names[at], start, n, crc))
                    start += n
                    begin, at, n, crc = end, at + 1, 0, 0
                n += len(tokens) // 4 - begin
                crc = zlib.crc32(tokens[4 * begin :], crc)
                if out:
                    yield pa.record_batch(
                        [pa.array(x, pa.int64()) for x in zip(*out)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )


def byte_encoder(file: str) -> Callable[[], TextEncoder]:
    """A factory for tasks; one encoder for each file and Python worker."""

    def make() -> TextEncoder:
        from ._chunks import byte_bpe

        if file not in _encoders:
            _encoders[file] = TextEncoder(byte_bpe(file))
        return _encoders[file]

    return make


def rank_encoder(file: str) -> Callable[[], TextEncoder]:
    def make() -> TextEncoder:
        from ._chunks import rank_bpe

        if file not in _encoders:
            _encoders[file] = TextEncoder(rank_bpe(file))
        return _encoders[file]

    return make


_encoders: dict[str, TextEncoder] = {}
