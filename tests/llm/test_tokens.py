"""Token operators against the libraries, brute force and exact round trips."""

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from locusflow.llm import bpe, token_counts, token_files
from locusflow.llm._chunks import Held, Memo, TextEncoder, byte_bpe, grouped, rank_bpe, without_long_spaces
from locusflow.llm._words import batches

DOCS = "/root/testdata/sf0.001/documents.parquet"
WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", "a", " a  b ", "don't we'LL I'M '", "<|endoftext|>", "x<|startoftext|>y<|ENDOFTEXT|>z", " <|endoftext|> ",
    "Σίσυφος ΣΑΣ", "İstanbul ǅ Ⅷ ½ ²", "e\u0301 \u0308a", "日本語テキスト", "a\x1cb\x1d c\x85d\xa0e\u2003f", "\n\n a\n b \n",
    "x" * 5000, "ab" * 3000, " \t\ta", "a\r\nb", "😀😀 ok", "a\u200bb\ufeff", "\x00\x01", "ſ K Å ﬁ ’s", "Ɓ ƀ Ⱥ",
]


def noise(n):
    rng = random.Random(7)
    letters = "abé'’s12 .\n\t-<|>endoftextΣ日\u0301\x1c"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def library_of(file):
    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library():
    library, own = Tokenizer.from_file(WORD), bpe.Bpe(WORD)
    texts = ODD + noise(1500) + [f"a{chr(c)}b {chr(c)}'s" for c in range(1, 0x500)]
    for text, ids in zip(texts, own.encode(texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_words_equal_the_library(monkeypatch):
    library, own = Tokenizer.from_file(WORD), bpe.Bpe(WORD)
    rng = random.Random(12)
    texts = ["q" * 100_000, "".join(rng.choice("etaoinshrdlu") for _ in range(60_000)), "x" * 4097, "ab" * 5000]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "LONG", 2)
    words = [w for t in ODD + noise(200) for w in (t or "").split()]
    for text, ids in zip(words, bpe.Bpe(WORD).encode(words)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_segment_tree_takes_the_leftmost_lowest_rank():
    own = bpe.Bpe(WORD)
    ranks = {}
    for slot in np.flatnonzero(own.ranks >= 0):
        key = int(own.keys[slot])
        ranks[key >> 32, key & 0xFFFFFFFF] = int(own.ranks[slot])
    for word in [b"a", b"international", b"aaaaaaaaa", b"zzzzzz", bytes(range(40, 90)) * 3]:
        ids = [int(own.inner[b]) for b in word[:-1]] + [int(own.last[word[-1]])]
        while True:
            best = min(((ranks.get(p, 1 << 30), k) for k, p in enumerate(zip(ids, ids[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                break
            ids[best[1] : best[1] + 2] = [int(own.into[best[0]])]
        assert np.frombuffer(own.merge([word])[0], "<u4").tolist() == ids


def test_bpe_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, None)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.with_tokens(df, WORD).collect()}
    assert len(got[1].ids) == 8 and got[2].ids == b"" and got[2].decoded == ""
    assert bpe.with_tokens(df.limit(0), WORD).count() == 0


def test_chunked_encoders_equal_whole_texts():
    library, own = Tokenizer.from_file(BYTE), TextEncoder(byte_bpe(BYTE))
    texts = ODD + noise(1500)
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_rank_encoder_equals_the_library_on_whole_texts():
    library, own = library_of(RANKS), TextEncoder(rank_bpe(RANKS))
    texts = [*ODD, " \nb", " \n日", "a \nb c", " \n <", " \n\n<", "a  \n b", *noise(3000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode_ordinary(text or ""), repr(text)


def test_long_white_space_equals_the_library():
    library, own = library_of(RANKS), TextEncoder(rank_bpe(RANKS))
    spaces = [" ", "\n", " \n", "\t", "\u3000", "\xa0 ", "\r\n"]
    texts = [x for s in spaces for x in (s * 20_000, s * 20_000 + "b", "a" + s * 20_000, "é" + s * 9000 + "'s" + s * 9000 + "1 2")]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode_ordinary(text), repr(text[:3] + text[-3:])
    short = without_long_spaces(library.encode_ordinary, library._encode_single_piece, 2)
    for text in [*ODD, *noise(3000)]:
        assert not text or short(text) == library.encode_ordinary(text), repr(text)
    for s in spaces:
        for tail in ("", "b", " b"):
            n = 10**6 // len(s)
            ids = np.frombuffer(own.encode([s * n + tail])[0], "<u2")
            assert library.decode(ids.tolist()) == s * n + tail
    word = np.frombuffer(own.encode(["x" * 10**6])[0], "<u2")
    assert word.tolist() == library.encode_ordinary("x" * 10**6)


def test_memo_is_bounded_and_right():
    memo = Memo(lambda pieces: [x.encode() * 50 for x in pieces], most=20_000)
    rng = random.Random(1)
    for _ in range(300):
        some = {str(rng.randrange(500)) for _ in range(20)}
        have = memo.have(some)
        assert all(have[x] == x.encode() * 50 for x in some)
        assert memo.size < 30_000 and len(memo.new) + len(memo.old) < 200


def test_token_files_round_trip(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(5000 + k, t) for k, t in enumerate(ODD)], docs.schema))
    library = Tokenizer.from_file(BYTE)
    manifest = token_files.write_token_files(docs, token_files.byte_encoder(BYTE), 2)
    got = token_files.read_documents(manifest).orderBy("start").collect()
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    start, stream = 0, []
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        stream += ids
    first = manifest.orderBy("shard").first()
    sequences = token_files.Sequences(first.path)
    ids, mask = sequences[0]
    n = sum(mask.to_pylist())
    assert len(ids) == token_files.LENGTH and ids[:n].tolist() == stream[:n]
    assert token_files.read_documents(token_files.write_token_files(docs.limit(0), token_files.byte_encoder(BYTE), 2)).count() == 0


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = random.Random(3)
    lengths = [rng.choice([0, 0, 1, 5, 300]) for _ in range(200)]
    flat = [x for n in lengths for x in [1] * n + [9]] + [1] * 17
    (tmp_path / "a.bin").write_bytes(np.array(flat, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    rows = [(1, f"file://{tmp_path}/a.bin", 2 * len(flat)), (2, f"file://{tmp_path}/b.bin", 0)]
    files = spark.createDataFrame(rows, "file long, path string, bytes long")
    for block in (3, 64, 100_000):
        got = token_counts.scan_separators(files, 9, block).orderBy("ordinal").collect()
        assert [(r.ordinal, r.n_tokens, r.ended) for r in got] == [
            *((k, n, True) for k, n in enumerate(lengths)), (len(lengths), 17, False)]


def test_token_counts(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(1, "again"), (None, "no id")], "doc_id long, text string")
    whole = library_of(RANKS)
    want = sorted((r.doc_id is None, r.doc_id or 0, len(whole.encode_ordinary(r.text or ""))) for r in docs.collect())
    got = token_counts.count_tokens(docs, token_files.rank_encoder(RANKS), 50256).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(docs.limit(0), token_files.rank_encoder(RANKS), 50256).count() == 0


def test_token_counts_of_long_repeated_and_clashing_rows(spark):
    long = ["ab cd. " * 200_000, "x" * 1_000_000, None, "ab", "ab"]
    docs = spark.createDataFrame([(k % 4, t, k, "f") for k, t in enumerate(long)], "doc_id long, text string, n_tokens int, file string")
    library = library_of(RANKS)
    want = sorted((k % 4, len(library.encode_ordinary(t[:2000] if t and " " not in t else t or ""))) for k, t in enumerate(long))
    docs = docs.withColumn("text", docs.text.substr(1, 2000)).where("n_tokens = 1").unionAll(docs.where("n_tokens != 1"))
    found = token_counts.count_tokens(docs, token_files.rank_encoder(RANKS), 50256)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == want


def odd_table(spark):
    """Null and repeated ids, repeated rows, very long texts and columns whose names clash."""
    texts = [*ODD, "same", "same", None, "ab cd. " * 250_000, "y" * 3000]
    ids = [None if k % 9 == 4 else k % 30 for k in range(len(texts))]
    rows = [(i, t, f"x{k}", k, "s") for k, (i, t) in enumerate(zip(ids, texts))] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, _range string"), [(i, t) for i, t, *_ in rows]


def test_encoding_of_odd_rows(spark):
    docs, rows = odd_table(spark)
    library = Tokenizer.from_file(WORD)
    got = bpe.with_tokens(docs, WORD, keep=["doc_id", "n_tokens"]).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, ((r.doc_id, bytes(r.ids), r.decoded) for r in got))) == sorted(map(str, want))


def test_token_files_of_odd_rows(spark):
    docs, rows = odd_table(spark)
    library = Tokenizer.from_file(BYTE)
    got = token_files.read_documents(token_files.write_token_files(docs, token_files.byte_encoder(BYTE), 2)).orderBy("start").collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))


def test_batches_cover_all():
    texts = ["a" * n for n in (5, 0, 100, 3, 3)] + [None]
    assert [x for a, b in batches(texts, 8) for x in texts[a:b]] == texts


def test_a_memo_looks_up_its_pieces_only():
    from locusflow.llm._chunks import Memo

    class Held(dict):
        def keys(self):
            raise AssertionError("all that is held would be gone through")

    memo = Memo(lambda pieces: [x.encode() for x in pieces])
    memo.new = Held(a=b"a", b=b"b")
    assert memo.have({"b", "c"}) == {"a": b"a", "b": b"b", "c": b"c"}


def test_single_words_among_other_pieces():
    import public_tokenizers
    from tokenizers import Tokenizer

    from locusflow.llm._chunks import TextEncoder, byte_bpe

    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    texts = ["word", " ", "Ärger über word, word's 12 x2 don't", "word word\nword. ñ ½ 3½", "<|endoftext|> a", "'s s 's", "", "1 2 3"]
    got = TextEncoder(byte_bpe(file)).encode(texts)
    assert got == [b"".join(i.to_bytes(2, "little") for i in library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_words_are_encoded_once_whatever_signs_follow_them():
    asked = []

    def compute(pieces):
        asked.extend(pieces)
        return [x.encode() for x in pieces]

    coder = TextEncoder(compute)
    texts = ["word, word. über12 word\nword; don't a<|b|>, 日本, word", "über,"]
    assert coder.encode(texts) == [x.encode() for x in texts]
    assert sorted(asked) == sorted(set(asked))
    assert set(asked) == {"word", " word", ",", ".", ";", " über", "über", "12", "\n", " don't", " a<|b|>,", " 日本,"}
    coder.encode(texts[::-1])
    assert len(asked) == len(set(asked))


def test_runs_of_white_space_are_cut_as_the_pattern_does():
    asked = []

    def compute(pieces):
        asked.extend(pieces)
        return [x.encode() for x in pieces]

    texts = ["a\n\nb  c \n", " \n", "\n \nd", "  e\n", "", "f \n <|g", "a\tb"]
    assert TextEncoder(compute).encode(texts) == [x.encode() for x in texts]
    assert set(asked) == {"a", "\n", "b", " ", " c", " \n", "\n ", "d", " e", "f \n <|g", "a\tb"}


def test_many_rare_words_are_held():
    asked = 0

    def compute(pieces):
        nonlocal asked
        asked += len(pieces)
        return [b"12"] * len(pieces)

    coder = TextEncoder(compute)
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(str(k).translate(letters) for k in range(a, a + 100_000)) for a in range(100_000, 900_000, 100_000)]
    for _ in range(2):
        for text in texts:
            assert len(coder.encode([text])[0]) == 200_000
    assert asked < 800_100


def test_held_pieces_are_bounded_and_right():
    import pyarrow as pa

    held = Held(lambda pieces: [x.encode() * 50 for x in pieces], most=20_000)
    rng = random.Random(1)
    for _ in range(300):
        some = [str(rng.randrange(500)) for _ in range(40)]
        assert held.of(pa.array(some)).to_pylist() == [x.encode() * 50 for x in some]
        assert held.pieces.nbytes + held.values.nbytes <= 20_000
    assert held.of(pa.array([], pa.string())).to_pylist() == []


def test_words_of_mixed_signs_equal_the_library():
    library, own = Tokenizer.from_file(BYTE), TextEncoder(byte_bpe(BYTE))
    ranks, other = library_of(RANKS), TextEncoder(rank_bpe(RANKS))
    signs = [*"aBéß×÷ªºµ½²¾70,.'<|>¡¬ſƀЯ日😀“_-©\xad\x7f\x00\x80́٣Ⅷ", "'s", "'ll", "<|endoftext|>", "  ", "\t", "\xa0", *"     \n\n"]
    rng = random.Random(7)
    for _ in range(40):
        some = [*rng.sample(signs, rng.randint(2, len(signs))), " "]
        texts = ["".join(rng.choices(some, k=rng.randint(0, 30))) for _ in range(50)]
        for text, a, b in zip(texts, own.encode(texts), other.encode(texts), strict=True):
            assert np.frombuffer(a, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
            assert np.frombuffer(b, "<u2").tolist() == ranks.encode_ordinary(text), repr(text)


def test_grouped_batches_keep_all_rows_in_order():
    import pyarrow as pa

    texts = ["a" * n for n in (5, 0, 100, 3, 3)] + [None, "", "é" * 30, "b"]
    parts = [pa.record_batch({"k": pa.array(range(a, b), pa.int64()), "text": pa.array(texts[a:b], pa.string())}) for a, b in ((0, 4), (4, 4), (4, 9))]
    for most in (1, 60, 1000):
        got = list(grouped(iter(parts), most))
        assert [x for g in got for x in g.column("text").to_pylist()] == texts
        assert [x for g in got for x in g.column("k").to_pylist()] == list(range(9))
        assert all(g.num_rows == 1 or sum(16 + len((x or "").encode()) for x in g.column("text").to_pylist()) <= most for g in got)
    assert list(grouped(iter([]))) == list(grouped(iter(parts[1:2]))) == []
