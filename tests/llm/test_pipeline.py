"""Each stage of the corpus pipeline against a plain computation of what it decides."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from locusflow.llm.jaccard_join import jaccard_join
from locusflow.llm.mixing import mix
from locusflow.llm.secret_scan import find_spans
from locusflow.llm.toxicity import fit, with_severity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "secret_scans", "mixing", "bpe_encoding"]
    for df in stages[:-1]:
        assert tuple(df.columns) == cp.COLUMNS


def test_toxicity_stage(spark, stages):
    model = fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in with_severity(stages[0], model).filter("not rejected").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept


def test_duplicates_stage(stages):
    classes = jaccard_join(stages[1]).collect()
    assert {r.doc_id for r in stages[2].collect()} == {r.class_id for r in classes}


def test_secrets_stage(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = stages[3].collect()
    assert len(after) == len(before)
    for r in after:
        old = before[r.doc_id].text
        assert r.n_chars == len(r.text) and (r.text == old) == (not find_spans(old))


def test_mixing_stage(stages):
    times = Counter(r.doc_id for r in stages[4].collect())
    want = {r.doc_id: len(r.positions) for r in mix(stages[3], least=1.0, cut=False).collect()}
    assert all(times[k] == max(1, n) for k, n in want.items()) and set(times) == set(want)


def odd(spark):
    """Null columns, empty and very long texts, repeated and equal rows, ids without a value."""
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, None, None, None, None),
            (None, "", "en", "t", 0), (None, "token=abcdefgh z", None, "t", 16), (3, "word " * 300_000, "de", None, 1), (4, "q" * 1_200_000, "fr", "s", 1),
            (5, "   ", "fr", "u", 3), (6, "A b  c d\ne f", "en", "v", 12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans", F.lit(1)).withColumn("_row", F.lit("x"))


def test_stages_of_odd_rows(spark):
    docs = odd(spark)
    kept = cp.toxicity(spark, docs, SF)
    assert kept.count() == 10 and tuple(kept.columns) == cp.COLUMNS
    left = cp.near_duplicates(spark, docs, SF)
    ids = Counter(r.doc_id for r in left.collect())
    assert ids == Counter({1: 1, 2: 1, None: 3, 3: 1, 4: 1, 5: 1}) and tuple(left.columns) == cp.COLUMNS
    clean = cp.secrets(spark, docs, SF).collect()
    assert len(clean) == 10 and "[SECRET] z" in {r.text for r in clean} and all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean)
    mixed = cp.mixing(spark, docs, SF).collect()
    times = Counter((r.doc_id, (r.text or "")[:20], r.source) for r in mixed)
    want = Counter((r.doc_id, (r.text or "")[:20], r.source) for r in docs.collect())
    assert times.keys() == want.keys() and all(n <= times[k] <= 2 * n for k, n in want.items())
    assert cp.bpe_encoding(spark, docs, SF).count() == 10


def test_stages_of_an_empty_table(spark):
    docs = odd(spark).limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_encoding_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = stages[5].collect()
    assert len(got) == stages[4].count()
    for r in got[:200]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
