"""A corpus pipeline: documents to training tokens in five stages, each of one operator of locusflow.llm.

Every stage works on all that the one before it kept; its rows are written as Parquet and read again.
The stages but the last return the columns of documents.

Defined results, in every stage: null columns are kept as they are; null and empty texts are not toxic, are no
copies of each other unless their ids are equal, hold no secrets, stay in the mix once and have no ids. Texts are
worked on whole, whatever their length. Of equal rows the second stage keeps one; the others treat them alike. Rows
without a doc_id are documents of their own. An empty table gives an empty table. Columns that documents do not have
are dropped first, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm._shared import new_path, written
from locusflow.llm.bpe import with_tokens
from locusflow.llm.jaccard_join import one_of_each
from locusflow.llm.mixing import key_of, mix
from locusflow.llm.secret_scan import MASK, with_spans
from locusflow.llm.toxicity import fit, with_severity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on those with labels, does not reject."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_severity(docs.select(*COLUMNS), model).filter(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id, of each class of near copies."""
    return one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mask, n_chars follows."""
    found = with_spans(docs.select(*COLUMNS), mask=MASK)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at least once and at most twice, in training order:
    sources get 150 % of all words by weight, between one and two times their own size.

    Positions are shares of all words, so equal ranges of them hold about equal texts and need no sample.
    Documents without words have no position and stand anywhere, by a hash of their key. Equal rows are
    taken alike.
    """
    docs = docs.select(*COLUMNS)
    taken = (
        mix(docs, least=1.0, cut=False)
        .groupBy(F.col("key").alias("_key"))
        .agg(F.min("positions.position").alias("_at"))
    )
    taken = written(taken, "taken")
    rows = docs.withColumn("_row", key_of()).join(taken.hint("merge"), F.col("_row") == F.col("_key"), "left")
    anywhere = F.pmod(F.xxhash64("_row"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("_position", F.explode(F.when(F.size("_at") > 0, F.col("_at")).otherwise(F.array(anywhere))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.least(F.lit(n - 1), F.floor(F.col("_position") * n)).cast("int")
    return rows.repartitionById(n, place).sortWithinPartitions("_position", "doc_id").select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text (little-endian 32-bit), with their number and checksum, and the checksum of the
    text that they decode to."""
    import public_tokenizers

    coded = with_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "source", "lang"])
    return coded.select(
        "doc_id",
        "source",
        "lang",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        "ids",
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mixing),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder; each result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: SQL can express neither the regression nor the token merges; tests compare each stage by brute force.
ORACLE_SQL = None
