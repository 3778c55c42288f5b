"""N-gram Jaccard self-join by MinHash banding.

1. Sketch: each text's five-word shingles are hashed and reduced to ``bands`` x ``rows`` MinHashes; each
   band is folded into one key. ``plan_bands`` picks the two numbers: the recall at the threshold is met
   with the fewest collisions of dissimilar texts. Texts with the same word sequence are one class from
   here on, represented by one of them under a number of its own.
2. Banding: representatives meet in the buckets of their band keys. Every representative in a bucket
   with others belongs to one *block*: a hash share of those that name the same largest bucket, of about
   BLOCK members or HASHES shingles, whichever is fewer. Two blocks that meet in any bucket become one block
   pair, once.
3. Verification: block pairs are dealt to tasks by their sizes, the largest first, in turn. The shingle sets of a
   pair are compared in full, by one sparse product. Only counts of
   links and a local root leave the task, never pairs: a group of m near copies costs (m / BLOCK)^2
   tasks' worth of comparisons, spread over the cluster, for which each text's set is sent m / BLOCK
   times, and gives m rows a block.
4. Classes: connected components of the links.

No candidate is capped or sampled; bucket sizes only decide how work is split.

Defined results: a text without words has no shingles, links to nothing and is its own class. Texts of
one to four words have one shingle. Rows with one doc_id are one document, equal texts of which count
once; all its texts are compared, and its links are those of all of them. Each row without a doc_id is a
document of its own. Texts are compared whole, whatever their length; only the columns doc_id and text are
looked at, the others stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions, small, tune, written
from ._words import batches, mix, shingle_hashes
from .components import components
from .ordering import running

THRESHOLD, RECALL, WORDS = 0.8, 0.9999, 5
CHUNK = 64  # blocks of a set that another block of it meets at a time
BLOCK, HASHES = 128, 1 << 17  # a block's texts, and the shingle hashes in them (8 bytes each), on average
SKETCH = "doc_id long, mark long, k1 long, k2 long, shingles long, bands array<long>"
_U = np.uint64


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 200) -> tuple[int, int]:
    """Bands and rows with the most rows (so the fewest false collisions) that find a pair at the
    threshold with the given probability, 1 - (1 - threshold^rows)^bands, by at most ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, 21):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def sketch_texts(texts: list, bands: int, rows: int, words: int = WORDS):
    """Two sequence keys, the number of shingles and the band keys of each text."""
    hashes, offsets = shingle_hashes(texts, words)
    counts = np.diff(offsets)
    keys = np.zeros((2, len(texts)), np.uint64)
    folded = np.zeros((len(texts), bands), np.uint64)
    have = np.flatnonzero(counts)
    if len(have):
        at = offsets[:-1][have]
        place = (np.arange(len(hashes)) - np.repeat(offsets[:-1], counts)).astype(np.uint64)
        for k, factor in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
            keys[k, have] = np.add.reduceat(mix(hashes + place * _U(factor)), at)
        for k, seed in enumerate(_seeds(bands * rows)):
            least = np.minimum.reduceat((hashes ^ seed) * _U(0xFF51AFD7ED558CCD), at)
            folded[have, k // rows] = folded[have, k // rows] * _U(0x9E3779B97F4A7C15) + mix(least)
        folded[have] = mix(folded[have] + np.arange(1, bands + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    return keys.view(np.int64), counts, folded.view(np.int64)


def _row():
    """What tells rows apart, null and repeated ids included: the id and a hash of the text."""
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark")


def sketch(documents: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    tune(documents.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            for begin, end in batches(texts):
                keys, counts, folded = sketch_texts(texts[begin:end], bands, rows, words)
                used = np.where(counts > 0, bands, 0)
                offsets = np.concatenate([[0], np.cumsum(used)]).astype(np.int32)
                values = folded[counts > 0].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").slice(begin, end - begin),
                        part.column("mark").slice(begin, end - begin),
                        pa.array(keys[0]),
                        pa.array(keys[1]),
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ],
                    names=["doc_id", "mark", "k1", "k2", "shingles", "bands"],
                )

    return documents.select(*_row(), "text").mapInArrow(run, SKETCH)


def _blocks(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Block of each representative that shares a bucket, and the pairs of blocks that meet in one.

    Members of one group have different largest buckets. They take the largest that any partner in a
    bucket has, so that a group is cut into few full blocks. What a bucket or a name has in all is
    aggregated and written before it is joined back: Spark can split a hot one.
    """
    entries = reps.select("rep", "shingles", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").count().filter("count > 1")
    # a representative has as many entries as there are bands at most
    shared = written(
        entries.join(sizes, "bucket")
        .groupBy("rep")
        .agg(
            F.first("shingles").alias("shingles"),
            F.max(F.struct("count", "bucket")).alias("largest"),
            F.collect_list("bucket").alias("buckets"),
        ),
        "shared",
    )
    each = shared.select("rep", "largest", F.explode("buckets").alias("bucket"))
    reach = written(each.groupBy("bucket").agg(F.max("largest").alias("best")), "reach")
    homes = each.select("rep", "bucket").join(reach, "bucket").groupBy("rep").agg(F.max("best").alias("best"))
    named = written(shared.join(homes, "rep").select("rep", "shingles", F.col("best.bucket").alias("home"), "buckets"), "homes")
    parts = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("shingles") / F.lit(HASHES)))
    parts = written(named.groupBy("home").agg(parts.alias("parts")), "parts")
    own = written(
        named.join(parts, "home").select(
            "rep", F.xxhash64("home", F.pmod(F.xxhash64("rep"), "parts")).alias("block"), "buckets"
        ),
        "blocks",
    )
    meet = own.select("block", F.explode("buckets").alias("bucket")).distinct()
    sets = meet.groupBy("bucket").agg(F.sort_array(F.collect_set("block")).alias("b"))
    # the buckets of a large group hold the same blocks: each set of blocks is paired once
    sets = written(sets.select("b").distinct().withColumn("set", F.monotonically_increasing_id()), "sets-of-blocks")
    # a block of a set meets the set's blocks in chunks: the pairs of a large set are made by many tasks
    last = F.expr(f"(size(b) - 1) div {CHUNK}")
    chunks = sets.select(
        "set", F.posexplode(F.transform(F.sequence(F.lit(0), last.cast("int")), lambda c: F.slice("b", c * CHUNK + 1, CHUNK))).alias("chunk", "rights")
    )
    lefts = (
        sets.select("set", last.alias("last"), F.posexplode("b").alias("i", "left"))
        .repartition(partitions(reps.sparkSession), "left")
        .select("set", "left", F.explode(F.expr(f"sequence(cast(i div {CHUNK} as int), cast(last as int))")).alias("chunk"))
    )
    pairs = (
        lefts.join(chunks, ["set", "chunk"])
        .select("left", F.explode("rights").alias("right"))
        .filter("left <= right")
        .distinct()
    )
    return own.select("rep", "block"), pairs


def _sets(documents: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """Sorted distinct shingle hashes of the chosen representatives' texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            for begin, end in batches(texts):
                hashes, offsets = shingle_hashes(texts[begin:end], words)
                counts = np.diff(offsets)
                key = np.zeros(len(counts), np.uint64)
                have = np.flatnonzero(counts)
                place = (np.arange(len(hashes)) - np.repeat(offsets[:-1], counts)).astype(np.uint64)
                key[have] = np.add.reduceat(
                    mix(hashes + place * _U(0xD6E8FEB86659FD93)), offsets[:-1][have]
                )
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets, offsets[1:])]
                piece = part.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[piece.column(c) for c in ("rep", "block", "copies", "k1")],
                        pa.array(key.view(np.int64)),
                        pa.array(sets, pa.binary()),
                    ],
                    names=["rep", "block", "copies", "k1", "key", "hashes"],
                )

    texts = documents.select(*_row(), "text")

    def of(some: DataFrame) -> DataFrame:
        some = some.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
        found = texts.join(small(some), (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        return found.select("rep", "block", "copies", "k1", "text")

    found = of(chosen.filter("rows = 1"))
    repeated = chosen.filter("rows > 1")  # one of the equal rows is enough
    if repeated.limit(1).count():
        found = found.unionByName(of(repeated).distinct())
    return (
        found
        .mapInArrow(run, "rep long, block long, copies long, k1 long, key long, hashes binary")
        .filter("key = k1")  # another text of the same doc_id and hash is not the one that was sketched
        .drop("key", "k1")
    )


def _verify(threshold: float):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("rep")
        sides = group["side"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
        n = len(sets)
        size = np.array([len(x) for x in sets], np.float64)
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(n), size.astype(np.int64))
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first = np.concatenate([[True], every[1:] != every[:-1]])
        column = np.cumsum(first) - 1
        twice = np.bincount(column)[column] > 1  # only shared hashes count
        owner, column = owner[twice], column[twice]
        common = np.zeros((n, n))
        if len(column):
            column = np.unique(column, return_inverse=True)[1]
            width = max(1, (1 << 21) // n)
            cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                part = np.zeros((n, width), np.float32)
                part[owner[a:b], column[a:b] - k * width] = 1
                common += part @ part.T
        linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if (sides == 1).any():  # a pair of two blocks: pairs inside either are another task's
            linked &= sides[:, None] != sides[None, :]
        links = linked @ group["copies"].to_numpy()
        ids = group["rep"].to_numpy()
        root = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        while True:
            least = np.where(linked, root[None, :], n).min(1)
            nxt = np.minimum(root, least)
            if (nxt == root).all():
                break
            root = nxt
        out = pd.DataFrame({"rep": ids, "links": links, "root": np.sort(ids)[root]})
        return out[linked.any(1)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows are sorted by pair: each pair is compared when the next one begins."""
        held: list[pa.RecordBatch] = []
        now = None

        def compared() -> pa.RecordBatch:
            found = compare(pa.Table.from_batches(held).to_pandas())
            return pa.record_batch([pa.array(found[c].to_numpy(np.int64)) for c in found], names=list(found))

        for part in parts:
            pairs = part.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pairs)) + 1).tolist(), len(pairs)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin < end:
                    if held and pairs[begin] != now:
                        yield compared()
                        held = []
                    now = pairs[begin]
                    held.append(part.slice(begin, end - begin))
        if held:
            yield compared()

    return run


def _texts(
    documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS
) -> DataFrame:
    """A row for each text of a doc_id (equal word sequences are one, of rows without an id as well): marks
    (hashes of its texts), rows (its number), members (documents that it stands for), cluster (of texts that links lead
    to, null without words), class_id, copy_of, n_copies and n_links as in jaccard_join."""
    bands, rows = plan_bands(threshold, recall)
    marks = written(
        sketch(documents, bands, rows, words)
        .groupBy("doc_id", "k1", "k2")
        .agg(
            F.collect_set("mark").alias("marks"),
            F.count("*").alias("rows"),
            F.first("shingles").alias("shingles"),
            F.first("bands").alias("bands"),
        )
        .withColumn("members", F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(F.lit(1))),
        "sketch",
    )
    # all rows of a class have the same bands
    reps = written(
        marks.filter("shingles > 0")
        .groupBy("k1", "k2")
        .agg(
            F.min(F.struct("doc_id", F.array_min("marks").alias("mark"), "rows")).alias("row"),
            F.min("doc_id").alias("least"),
            F.sum("members").alias("copies"),
            F.first("shingles").alias("shingles"),
            F.first("bands").alias("bands"),
        )
        .withColumn("rep", F.monotonically_increasing_id()),
        "representatives",
    )
    own, pairs = _blocks(reps)
    chosen = written(own.join(reps.select("rep", "copies", "k1", "row.*"), "rep"), "candidates")
    sets = written(_sets(documents, chosen, words), "sets")
    n = partitions(documents.sparkSession)
    size = written(own.groupBy("block").count(), "block-sizes")
    left, right = (size.select(F.col("block").alias(c), F.col("count").alias(f"n_{c}")) for c in ("left", "right"))
    sized = pairs.join(left, "left").join(right, "right")
    placed = running(sized, [-(F.col("n_left") + F.col("n_right")), F.col("left"), F.col("right")], pair=F.lit(1).cast("long"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("left").alias("block")), F.struct(F.lit(1).alias("side"), F.col("right").alias("block"))
    )
    sides = F.when(F.col("left") == F.col("right"), F.slice(sides, 1, 1)).otherwise(sides)
    seats = placed.select("pair", F.pmod("pair", F.lit(n)).cast("int").alias("task"), F.inline(sides))
    found = written(
        sets.join(seats, "block")
        .select("task", "pair", "side", "rep", "copies", "hashes")
        .repartitionById(n, F.col("task"))
        .sortWithinPartitions("pair")
        .mapInArrow(_verify(threshold), "rep long, links long, root long"),
        "links",
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.filter("rep != root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    classes = (
        reps.select("k1", "k2", "rep", "least", "copies")
        .join(links, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("cluster", F.coalesce("root", "rep"))
    )
    classes = written(classes.drop("root"), "linked")
    # a cluster of one class has the class's least id
    several = written(
        roots.select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
        .join(reps.select("rep", "least"), "rep")
        .groupBy("cluster")
        .agg(F.min("least").alias("first")),
        "clusters",
    )
    classes = written(classes.join(several, "cluster", "left"), "classes")
    return (
        marks.select("doc_id", "k1", "k2", "marks", "rows", "members")
        .join(classes, ["k1", "k2"], "left")
        .select(
            "doc_id",
            "marks",
            "rows",
            "members",
            "cluster",
            F.coalesce("first", "least", "doc_id").alias("class_id"),
            F.coalesce("least", "doc_id").alias("copy_of"),
            F.coalesce("copies", F.lit(1)).alias("n_copies"),
            (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        )
    )


def jaccard_join(
    documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS
) -> DataFrame:
    """One row for each doc_id of documents (doc_id, text) and each row without one: class_id (least doc_id
    that links lead to), copy_of (least doc_id with the same words), n_copies (documents with the same
    words), n_links (documents whose similarity to it is at least the threshold, its copies included). Of a
    doc_id with several texts, n_copies and n_links are the sums over its texts, copy_of is the least."""
    texts = written(_texts(documents, threshold, recall, words), "texts")
    columns = ("doc_id", "class_id", "copy_of", "n_copies", "n_links")
    each = texts.withColumn("_", F.explode(F.expr("array_repeat(0, cast(members as int))"))).select(*columns)
    repeated = written(
        texts.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated"
    )
    if not repeated.limit(1).count():
        return each
    # the clusters of one document's texts lead to each other
    theirs = written(texts.join(small(repeated), "doc_id"), "several")
    meet = Window.partitionBy("doc_id")
    edges = (
        theirs.filter("cluster is not null")
        .select(F.min("cluster").over(meet).alias("u"), F.col("cluster").alias("v"))
        .filter("u != v")
    )
    joined = components(edges)
    nodes = texts.filter("cluster is not null").groupBy("cluster").agg(F.min("class_id").alias("first"))
    first = (
        joined.join(nodes, joined.node == nodes.cluster)
        .withColumn("first", F.min("first").over(Window.partitionBy("root")))
        .select("cluster", "first")
    )
    texts = texts.join(small(written(first, "first")), "cluster", "left").withColumn(
        "class_id", F.least("first", "class_id")
    )
    each = texts.withColumn("_", F.explode(F.expr("array_repeat(0, cast(members as int))"))).select(*columns)
    sums = (
        texts.join(small(repeated), "doc_id")
        .groupBy("doc_id")
        .agg(
            F.min("class_id").alias("class_id"),
            F.min("copy_of").alias("copy_of"),
            F.sum("n_copies").alias("n_copies"),
            F.sum("n_links").alias("n_links"),
        )
    )
    return each.join(small(repeated), "doc_id", "left_anti").unionByName(sums)


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each cluster of texts that links lead to: of its least doc_id (null is the last), and of
    that the text of least hash. Texts without words stay, once for each doc_id."""
    texts = written(_texts(documents), "texts")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.array_min("marks").alias("mark"))
    kept = texts.filter("cluster is not null").groupBy("cluster").agg(F.min(place).alias("kept"))
    kept = written(kept, "kept")
    # a row with words but not a cluster's first goes; a mark of several rows that stays, stays once
    marked = texts.join(kept, "cluster", "left").withColumn("mark", F.explode("marks"))
    stays = F.when(F.col("cluster").isNotNull(), F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("mark") == F.col("kept.mark"))).otherwise(
        F.col("doc_id").isNull() | (F.col("mark") == F.array_min("marks"))
    )
    once = stays & (F.col("rows") > 1) & (F.col("cluster").isNotNull() | F.col("doc_id").isNotNull())
    chosen = marked.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), stays.alias("stays"), once.alias("once"))
    gone = written(chosen.filter("not stays or once"), "gone")
    rows = documents.withColumn("_row_mark", F.xxhash64("text"))
    same = (F.col("_row_mark") == F.col("_mark")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    left = rows.join(small(gone), same, "left_anti")
    once = gone.filter("once")
    if once.limit(1).count():
        one = rows.join(small(once), same, "left_semi").groupBy("doc_id", "_row_mark").agg(F.min(F.struct(*documents.columns)).alias("row"))
        left = left.unionByName(one.select("row.*", "_row_mark"))
    return left.drop("_row_mark")
