"""A prefix trie of conversations, merged by families first.

A family is the conversations of one base id (FAMILY ids each). Conversations are cogrouped with the base's first turns,
rebuilt, and merged to the family's small trie; only its nodes are shuffled for the merge of all families. A node is
known by its depth and two 60-bit numbers: the exclusive or of a hash of each turn of its sequence with its place, so a
sequence's number follows from that of any piece of it.

A family's task is bounded: turns are numbered by a range sort that a long conversation spans, and cut into blocks of
BLOCK places; a block begins with the number of what is before it. Sums over subtrees need no walk from level to level:
a node's owner is its least member, whose nodes are the end of its path. A family adds up, in its own trie, what its
members own; what a member owns in later blocks is a sum by a window over its blocks. The families' sums of a node are
those of the subtree.

The ids that end at a node are joined in the family, then in chunks of families, and hashed in a stream by the task that
has the node: a checksum takes one pass, but its memory does not grow.

Defined results: rows without conv_id take no part. Turns of equal number are ordered by role, then text (both by
bytes; null as empty); equal rows are turns of their own. ``c - c % 100`` takes the sign of c, as in SQL. An empty table
gives no nodes, not even the root. Texts may be of any length: they are hashed whole before anything is grouped. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions, tune, written
from .ordering import running

FAMILY, SPAN = 100, 6  # ids of a family; a conversation takes fewer than SPAN turns of its base
BLOCK = 512  # places of a block
CHUNK = 64  # families whose ends are joined before the stream

KEY = ("depth", "key1", "key2")
_NODES = (
    "base long, block int, depth long, key1 long, key2 long, parent1 long, parent2 long, chars long, conv_id long, "
    "n long, ends string, onward array<long>"
)
_SUMS = "depth long, key1 long, key2 long, n_leaves long, saved_tokens long"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, before (turns before it, of all conversations), d1, d2 (digests of role and text), chars."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    part = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("long")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        part(1).alias("d1"), part(16).alias("d2"), F.length(text).cast("long").alias("chars"),
    )
    order = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    return running(rows, order, drop=("turn", "role", "text"), before=F.lit(1))


def _at(place) -> list:
    """The hashes of a turn at a place."""
    return [F.xxhash64(F.col(d), place.cast("long")).bitwiseAND((1 << 60) - 1) for d in ("d1", "d2")]


def _pieces(turns: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows of families, by base and block, and the first turns of bases.

    A conversation has an entry in each block, with the number of all turns before the block (key1, key2), how many
    turns it takes of its base and its rebuilt length; and its own turns that stay, at their rebuilt places.
    """
    c, base = F.col("conv_id"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    sizes = written(turns.groupBy("conv_id").agg(F.min("before").alias("first"), F.count("*").alias("n")), "sizes")
    bases = sizes.filter(c % FAMILY == 0).select(c.alias("base"), F.col("n").alias("base_n"))
    own = (F.crc32(c.cast("string").cast("binary")) % SPAN).alias("own")
    taken = F.least("own", F.coalesce("base_n", F.lit(0))).alias("taken")
    length = (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("own"))).alias("length")
    sizes = sizes.select("*", base, own).join(bases, "base", "left").select("*", taken).select("*", length)
    sizes = written(sizes, "sizes")
    k = (F.col("before") - F.col("first") + 1).alias("k")
    turns = turns.join(sizes, "conv_id").select("*", k)
    place = F.col("k") - F.col("own") + F.col("taken")
    kept = turns.filter(F.col("k") > F.col("own")).select("*", place.alias("place"))
    block = F.floor((F.col("place") - 1) / size).cast("int")
    none = F.lit(0).cast("long")
    form = "base", "block", "conv_id", "place", "key1", "key2", "chars", "taken", "length"
    kept = kept.select(
        "base", block.alias("block"), "conv_id", "place", *[x.alias(n) for x, n in zip(_at(F.col("place")), form[4:6])],
        "chars", none.alias("taken"), none.alias("length"),
    )
    kept = written(kept, "kept")
    heads = turns.filter((c % FAMILY == 0) & (F.col("k") < SPAN)).select(
        "base", F.lit(0).alias("block"), F.col("k").alias("place"),
        *[x.alias(n) for x, n in zip(_at(F.col("k")), form[4:6])], "chars",
    )
    heads = written(heads, "heads")
    entries = sizes.select("base", F.lit(0).alias("block"), "conv_id", none.alias("place"), none.alias("key1"), none.alias("key2"),
                           none.alias("chars"), "taken", "length")
    long = sizes.filter(F.col("length") > size)
    if long.limit(1).count():
        first = long.join(heads, "base").filter(F.col("place") <= F.col("taken")).select("base", "conv_id", "block", "key1", "key2")
        rows = kept.join(long.select("conv_id"), "conv_id", "left_semi").select(*first.columns).unionByName(first)
        xors = [F.expr(f"bit_xor({k})").alias(k) for k in ("key1", "key2")]
        rows = rows.groupBy("base", "conv_id", "block").agg(*xors)
        rows = long.select("base", "conv_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))).alias("block")).join(
            rows, ["base", "conv_id", "block"], "left"
        )
        before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
        more = rows.select(
            "base", "block", "conv_id", (F.col("block").cast("long") * size).alias("place"),
            *[F.coalesce(F.expr(f"bit_xor({k})").over(before), none).alias(k) for k in ("key1", "key2")], none.alias("chars"), none.alias("taken"),
        ).filter(F.col("block") > 0).join(long.select("conv_id", "length"), "conv_id")
        entries = entries.unionByName(more.select(*form))
    return kept.unionByName(entries), heads


def _family(rows: pd.DataFrame, heads: pd.DataFrame, size: int) -> pd.DataFrame:
    """The nodes of a family's trie in one block of so many places, each with its least member, members, and those that end there or go on
    to the next block."""
    names = [x.split()[0] for x in _NODES.split(", ")]
    if not len(rows):
        return pd.DataFrame([], columns=names)
    base, block = rows["base"].iat[0], rows["block"].iat[0]
    start = int(block) * size
    entry = rows[rows["place"] == start]
    if len(heads):
        heads = heads.sort_values("place")
        n = np.minimum(entry["taken"].to_numpy(), len(heads))
        which = np.concatenate([np.arange(k) for k in n.tolist()] or [np.zeros(0, np.int64)]).astype(np.int64)
        taken = heads.iloc[which].assign(conv_id=np.repeat(entry["conv_id"].to_numpy(), n))
        rows = pd.concat([rows, taken[["conv_id", "place", "key1", "key2", "chars"]]], ignore_index=True)
    rows = rows.sort_values(["conv_id", "place"], ignore_index=True)
    first = (rows["place"] == start).to_numpy()
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(rows)))
    frame = {"depth": rows["place"].to_numpy(), "chars": rows["chars"].to_numpy(), "conv_id": rows["conv_id"].to_numpy()}
    for k in (1, 2):
        whole = np.bitwise_xor.accumulate(rows[f"key{k}"].to_numpy())
        whole ^= np.repeat(np.append(0, whole)[at], counts)
        frame |= {f"key{k}": whole, f"parent{k}": np.append(0, whole[:-1])}
    length = np.repeat(rows["length"].to_numpy()[at], counts).astype(np.int64)
    frame["ends"] = length == frame["depth"]
    frame["onward"] = (frame["depth"] == start + size) & (length > frame["depth"])
    paths = pd.DataFrame(frame)[~first | (start == 0)]
    groups = paths.groupby(list(KEY), sort=False)
    nodes = groups.agg(parent1=("parent1", "first"), parent2=("parent2", "first"), chars=("chars", "first"), conv_id=("conv_id", "min"), n=("conv_id", "size"))

    def listed(flag: str, join) -> pd.Series:
        return paths[paths[flag]].groupby(list(KEY))["conv_id"].agg(lambda ids: join(sorted(ids.tolist())))

    nodes["ends"] = listed("ends", lambda ids: ",".join(map(str, ids))).reindex(nodes.index).astype(object)
    nodes["onward"] = listed("onward", list).reindex(nodes.index).astype(object)
    nodes[["ends", "onward"]] = nodes[["ends", "onward"]].where(nodes[["ends", "onward"]].notna(), None)
    return nodes.reset_index().assign(base=base, block=block)[names]


def _subtrees(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of leaves and saved_tokens over the subtrees within a family's block."""
    rows = rows.sort_values("depth", ignore_index=True)
    depth = rows["depth"].to_numpy()
    place = {key: k for k, key in enumerate(zip(depth.tolist(), rows["key1"].tolist(), rows["key2"].tolist()))}
    above = zip((depth - 1).tolist(), rows["parent1"].tolist(), rows["parent2"].tolist())
    parent = np.array([place.get(key, -1) for key in above], np.int64)
    sums = rows[["leaves", "saved"]].to_numpy(np.int64)
    ends = np.append(np.flatnonzero(np.diff(depth)) + 1, len(depth))
    for begin, end in list(zip(np.append(0, ends[:-1]), ends))[::-1]:
        some = np.arange(begin, end)[parent[begin:end] >= 0]
        np.add.at(sums, parent[some], sums[some])
    return rows[list(KEY)].assign(n_leaves=sums[:, 0], saved_tokens=sums[:, 1])


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each node, comma-joined; rows are sorted by node."""

    def made(found: list) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.string()
        columns = zip(*[(*key, digest.hexdigest()) for key, digest in found]) if found else ([],) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*KEY, "ends_sha256"])

    now, digest = None, None
    for batch in batches:
        done = []
        for *key, text in zip(*(batch[c].to_pylist() for c in (*KEY, "text"))):
            if key == now:
                digest.update(b"," + text.encode())
                continue
            if now is not None:
                done.append((now, digest))
            now, digest = key, hashlib.sha256(text.encode())
        yield made(done)
    if now is not None:
        yield made([(now, digest)])


def _ends(families: DataFrame) -> DataFrame:
    chunks = (
        families.filter(F.col("ends").isNotNull())
        .groupBy(*KEY, F.floor(F.col("base") / (FAMILY * CHUNK)).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("base", "ends"))).alias("some"))
        .select(*KEY, "chunk", F.array_join(F.col("some")["ends"], ",").alias("text"))
    )
    dealt = chunks.repartition(partitions(families.sparkSession), *KEY).sortWithinPartitions(*KEY, "chunk")
    return dealt.select(*KEY, "text").mapInArrow(_checksums, "depth long, key1 long, key2 long, ends_sha256 string")


def _later(rows: DataFrame) -> DataFrame:
    """What members own in later blocks, at the nodes from which they go on: base, block, node, more_leaves, more_saved."""
    owned = rows.filter((F.col("block") > 0) & F.col("owns")).select(
        "conv_id", "block", "leaves", "saved", *[F.lit(None).cast("long").alias(c) for c in ("base", *KEY)]
    )
    goes = rows.filter(F.col("onward").isNotNull()).select(
        F.explode("onward").alias("conv_id"), "block", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "base", *KEY
    )
    sums = owned.groupBy("conv_id", "block", "base", *KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    later = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rangeBetween(Window.unboundedPreceding, -1)
    every = sums.unionByName(goes).withColumns({f"more_{c}": F.coalesce(F.sum(c).over(later), F.lit(0)) for c in ("leaves", "saved")})
    return every.filter(F.col("base").isNotNull()).groupBy("base", "block", *KEY).agg(
        F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved")
    )


def trie(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row a node (tasks take blocks of ``size`` places): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    tune(conversations.sparkSession)
    rows, heads = _pieces(turns_of(conversations), size)

    def merged(rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        return _family(rows, heads, size)

    families = rows.groupBy("base", "block").cogroup(heads.groupBy("base", "block")).applyInPandas(merged, _NODES)
    families = written(families, "families")
    nodes = families.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
        *[F.max(c).alias(c) for c in ("parent1", "parent2", "chars")],
    )
    nodes = written(nodes, "nodes")
    below = nodes.filter(F.col("depth") > 0).groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent1").alias("key1"), F.col("parent2").alias("key2")
    ).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(below, list(KEY), "left").na.fill(0, ["n_children"]), "nodes")
    whole = nodes.select(*KEY, F.col("conv_id").alias("owner"), "n_convs", "n_children")
    owns, zero = F.col("conv_id") == F.col("owner"), F.lit(0).cast("long")
    parts = families.join(whole, list(KEY)).select(
        "base", "block", *KEY, "parent1", "parent2", "conv_id", "onward", owns.alias("owns"),
        F.when(owns & (F.col("n_children") == 0), F.lit(1).cast("long")).otherwise(zero).alias("leaves"),
        F.when(owns, (F.col("n_convs") - 1) * F.col("chars")).otherwise(zero).alias("saved"),
    )
    if families.filter(F.col("onward").isNotNull()).limit(1).count():
        parts = written(parts, "parts")
        parts = parts.join(_later(parts), ["base", "block", *KEY], "left").withColumns(
            {c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("leaves", "saved")}
        )
    parts = parts.select("base", "block", *KEY, "parent1", "parent2", "leaves", "saved")
    sums = parts.groupBy("base", "block").applyInPandas(_subtrees, _SUMS).groupBy(*KEY).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        nodes.join(sums, list(KEY)).join(_ends(families), list(KEY), "left").join(above, ["depth", "parent1", "parent2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
