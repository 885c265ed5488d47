"""Prefix trie of conversations, totals by subtree through message passing from the leaves.

A node is a distinct sequence of first turns. It is told by its depth and 128 bits that its turns' digests, each mixed
with its place, add up to by exclusive or, so that all prefixes of a conversation are one running window. Members are
counted by a grouped shuffle.

Every node is named by its smallest member and its depth, and the nodes named by one conversation are a path: its chain.
Messages run between chains: a chain that waits for no branch any more is complete, sends its subtree's totals
to the node that it hangs from and takes one off the counter of that node's chain; a round peels all chains that are
complete, until the root's chain is. So rounds grow with the nesting of branches and not with the number of turns. Sums
along chains then give each node its subtree's totals.

Defined cases: rows without a conv_id belong to no conversation; a null role or text is empty, a null turn comes first,
turns of one number are ordered by a digest of role and text; a conversation without turns after rebuilding is a member
of the root alone; rows that repeat are turns of their own; very long texts are digested whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, stored
from .even_join import even_join

NODE = ("depth", "h1", "h2")
#: Bytes of decimal ids of one node that a task joins before it hands them on.
CHUNK = 1 << 20
_NONE = hashlib.sha256().hexdigest()


def turns_in_order(table: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, d1, d2: digest of role and text, words of the text); texts go no further than this."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    rows = table.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", half(1).alias("d1"), half(17).alias("d2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "d1", "d2")
    return rows.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "d1", "d2", "words")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of conversation conv_id - conv_id % 20, h = crc32(conv_id) % 4, which may be fewer or none. convs: conv_id, base, h, and n of the base's turns (null: absent)."""
    taken = F.least(F.col("h"), F.coalesce("n", F.lit(0)))
    own = turns.join(convs.select("conv_id", "h", taken.alias("taken")), "conv_id").where("pos > h")
    heads = turns.where("conv_id % 20 = 0 and pos <= 3").withColumnRenamed("conv_id", "base")
    lent = convs.where("h > 0").select("conv_id", "base", "h").join(heads, "base").where("pos <= h")
    return own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).cast("int").alias("pos"), "d1", "d2", "words").unionByName(lent.select("conv_id", "pos", "d1", "d2", "words"))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, p1, p2: the parent's, words of the last turn, ends) of every prefix but the root."""
    mixed = {f"x{k}": F.xxhash64(F.lit(k), "d1", "d2", "pos") for k in (1, 2)}
    w = Window.partitionBy("conv_id").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns(mixed).select("conv_id", F.col("pos").alias("depth"), *(F.bit_xor(f"x{k}").over(run).alias(f"h{k}") for k in (1, 2)), "x1", "x2", "words", F.lead("pos").over(w).isNull().alias("ends"))
    return out.select("conv_id", *NODE, *(F.col(f"h{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)), "words", "ends")


def joined_ids(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(depth, h1, h2, ends_sha256) of (depth, h1, h2, conv_id): the digest of a node's ids in ascending order, joined by commas.

    Ranges of (node, id) are joined by independent tasks, also those of one large node; the digest then streams
    over a node's joined pieces in order and holds one piece at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*NODE, "first", "ids"]
        node, first, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), *(pa.array([x], pa.int64()) for x in (node[1], node[2], first)), pa.array([",".join(held).encode()], pa.binary())], names)

        for batch in batches:
            for *own, i in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
                if held and (own != node or size > chunk):
                    yield piece()
                    held, size = [], 0
                if not held:
                    node, first = own, i
                held.append(str(i))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
        node, told = None, None
        for batch in batches:
            done = []
            for *own, ids in zip(*(batch.column(c) for c in (*NODE, "ids")), strict=True):
                own = [x.as_py() for x in own]
                if own != node:
                    if told:
                        done.append((*node, told.hexdigest()))
                    node, told = own, hashlib.sha256()
                else:
                    told.update(b",")
                told.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), kinds)] if done else [pa.array([], t) for t in kinds], [*NODE, "ends_sha256"])
        if told:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, told.hexdigest()), kinds)], [*NODE, "ends_sha256"])

    dealt = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    parts = dealt.mapInArrow(pieces, "depth int, h1 long, h2 long, first long, ids binary")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth int, h1 long, h2 long, ends_sha256 string")


def peeled(chains: DataFrame) -> DataFrame:
    """(chain, leaves, saved) of each chain's whole subtree. chains: chain, parent (null: the root's), waits (branches that hang from it), leaves and saved of its own nodes.

    A round takes all chains that wait for nothing, and its messages are summed by receiver before they are joined.
    """
    pending, done = stored(chains, "chains"), []
    while True:
        ready = pending.where("waits = 0")
        done.append(ready.select("chain", "leaves", "saved"))
        if not pending.where("waits > 0").limit(1).count():
            return reduce(DataFrame.unionByName, done)
        sent = ready.groupBy(F.col("parent").alias("chain")).agg(F.count("*").alias("_n"), F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        less = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
        pending = stored(pending.where("waits > 0").join(sent, "chain", "left").select("chain", "parent", (F.col("waits") - F.coalesce("_n", F.lit(0))).alias("waits"), less("leaves", "_l"), less("saved", "_s")), "chains")


def prefix_trie(table: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    turns = stored(turns_in_order(table), "turns")
    sizes = stored(turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("n")), "conversations")
    told = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), crc_mod("conv_id", 4).cast("int").alias("h"))
    convs = told.join(sizes.withColumnRenamed("conv_id", "base"), "base", "left")
    every = stored(prefixes(rebuilt(turns, convs)), "prefixes")

    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(F.lit(0).alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("h1", "h2")), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    grouped = every.groupBy(*NODE).agg(*(F.min(c).alias(c) for c in ("p1", "p2", "conv_id")), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    chain = Window.partitionBy("conv_id").orderBy("depth")
    nodes = stored(grouped.unionByName(root).withColumns({"top": F.lag("depth").over(chain).isNull(), "last": F.lead("depth").over(chain).isNull()}), "nodes")

    # Where the first node of each chain hangs.
    key = F.struct(F.col("depth") - 1, "p1", "p2").cast("struct<depth:int,h1:bigint,h2:bigint>")
    tops = stored(nodes.where("top and depth > 0").select("conv_id", key.alias("above")), "tops")
    above = nodes.select(F.struct(*NODE).alias("above"), F.col("conv_id").alias("parent"), F.col("depth").alias("at"))
    hung = stored(even_join(tops, stored(above.join(tops.groupBy("above").agg(F.count("*").alias("n")), "above"), "parents"), "above", "n").drop("above"), "hung")

    branches = hung.groupBy("parent", "at").agg(F.count("*").alias("branches"))
    own = nodes.select("conv_id", "depth", "top", "last", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    on_node = lambda x: x.withColumnsRenamed({"parent": "conv_id", "at": "depth"})
    placed = own.join(on_node(branches), ["conv_id", "depth"], "left").na.fill(0, ["branches"])
    leaf = (F.col("last") & (F.col("branches") == 0)).cast("long")
    path = placed.groupBy(F.col("conv_id").alias("chain")).agg(F.sum("branches").alias("waits"), F.sum(leaf).alias("leaves"), F.sum("saved").alias("saved"))
    totals = peeled(path.join(hung.select(F.col("conv_id").alias("chain"), "parent"), "chain", "left").select("chain", "parent", "waits", "leaves", "saved"))

    arrived = hung.join(totals.withColumnRenamed("chain", "conv_id"), "conv_id").groupBy("parent", "at").agg(F.count("*").alias("branches"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
    met = own.join(on_node(arrived), ["conv_id", "depth"], "left").na.fill(0, ["branches", "leaves", "below"])
    down = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = met.select(
        "conv_id", "depth", "top", "n_convs", (F.col("branches") + (~F.col("last")).cast("long")).alias("n_children"), F.sum(F.col("leaves") + leaf).over(down).alias("n_leaves"), F.sum(F.col("saved") + F.col("below")).over(down).alias("saved_tokens")
    )
    named = nodes.select("conv_id", *NODE).join(joined_ids(_ends(every, sizes)), [*NODE], "left").select("conv_id", "depth", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
    parent: Column = F.when(F.col("top"), F.col("parent")).otherwise(F.col("conv_id"))
    return (
        summed.join(hung.select("conv_id", "parent"), "conv_id", "left")
        .join(named, ["conv_id", "depth"])
        .select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    )


def _ends(every: DataFrame, sizes: DataFrame) -> DataFrame:
    """The node where each conversation ends: the root where nothing is left of it."""
    ends = every.where("ends").select(*NODE, "conv_id")
    bare = sizes.select("conv_id").join(ends.select("conv_id"), "conv_id", "left_anti")
    return stored(ends.unionByName(bare.select(F.lit(0).alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("h1", "h2")), "conv_id")), "ends")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
