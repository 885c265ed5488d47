"""Sharding by fixed virtual slots.

Every record is hashed into one of a few thousand virtual slots. The bytes of each slot are summed, and a
versioned slot-to-shard map, edited when rebalancing, says which shard a slot lives on. Records never move
on their own: only slots do.

Defined cases: a null text has no bytes (size 1, checksum 0); a null doc_id is hashed by its checksum and
size; rows that repeat a doc_id share its slot and each get a position, in the order
of their checksums; ties between shards go to the lower one; very long texts count with all their bytes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, scratch, stored

N_SLOTS = 4096


@dataclass
class SlotMap:
    """Slot-to-shard map with its history; version 0 deals slots out in turn. Its size is n_slots, whatever the corpus."""

    n_slots: int
    n_shards: int
    versions: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.versions:
            self.versions = [[s % self.n_shards for s in range(self.n_slots)]]

    @property
    def version(self) -> int:
        return len(self.versions) - 1

    @property
    def shards(self) -> list[int]:
        return self.versions[-1]

    def edit(self, moves: dict[int, int]) -> None:
        """A new version in which the given slots have moved."""
        new = list(self.shards)
        for slot, shard in moves.items():
            new[slot] = shard
        self.versions.append(new)

    def rebalance(self, slot_bytes: dict[int, int]) -> int:
        """Move or swap slots between the fullest and another shard until no such edit evens the sizes (at most 64 edits a slot); returns slots moved."""
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(self.shards):
            if slot_bytes.get(slot, 0) > 0:
                held[shard].append((slot_bytes[slot], slot))
        for own in held:
            own.sort()
        load = [sum(b for b, _ in own) for own in held]
        moves: dict[int, int] = {}

        def put(item: tuple[int, int], a: int, b: int) -> None:
            held[a].remove(item)
            bisect.insort(held[b], item)
            load[a] -= item[0]
            load[b] += item[0]
            moves[item[1]] = b

        for _ in range(64 * self.n_slots):
            a = max(range(self.n_shards), key=load.__getitem__)
            for b in sorted(range(self.n_shards), key=load.__getitem__):
                gap = load[a] - load[b]
                if a == b or gap <= 1:
                    continue
                # A move of x bytes leaves a gap of |gap - 2x|; a swap of x for y one of |gap - 2(x - y)|.
                k = bisect.bisect_left(held[a], (gap / 2, -1))
                best = min(((abs(gap - 2 * x[0]), x, None) for x in held[a][max(0, k - 1) : k + 1]), default=(gap, None, None))
                if best[0] > gap // 64:
                    for y in held[b]:
                        k = bisect.bisect_left(held[a], (gap / 2 + y[0], -1))
                        for x in held[a][max(0, k - 1) : k + 1]:
                            if (left := abs(gap - 2 * (x[0] - y[0]))) < best[0]:
                                best = (left, x, y)
                if best[1] is not None and best[0] < gap:
                    put(best[1], a, b)
                    if best[2] is not None:
                        put(best[2], b, a)
                    break
            else:
                break
        before = self.shards
        moves = {s: t for s, t in moves.items() if before[s] != t}
        self.edit(moves)
        return len(moves)

    def grow(self) -> None:
        """One more shard, which takes an even share of slots from each of the others; no other slot moves."""
        new, moves = self.n_shards, {}
        counts = [0] * new
        for slot, shard in enumerate(self.shards):
            counts[shard] += 1
            if counts[shard] % (new + 1) == 0:
                moves[slot] = new
        self.n_shards += 1
        self.edit(moves)

    def write(self, spark: SparkSession, path: str) -> None:
        """All versions as a Parquet table (version, slot, shard)."""
        rows = [(v, s, t) for v, shards in enumerate(self.versions) for s, t in enumerate(shards)]
        spark.createDataFrame(rows, "version int, slot int, shard int").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> "SlotMap":
        rows = spark.read.parquet(path).orderBy("version", "slot").collect()
        versions: list[list[int]] = []
        for v, _, shard in rows:
            if v == len(versions):
                versions.append([])
            versions[v].append(shard)
        return SlotMap(len(versions[0]), max(max(v) for v in versions) + 1, versions)


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long"))
    return docs.select(F.col("doc_id"), size.alias("size"), crc.alias("text_crc32")).withColumn(
        "virtual_slot",
        F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id")), F.lit(n_slots)).cast("int"),
    )


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Shards of nearly equal bytes; `slot` numbers each shard's rows from 0 without gaps. The map is stored at map_path."""
    spark = docs.sparkSession
    rows = stored(slotted(docs, n_slots), "slotted")
    totals = {r["virtual_slot"]: (r["b"], r["n"]) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    slots = SlotMap(n_slots, n_shards)
    slots.rebalance({s: b for s, (b, _) in totals.items()})
    slots.write(spark, map_path or scratch(spark, "slot_map"))
    first, at = [0] * n_shards, []
    for slot, shard in enumerate(slots.shards):
        at.append((slot, shard, first[shard]))
        first[shard] += totals.get(slot, (0, 0))[1]
    schema = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("_first", T.LongType())])
    placed = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")))
    return placed.join(F.broadcast(spark.createDataFrame(at, schema)), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slots.version).alias("map_version"),
    )


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir))
