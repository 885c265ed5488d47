"""Near-duplicates by min-max hashing.

Each permutation of the word shingles gives two signature values, its minimum and its maximum, so a signature
costs half the hash evaluations of plain MinHash. Values are banded; texts with a band in common are
candidates. Candidates are confirmed on their full shingle sets and linked, and documents are labelled by
connected components.

Nodes of the graph are distinct shingle sets: texts with equal sets are one class, and a doc_id whose rows have
several sets links these. Each bucket's least member is held against the others (a star, linear in the bucket,
salted where the bucket is large), and confirmed links join components. Only buckets that still hold several
components go on, buckets with the same members once: there, members are compared across components inside groups
of bounded members and shingles that give out joining links alone, never pairs. With BANDS bands of ROWS values a
link of similarity 0.8 is missed with probability (1 - 0.8**6)**40 = 5e-6.

Defined cases: null, empty and white-space texts have empty sets and are linked with nothing; rows that share a
doc_id share a component, whatever their texts; ties are resolved by the least doc_id; a null doc_id is its own
(null) component; very long texts are taken whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, mix64, stored, texts
from .graph import components

BANDS, ROWS = 40, 6
#: Members, and shingles beside those of one text, of a bucket that one group holds at most twice.
GROUP, GROUP_SHINGLES = 3000, 2_000_000
#: Pairs of a star that one task holds.
STAR = 500
PERMUTATIONS = BANDS * ROWS // 2
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_P = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)], np.uint64)


class _Words(dict):
    """Word hashes; forgets beyond a fixed size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of k words (the whole sequence if shorter)."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    size = min(k, n)
    h = np.full(n - size + 1, np.uint64(size), np.uint64)
    for j in range(size):
        h += w[j : j + len(h)] * _P[j]
    return np.unique(mix64(h))


def bands(found: np.ndarray) -> np.ndarray:
    """Band keys of a set: minimum and maximum under each permutation, banded."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for a in range(0, len(x), 8192):
        v = x[None, a : a + 8192] * _A[:, None] + _B[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    sig = np.stack([low, high], axis=1).astype(np.uint64).reshape(BANDS, ROWS)
    return mix64((sig * _P[1 : ROWS + 1]).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (of the full set), band keys and compressed text (null where the set is empty) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, flat, ends, z = [], [], [], [0], []
        pressed = zstandard.ZstdCompressor(level=1)
        for text in texts(batch.column("text")):
            found = shingles(text, k)
            sizes.append(len(found))
            keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            if len(found):
                flat.append(bands(found))
            z.append(pressed.compress(text.encode()) if len(found) else None)
            ends.append(ends[-1] + (BANDS if len(found) else 0))
        keyed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), keyed, pa.array(z, pa.binary())], ["doc_id", "n_shingles", "set_key", "bands", "z"])

    return map_batches(docs.select("doc_id", "text"), fn, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>, z binary")


def confirmed(pairs: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b, n: members of the largest bucket they share), those with 100 * intersection >= percent * union of their full sets; held: node and compressed text."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR).cast("long")))
    first = dealt.select("a", "salt").distinct().join(held.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    one = dealt.join(held.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    both = one.join(first, ["a", "salt"]).select("a", "b", "za", "zb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, last, first = zstandard.ZstdDecompressor(), None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, za, zb in zip(batch.column("a").to_pylist(), batch.column("za"), batch.column("zb"), strict=True):
                if a != last:
                    last, first = a, shingles(z.decompress(za.as_py()).decode(), k)
                second = shingles(z.decompress(zb.as_py()).decode(), k)
                common = len(np.intersect1d(first, second, assume_unique=True))
                keep.append(100 * common >= percent * (len(first) + len(second) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def linked_inside(mixed: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components inside each bucket (band, node, component, _n: members, _w: shingles), on full sets.

    A bucket is one Arrow group; one of more than GROUP members or GROUP_SHINGLES shingles is dealt into blocks,
    and each pair of blocks is a group, so no group is larger than two blocks. Inside, each member outside the
    largest component is held against all members, and of the links found only those that join components are
    given out.
    """
    n_blocks = F.ceil(F.greatest(F.col("_n") / GROUP, F.col("_w") / GROUP_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    dealt = mixed.withColumns({"_b": own, "_c": F.explode(F.sequence(F.lit(0), n_blocks - 1))})
    dealt = dealt.select("band", "node", "component", F.least("_b", "_c").alias("i"), F.greatest("_b", "_c").alias("j"))
    rows = dealt.join(held, "node")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy().copy()
        sets = [shingles(z.decompress(x).decode(), k) for x in table.column("z").to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        ends = np.cumsum(size)
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(int(flat.max()) + 1, np.int32)
        names, counts = np.unique(component, return_counts=True)
        out = []
        for p in np.flatnonzero(component != names[counts.argmax()]).tolist():
            mine = flat[ends[p] - size[p] : ends[p]]
            mark[mine] = 1
            common = np.add.reduceat(mark[flat], ends - size)
            mark[mine] = 0
            hit = (100 * common >= percent * (size + size[p] - common)) & (component != component[p])
            for q in np.flatnonzero(hit).tolist():
                if component[q] != component[p]:
                    out.append((int(node[p]), int(node[q])))
                    component[component == component[q]] = component[p]
        return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})

    return rows.groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the least doc_id of its component) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(sketches(docs, k).withColumn("row", F.monotonically_increasing_id()), "sketch")
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    # A class is named by the least of its rows, its node.
    classes = stored(some.groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")), "classes")
    nodes = sketch.select(F.col("row").alias("node"), "n_shingles", "bands").join(classes.select("node"), "node").select("node", "n_shingles", F.explode("bands").alias("band"))
    size = F.struct("node", "n_shingles")
    buckets = nodes.groupBy("band").agg(F.min(size).alias("p"), F.count("*").alias("n")).where("n > 1").select("band", "n", F.col("p.node").alias("node2"), F.col("p.n_shingles").alias("n2"))
    shared = stored(nodes.join(buckets, "band"), "buckets")
    held = stored(sketch.select(F.col("row").alias("node"), "z").join(shared.select("node").distinct(), "node"), "candidates")
    near = f"100 * least(n_shingles, n2) >= {percent} * greatest(n_shingles, n2)"
    pairs = shared.where("node <> node2").where(near).groupBy(F.col("node2").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n"))
    links = stored(confirmed(pairs, held, k, percent), "links")
    # A doc_id with several sets links them.
    owned = some.join(classes, "set_key").select("doc_id", "node").distinct()
    several = owned.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_z")).where("a <> _z").select("doc_id", "a")
    links = links.unionByName(stored(owned.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b")), "links"))
    found = stored(components(links), "components")
    # Buckets that are not connected yet, one of those with the same members.
    part = shared.select("band", "node", "n_shingles").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    states = part.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("_n"), F.sum("n_shingles").alias("_w"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y"))
    open_ = states.where("_lo <> _hi").groupBy("_n", "_w", "_x", "_y").agg(F.min("band").alias("band")).select("band", "_n", "_w")
    mixed = stored(part.join(open_, "band").select("band", "node", "component", "_n", "_w"), "mixed")
    links = links.unionByName(stored(linked_inside(mixed, held, k, percent), "links"))
    found = stored(components(links), "components")
    named = classes.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = named.join(least, "component").select("set_key", "component_id")
    out = sketch.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").cast(kind), "n_shingles", component.cast(kind).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4, percent=80)
