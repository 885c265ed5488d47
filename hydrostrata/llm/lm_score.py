"""Cross-entropy difference of two matched word bigram models.

A target model (documents labelled good) and a background model (all documents) share one vocabulary, all
lower-cased words of the corpus, plus marks for other words and for a text's start, and the same smoothing:
bigram shares interpolated with add-one unigram shares. A document's score is its mean per-token loss under the
target model less that under the background model; the lower, the more it is like the target.

Counts are exact and grow with the corpus: neither words nor bigrams are capped, and nothing but the size of the
texts comes to the driver. Words, contexts and bigrams have 56-bit hash keys, each kind its own:
of 10^11 distinct bigrams about one in a million shares its key with another. Documents are stored in
chunks of CHUNK bytes. A chunk sends its distinct keys with their counts under both models to hash parts, once
each, so a very common key costs its part one entry a chunk; parts add the counts and answer each chunk in the
order it sent, with its share of the sums over all words; chunks sum the losses of their documents' tokens.

Defined cases: texts without words (null, empty, blank) have no tokens, losses 0 and score 0; rows that repeat
are scored alike and each counted; labels that are null or contradict each other for a doc_id are not used;
without target documents both models agree only in smoothing and scores still are finite; very long texts are scored whole (a chunk of their own); ties need
no order; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix64, sliced, stored
from .quality_qda import clean_labels
from .run_index import narrow, pack, unpack

#: Bytes of text in a chunk at most (one text at least), and that one hash part is made for.
CHUNK, PART_BYTES = 12 << 20, 8 << 20
#: Bits of a key's hash; two more tell its kind.
KEY_BITS = 56
#: Share of the unigram model in the interpolation.
UNIGRAM = 0.4
_START = np.uint64(0x9E3779B97F4A7C15)
_WORD, _CONTEXT, _BIGRAM = (np.uint64(k) for k in range(3))


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in lower case (ASCII white space parts them), and the row of each."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
    flat = split.flatten()
    row = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), row[some.to_numpy(zero_copy_only=False)]


def pack_sorted(keys: np.ndarray, *counts: np.ndarray, sums: tuple[int, ...] = ()) -> bytes:
    """Differences of the keys, the counts and some sums; bytes of equal weight lie together, so that leading zeros compress away."""
    arrays = [narrow(a) for a in ([np.diff(keys, prepend=np.uint64(0))] if len(keys) else []) + list(counts)]
    return pack(np.array([len(counts[0]), *sums], np.int64), *(np.ascontiguousarray(a.view("u1").reshape(len(a), a.itemsize).T).ravel() for a in arrays), level=3)


def unpack_sorted(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums and the arrays."""
    head, *arrays = unpack(blob)
    n = int(head[0])
    return head[1:], [np.ascontiguousarray(a.reshape(-1, n).T).view(f"<u{len(a) // n}").ravel() if n else a for a in arrays]


class Chunk:
    """The tokens of some texts: row, word (cur), word before (prev) and distinct pair of each, and the keys of words, contexts and pairs in the order they are sent."""

    def __init__(self, z: bytes, n_parts: int):
        lens, data = unpack(z)
        data = zstandard.ZstdDecompressor().decompress(data.tobytes())
        offsets = np.concatenate([[0], np.cumsum(lens.astype(np.int64))])
        found, self.row = words(pa.Array.from_buffers(pa.large_string(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        coded = found.dictionary_encode()
        self.cur = coded.indices.to_numpy().astype(np.int64)
        known = coded.dictionary.cast(pa.large_binary()).to_pylist()
        self.n_words = len(known)
        prev = np.empty_like(self.cur)
        prev[1:] = self.cur[:-1]
        start = np.ones(len(prev), bool)
        start[1:] = self.row[1:] != self.row[:-1]
        prev[start] = self.n_words
        self.prev = prev
        pairs, self.pair = np.unique(prev * (self.n_words + 1) + self.cur, return_inverse=True)
        self.pair_prev, self.pair_cur = np.divmod(pairs, self.n_words + 1)
        h = np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, self.n_words), _START)
        both = mix64(mix64(h[self.pair_prev]) + h[self.pair_cur])
        key = np.concatenate([(x >> np.uint64(64 - KEY_BITS) << np.uint64(2)) | kind for x, kind in ((h[:-1], _WORD), (h, _CONTEXT), (both, _BIGRAM))])
        self.order = np.argsort(key)
        self.key = key[self.order]
        self.part = ((self.key >> np.uint64(KEY_BITS + 2 - 32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)  # ranges of keys

    def counts(self, tokens: np.ndarray | slice) -> np.ndarray:
        """Of the given tokens, in the order of the keys."""
        n = self.n_words
        own = [np.bincount(x[tokens], minlength=size) for x, size in ((self.cur, n), (self.prev, n + 1), (self.pair, len(self.pair_cur)))]
        return np.concatenate(own)[self.order]

    def losses(self, sent: np.ndarray, n_tokens: int, n_words: int) -> np.ndarray:
        """Per-token losses from the counts of one model in the order of the keys."""
        total = np.empty(len(sent))
        total[self.order] = sent
        uni, ctx, big = np.split(total, [self.n_words, 2 * self.n_words + 1])
        share = np.minimum(big / np.maximum(ctx[self.pair_prev], 1), 1.0)
        return -np.log(UNIGRAM * (uni[self.pair_cur] + 1.0) / (n_tokens + n_words + 2) + (1 - UNIGRAM) * share)[self.pair]


def in_chunks(docs: DataFrame, kind: str) -> DataFrame:
    """(chunk, ids, size, z): the doc_ids and compressed texts of up to CHUNK bytes of documents."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        far = zstandard.ZstdCompressionParameters.from_level(6, window_log=24, enable_ldm=True)  # texts are stored once and sent twice: matches over the whole chunk are worth their time
        for batch in batches:
            for part in sliced(batch, CHUNK):
                data = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
                lens = pc.binary_length(data).to_numpy()
                z = pack(narrow(lens), np.frombuffer(zstandard.ZstdCompressor(compression_params=far).compress(b"".join(data.to_pylist())), np.uint8))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([int(lens.sum())], pa.int64()), pa.array([z], pa.binary())], ["chunk", "ids", "size", "z"])
                number += 1

    return docs.select("doc_id", "text").mapInArrow(fn, f"chunk long, ids array<{kind}>, size long, z binary")


def send_counts(chunks: DataFrame, n_parts: int) -> DataFrame:
    """(chunk, part, blob) from (chunk, z, good): to every part sorted keys, if any, and their counts under both models; good: the places of the target documents."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, z, good in zip(*(batch.column(c) for c in ("chunk", "z", "good")), strict=True):
                own = Chunk(z.as_py(), n_parts)
                marked = np.zeros(int(own.row.max()) + 1 if len(own.row) else 0, bool)
                at = np.array(good.as_py() or [], np.int64)
                marked[at[at < len(marked)]] = True
                if not len(own.row):
                    continue
                counts = [own.counts(tokens) for tokens in (slice(None), marked[own.row])]
                cuts = np.searchsorted(own.part, np.arange(n_parts + 1))
                blobs = [pack_sorted(own.key[a:b], *(c[a:b] for c in counts)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                del own, counts
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * n_parts, pa.int64()), pa.array(range(n_parts), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "blob"])

    return chunks.select("chunk", "z", "good").mapInArrow(fn, "chunk long, part int, blob binary")


def add_counts(sent: DataFrame, n_parts: int) -> DataFrame:
    """(chunk, part, blob), with as many tasks as parts: for each chunk the totals of the keys it sent, with the part's distinct words and its tokens under both models."""

    def fn(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, found = [], []
        for batch in batches:
            numbers += batch.column("chunk").to_pylist()
            found += [unpack_sorted(b)[1] for b in batch.column("blob").to_pylist()]
        ends = np.cumsum([len(x[-1]) for x in found])
        found = [x for x in found if len(x[-1])]
        keys, at, totals = np.empty(0, np.uint64), np.empty(0, np.int64), [np.empty(0, np.int64)] * 2
        if found:
            keys, at = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in found]), return_inverse=True)
            totals = [np.bincount(at, np.concatenate([x[k] for x in found]), len(keys)).astype(np.int64) for k in (1, 2)]
        is_word = (keys & np.uint64(3)) == _WORD
        sums = (int(is_word.sum()), *(int(t[is_word].sum()) for t in totals))
        blobs = [pack_sorted(np.empty(0, np.uint64), *(t[at[a:b]] for t in totals), sums=sums) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([key[0].as_py()] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "blob"])

    return sent.repartition(n_parts, "part").groupBy("part").applyInArrow(fn, "chunk long, part int, blob binary")


def score_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row; target: the doc_ids (one row each) of the target corpus."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    chunks = stored(in_chunks(docs, kind), "lm_chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    rows = chunks.select("chunk", F.posexplode("ids").alias("at", "doc_id"))
    good = rows.join(target.select("doc_id").hint("merge"), "doc_id").groupBy("chunk").agg(F.collect_list("at").alias("good"))
    marked = chunks.select("chunk", "z").repartition(n_parts, "chunk").join(good.repartition(n_parts, "chunk").hint("merge"), "chunk", "left")  # a few chunks a task
    answers = add_counts(send_counts(marked, n_parts), n_parts)

    def fn(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, ids, own = {}, None, None
        for batch in batches:
            for p, blob, x in zip(*(batch.column(c) for c in ("part", "blob", "ids")), strict=True):
                if p.is_valid:
                    told[p.as_py()] = unpack_sorted(blob.as_py())
                else:
                    ids, own = x.values, Chunk(blob.as_py(), n_parts)
        n = np.bincount(own.row, minlength=len(ids))
        n_words, *n_tokens = sum(sums for sums, _ in told.values()).tolist() if told else (0, 0, 0)
        loss = []
        for k in (0, 1):
            sent = np.concatenate([told[p][1][k] for p in sorted(told)]) if told else np.zeros(len(own.key))
            loss.append(np.bincount(own.row, own.losses(sent, n_tokens[k], n_words), len(ids)) / np.maximum(n, 1))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(loss[1]), pa.array(loss[0]), pa.array(loss[1] - loss[0])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    texts = chunks.select("chunk", F.lit(None).cast("int").alias("part"), F.col("z").alias("blob"), "ids")
    told = answers.select("chunk", "part", "blob", F.lit(None).cast(chunks.schema["ids"].dataType).alias("ids"))
    return texts.unionByName(told).repartition(n_parts, "chunk").groupBy("chunk").applyInArrow(fn, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = clean_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality").where("y = 1")
    return score_documents(documents(spark, sf_dir), good)
