"""Byte-level BPE by replaying merges over the distinct words of the corpus.

Documents are written once, in blocks, as numbers of their words (pattern matches). Words are dealt by hash to parts,
a part for `part_bytes` of text, so that equal words of all blocks meet, are merged once, and their ids go back
to the blocks that asked. A word stands once a block at most, so none is hot.

The distinct words of a part are laid out as one array of symbols with links to their neighbours. An inverted index
from the rank of a pair to its positions drives the work: the lowest rank with positions is merged wherever it is its
word's leftmost pair of that rank, and only the pairs that touch a merged position are looked up anew. Words are
independent, so each word sees its merges in the order in which it alone would.

Defined cases: a null text is the empty text (no ids); every row gives a row, repeated or not; very
long texts are encoded whole; of equal ranks in a word the leftmost pair goes first; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, ragged, scratch, texts
from .pretoken import PieceEncoder

NONE = np.iinfo(np.int32).max
#: Tasks, and buckets of the stored blocks, are no more than Spark allows; beyond, a task takes several parts or blocks in turn.
MOST_TASKS = 100_000


class Ranks:
    """A vocabulary of byte strings by rank, and the rank of each pair of tokens whose concatenation is a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.size = max(self.rank.values()) + 1
        by_rank = [b""] * self.size
        for token, rank in self.rank.items():
            by_rank[rank] = token
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.token_lens = np.fromiter(map(len, by_rank), np.int64, self.size)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.values = np.fromiter((pairs[k] for k in self.keys.tolist()), np.int32, len(pairs))

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NONE where the concatenation is no token; b is -1 where a word ends."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((b >= 0) & (self.keys[at] == key), self.values[at], NONE).astype(np.int32)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = np.append(self.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))
        n = len(sym) - 1  # the last symbol stands for every word's end
        if not n:
            return [[] for _ in words]
        word = np.repeat(np.arange(len(words)), lens)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(lens[lens > 0]) - 1
        nxt[ends] = n
        prv[ends[:-1] + 1] = n
        prv[0] = n
        live = np.ones(n + 1, bool)
        pair = np.full(n + 1, NONE, np.int32)
        pair[:n] = self.pair_rank(sym[:n], sym[nxt[:n]])
        index: dict[int, list[np.ndarray]] = {}

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, group in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(group)

        heap: list[int] = []
        if len(start := np.flatnonzero(pair[:n] != NONE)):
            add(start, pair[start])
        while heap:
            r = heapq.heappop(heap)
            groups = index.pop(r)
            at = groups[0] if len(groups) == 1 else np.concatenate(groups)
            at = at[pair[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                w = word[at]
                lead = np.empty(len(at), bool)
                lead[0] = True
                np.not_equal(w[1:], w[:-1], out=lead[1:])
                if not lead.all():
                    index[r] = [at[~lead]]
                    heapq.heappush(heap, r)
                    at = at[lead]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = r
            nxt[at] = after
            prv[after] = at
            live[gone] = False
            pair[gone] = NONE
            before = prv[at]
            before = before[before != n]
            touched = np.concatenate([at, before])
            new = self.pair_rank(sym[touched], sym[nxt[touched]])
            pair[touched] = new
            some = new != NONE
            if some.any():
                add(touched[some], new[some])
        kept = np.flatnonzero(live[:n])
        counts = np.bincount(word[kept], minlength=len(words))
        cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
        ids = sym[kept].tolist()
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k, w in enumerate(words):  # a word that is a token is that token
            if (whole := self.rank.get(w)) is not None:
                out[k] = [whole]
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        lens = self.token_lens[ids]
        data = self.token_bytes[ragged(self.token_starts[ids], lens)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_STATE: dict[str, Ranks] = {}


def replayer(path: str) -> Ranks:
    """The vocabulary; one per worker."""
    if path not in _STATE:
        _STATE[path] = Ranks(path)
    return _STATE[path]


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes by place, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def widened(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(6).compress(b"".join([np.array([len(words), *map(len, words)], "<u4").tobytes(), *words]))


def unpacked_words(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (4 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)])).tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def numbered(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each match's word, most frequent first, and how many matches each text has."""
    met: list[str] = []

    def number(new: list[str]) -> list[list[int]]:
        first = len(met)
        met.extend(new)
        return [[k] for k in range(first, len(met))]

    found, counts = PieceEncoder(public_tokenizers.PATTERN, number).encode(texts)
    words = pa.array(met, pa.large_string()).dictionary_encode()
    found = words.indices.to_numpy()[found]
    order = np.argsort(-np.bincount(found, minlength=len(words.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return words.dictionary.take(pa.array(order)).cast(pa.large_binary()).to_pylist(), rank[found], counts


def word_blocks(docs: DataFrame, n_parts: int, block_bytes: int) -> DataFrame:
    """Blocks of documents as numbers of words, with the words of each block by the part that their hash names."""
    asked = pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, table in enumerate(blocks(batches, block_bytes)):
            words, found, counts = numbered(texts(table["text"]))
            part = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(n_parts)
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)  # neighbours compress well
            order = order[np.argsort(part[order], kind="stable")]  # answers come back in this order
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            cuts = np.searchsorted(part[order], np.arange(n_parts + 1, dtype=np.uint64)).tolist()
            order = order.tolist()
            own = [{"part": p, "words": packed_words([words[k] for k in order[a:b]])} for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", table["doc_id"].type), ("n", pa.int64())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.table([table["doc_id"], pa.array(counts, pa.int64())], ["doc_id", "n"]))
            columns = [pa.array([(TaskContext.get().partitionId() << 32) + k]), pa.array([own], asked), *(pa.array([x], pa.binary()) for x in (sink.getvalue(), squeezed(place), squeezed(found)))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "asked", "head", "place", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "block long, asked array<struct<part: int, words: binary>>, head binary, place binary, found binary")


def merged_parts(asked: DataFrame, path: str, chunk_bytes: int) -> DataFrame:
    """(block, part, lens, ids) for (block, part, words): a part's distinct words are merged once for all blocks, `chunk_bytes` of them at a time."""

    def answer(table: pa.Table) -> pa.Table:
        ranks = replayer(path)
        at: dict[bytes, int] = {}
        for data in table["words"]:
            for w in unpacked_words(data.as_py()):
                at.setdefault(w, len(at))
        words = list(at)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]), chunk_bytes), "right")).tolist()
        flat, lens = [], []
        for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True):
            own = ranks.replay(words[a:b])
            lens.append(np.fromiter(map(len, own), np.int64, len(own)))
            flat.append(np.fromiter(chain.from_iterable(own), np.uint32, int(lens[-1].sum())))
        flat, lens = np.concatenate(flat), np.concatenate(lens)
        starts = np.cumsum(lens) - lens
        all_lens, all_ids = [], []
        for data in table["words"]:
            idx = np.fromiter((at[w] for w in unpacked_words(data.as_py())), np.int64)
            all_lens.append(squeezed(lens[idx]))
            all_ids.append(squeezed(flat[ragged(starts[idx], lens[idx])]))
        return pa.table([table["block"], table["part"], pa.array(all_lens, pa.binary()), pa.array(all_ids, pa.binary())], ["block", "part", "lens", "ids"])

    return asked.groupBy("part").applyInArrow(answer, "block long, part int, lens binary, ids binary")


def _replayed(docs: DataFrame, path: str, block_bytes: int, part_bytes: int, schema: str, finish: Callable[[pa.Array, np.ndarray, np.ndarray], pa.Table]) -> DataFrame:
    """finish on the doc_ids of each block, their ids one after the other, and how many each has."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = -(-size // part_bytes) or 1
    spark = docs.sparkSession
    n_tasks = min(max(n_parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)
    # Buckets by block: the blocks stay where they are written and only the answers are shuffled to them.
    name = f"word_blocks_{uuid.uuid4().hex}"
    word_blocks(docs, n_parts, block_bytes).write.bucketBy(n_tasks, "block").option("path", scratch(spark, "words")).saveAsTable(name)
    rows = spark.table(name)
    asked = rows.select("block", F.explode("asked").alias("a")).select("block", "a.part", "a.words").repartition(n_tasks, "part")
    answers = merged_parts(asked, path, 1 << 20).repartition(n_tasks, "block")

    def gather(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        own = pa.ipc.open_stream(block["head"][0].as_py()).read_all()
        lens = np.concatenate([np.empty(0, np.int64), *(widened(x.as_py()) for x in answers["lens"])]).astype(np.int64)
        flat = np.concatenate([np.empty(0, np.uint32), *(widened(x.as_py()) for x in answers["ids"])])
        starts = np.cumsum(lens) - lens
        found = widened(block["place"][0].as_py())[widened(block["found"][0].as_py())]
        each = lens[found]
        ids = flat[ragged(starts[found], each)]
        counts = np.diff(np.concatenate([[0], np.cumsum(each)])[np.cumsum(own["n"].to_numpy())], prepend=0)
        return finish(pa.concat_arrays(own["doc_id"].chunks), ids, counts)

    return rows.select("block", "head", "place", "found").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(gather, schema)


def encode(docs: DataFrame, path: str, block_bytes: int = 6 << 20, part_bytes: int = 32 << 20) -> DataFrame:
    """doc_id and ids (int array) of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Table:
        rows = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), pa.array(ids.astype(np.int32)))
        return pa.table([doc_ids, rows.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _replayed(docs, path, block_bytes, part_bytes, f"doc_id {kind}, ids array<int>", finish)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded bytes."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = replayer(path)
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            data = ranks.decode(flat, np.diff(ids.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, data binary")


def round_trip(docs: DataFrame, path: str, block_bytes: int = 6 << 20, part_bytes: int = 32 << 20, text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text (and the decoded text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Table:
        data = replayer(path).decode(ids, counts)
        ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
        ids = ids.astype("<u4")
        columns = [doc_ids, pa.array(counts, pa.int64()), pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]), pa.array([hashlib.sha256(x).hexdigest() for x in data])]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if text:
            columns, names = [*columns, pa.array([x.decode() for x in data])], [*names, "decoded"]
        return pa.table(columns, names)

    return _replayed(docs, path, block_bytes, part_bytes, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * text, finish)


def op9_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
