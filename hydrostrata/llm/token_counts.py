"""Token counts through a cache by digest: only texts whose count isn't stored yet are encoded, each once.

A text's key is the digest of its normalised content; a tokenizer's is the digest of its file and of the library's
version. The cache is a table of (key, n_tokens) files below a folder for each tokenizer; a run joins the distinct keys
of its documents to it, encodes one text for each key that is missing and appends these counts as a batch of files.
Runs that append at the same time may store a key twice, with one count.

Normalised content: for a tokenizer that drops white space and lowers letters, runs of ASCII white space count as one
space, and ASCII texts are lowered (other texts are not: composing marks comes before lowering, and which marks
compose depends on the case). Texts that hold an added token in any case are taken as they are, and so are all texts of
other tokenizers. Texts of one key have one count.

A miss is encoded as its distinct words: white space is dropped, nothing that the tokenizer matches reaches over a
space, so that a text's count is the sum of its words' counts. Words are encoded by the library itself.

Defined cases: a null text is the empty text, 0 tokens and 0 bytes; null and repeated doc_ids are rows like others;
very long texts are counted whole; equal texts, also a third of all rows, are encoded once; other columns are
ignored; an empty table gives an empty result and appends nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, scratch, sliced, stored
from .even_join import even_join

LIMIT = 2048
#: Bytes of text for each task that encodes, where the shuffle partitions are too few for that.
PART_BYTES = 128 << 20
#: Words whose counts a worker keeps. Results do not depend on it.
MAX_WORDS = 300_000
_COUNTERS: dict[str, TextCounter] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\n" + f.read()).hexdigest()


def _drops_space(told: dict) -> bool:
    """Whether a tokenizers file lowers letters and drops white space between the matches of its pattern."""
    steps = (told.get("normalizer") or {}).get("normalizers", [])
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    space = any(s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
    lowers = bool(steps) and steps[-1]["type"] == "Lowercase" and {s["type"] for s in steps} <= {"NFC", "Replace", "Lowercase"}
    dropped = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and cuts[0]["pattern"]["Regex"].endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    plain = not any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in told["added_tokens"])
    return space and lowers and dropped and plain and told.get("post_processor") is None


def content_key(text: Column, path: str) -> Column:
    """Digest of the normalised content of a text that is not null."""
    content = text
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if _drops_space(told):
            spaced = F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]{2,}|[\x09-\x0D]", " "))  # single spaces stay untouched
            ascii_only = F.length(spaced) == F.octet_length(spaced)
            quoted = reduce(Column.__or__, (F.contains(F.lower(text), F.lit(a["content"].lower())) for a in told["added_tokens"]), F.lit(False))
            content = F.when(quoted, F.concat(F.lit("quoted "), text)).when(ascii_only, F.lower(spaced)).otherwise(spaced)
    return F.unhex(F.sha2(content.cast("binary"), 256))


class TextCounter:
    """Token counts of many texts."""

    def __init__(self, path: str):
        self.words = False
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                self.words = _drops_space(json.load(f))
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.library: Callable[[list[str]], list[int]] = lambda many: [len(e) for e in library.encode_batch_fast(many, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda many: [len(x) for x in model.encode(many, num_threads=1)]
        self.known, self.counts = pa.array([], pa.large_string()), np.empty(0, np.int64)

    def count(self, many: list[str]) -> np.ndarray:
        if not self.words:
            return np.array(self.library(many), np.int64)
        split = pc.split_pattern(pa.array(many, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        own = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(own < 0)
        counts = np.empty(len(own), np.int64)
        counts[own >= 0] = self.counts[own[own >= 0]]
        fresh = coded.dictionary.take(pa.array(new))
        counts[new] = self.library(fresh.to_pylist())
        if len(self.known) < MAX_WORDS:
            short = np.flatnonzero(pc.less_equal(pc.binary_length(fresh), 40).to_numpy(zero_copy_only=False))
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(short))])
            self.counts = np.concatenate([self.counts, counts[new[short]]])
        ends = np.concatenate([[0], np.cumsum(counts[coded.indices.to_numpy()])])
        return np.diff(ends[split.offsets.to_numpy()])


def text_counter(path: str) -> TextCounter:
    """One per worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TextCounter(path)
    return _COUNTERS[path]


def _folder(cache: str, version: str) -> str:
    return f"{cache.rstrip('/')}/tokenizer={version}"


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(key, n_tokens) stored for a tokenizer, one row a key; none before the first append."""
    try:
        rows = spark.read.schema("key binary, n_tokens long").parquet(f"{_folder(cache, version)}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key binary, n_tokens long")
    return rows.groupBy("key").agg(F.min("n_tokens").alias("n_tokens"))


def distinct_texts(rows: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """(key, z): each key of a block of rows once, with its text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for table in blocks(batches, block_bytes):
            keys = table["key"].to_pylist()
            first = list({k: i for i, k in reversed(list(enumerate(keys)))}.values())
            out = [pack((x or "").encode()) for x in table["text"].take(pa.array(first)).to_pylist()]
            yield from sliced(pa.RecordBatch.from_arrays([pa.array([keys[i] for i in first], pa.binary()), pa.array(out, pa.binary())], ["key", "z"]), 4 << 20)

    return rows.select("key", "text").mapInArrow(run, "key binary, z binary")


def encoded_counts(misses: DataFrame, path: str, block_bytes: int = 4 << 20) -> DataFrame:
    """(key, n_tokens) of (key, z); a key that stands in a row before, as all rows of a key come to one task and in order, isn't encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, last = text_counter(path), None
        for table in blocks(batches, 2 << 20):
            unpack = zstandard.ZstdDecompressor().decompress
            keys, held, size = [], [], 0
            for k, z in zip(table["key"].to_pylist(), table["z"].to_pylist(), strict=True):
                if k == last:
                    continue
                last = k
                keys.append(k)
                held.append(unpack(z).decode())
                size += len(held[-1])
                if size > block_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counter.count(held))], ["key", "n_tokens"])
                    keys, held, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counter.count(held))], ["key", "n_tokens"])

    return misses.mapInArrow(run, "key binary, n_tokens long")


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; the cache is a folder that lasts, of which only missing counts are made and to which they are appended."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("key", content_key(F.col("text"), path))
    rows = stored(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key"), "token_keys")
    asked = rows.groupBy("key").agg(F.count("*").alias("n"))
    looked = stored(asked.join(cached_counts(spark, cache, version), "key", "left"), "token_lookup")
    missing = looked.where("n_tokens is null").select("key", "n")
    counts = looked.where("n_tokens is not null")
    if missing.limit(1).count():
        batch = f"{_folder(cache, version)}/batch={uuid.uuid4().hex}"
        size = rows.agg(F.sum("n_bytes")).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
        wanted = missing.select("key").repartition(parts, "key").hint("merge")
        found = distinct_texts(keyed).repartition(parts, "key").join(wanted, "key", "left_semi").sortWithinPartitions("key")
        encoded_counts(found, path).write.parquet(batch)
        made = spark.read.schema("key binary, n_tokens long").parquet(batch).groupBy("key").agg(F.min("n_tokens").alias("n_tokens"))
        counts = counts.unionByName(missing.join(made, "key"))
    out = even_join(rows, stored(counts, "token_counts"), "key", "n")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of the query begins empty, so that its cost does not depend on runs before."""
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "token_count_cache"))
