"""Token ids in ORC: stripes of run-length encoded integers with row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded inside each partition, and written as ORC files
whose stripes a reader takes in parallel. Statistics and Bloom filters on doc_id prune files, stripes and row
groups when single documents are looked up.

Ids are those of the library's Tokenizer.encode(text, add_special_tokens=False): an added token that a text quotes
is one id.

Defined cases: a null text is the empty text (its only id is the end id); a null doc_id sorts first; rows that
repeat a doc_id are all kept, in the order of the input's partitions; very long texts are encoded whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, documents, scratch, stored, texts
from .pretoken import PieceEncoder

END_ID = 0
STRIPE_BYTES = 16 << 20
_ENCODERS: dict[str, PieceEncoder] = {}
_WHOLE: dict[str, TextEncoder] = {}


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE writes bytes as printable characters: those of Latin-1 that print stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def library_encoder(path: str) -> PieceEncoder:
    """The tokenizers library's model, asked once for each distinct match of its pre-tokenizer's pattern; one per worker."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            pre = json.load(f)["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level tokenizer without a prefix space is needed")
        model, table = Tokenizer.from_file(path).model, _byte_chars()

        blank, tokenize = table[32], model.tokenize

        def encode_new(matches: list[str]) -> list[list[int]]:
            """Matches are handed over in the model's characters; printable ASCII stands for itself but for the space."""
            return [[t.id for t in tokenize(m.replace(" ", blank) if m.isascii() and m.isprintable() else m.encode().decode("latin-1").translate(table))] for m in matches]

        _ENCODERS[path] = PieceEncoder(public_tokenizers.PATTERN, encode_new)
    return _ENCODERS[path]


def text_encoder(path: str) -> TextEncoder:
    """One per worker."""
    if path not in _WHOLE:
        _WHOLE[path] = TextEncoder(path)
    return _WHOLE[path]


class TextEncoder:
    """Tokenizer.encode(text, add_special_tokens=False) of many texts: those that hold an added token (one that is cut out before the pattern) go to the library whole, the others by their pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if told["normalizer"] is not None:
            raise ValueError("a tokenizer without a normalizer is needed")
        self.added = [x["content"] for x in told["added_tokens"]]
        self.whole, self.pieces = Tokenizer.from_file(path), library_encoder(path)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        marked = [k for k, x in enumerate(texts) if any(a in x for a in self.added)]
        if not marked:
            return self.pieces.encode(texts)
        own = {k: self.whole.encode(texts[k], add_special_tokens=False).ids for k in marked}
        ids, lens = self.pieces.encode(["" if k in own else x for k, x in enumerate(texts)])
        at = np.repeat((np.cumsum(lens) - lens)[marked], [len(own[k]) for k in marked])
        lens[marked] = [len(own[k]) for k in marked]
        return np.insert(ids, at, np.concatenate([own[k] for k in marked])), lens


def encode_documents(docs: DataFrame, path: str, end_id: int = END_ID, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, ids) in the order of the input's partitions."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for table in blocks(batches, block_bytes):
            ids, lens = encoder.encode(texts(table["text"]))
            ends = np.cumsum(lens)
            ids = np.insert(ids.astype(np.int32), ends, end_id)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            n = table.num_rows
            for a in range(0, n, 2000):
                b = min(a + 2000, n)
                part = pa.array(ids[offsets[a] : offsets[b]], pa.int32())
                rows = pa.ListArray.from_arrays(pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32)), part)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(table["doc_id"].slice(a, b - a).chunks), rows], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def write_token_orc(docs: DataFrame, out: str, path: str, end_id: int = END_ID) -> None:
    """ids in ascending doc_id order; `file_no` and `row_no` tell the order of files and of rows. Rows of one doc_id may be split over files."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tie")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    placed = encode_documents(ordered, path, end_id).withColumns({"file_no": F.spark_partition_id(), "row_no": F.monotonically_increasing_id()})
    placed.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "2000").option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.compress", "ZSTD").orc(out)


def read_token_orc(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; doc_ids prunes stripes and row groups by statistics and Bloom filters."""
    rows = spark.read.orc(out)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files' rows, in the order of the files."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file_no"), batch.column("row_no"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file_no", "row_no", "n_tokens", "ids_crc32"])

    out = stored(rows.select("doc_id", "file_no", "row_no", "ids").mapInArrow(run, f"doc_id {kind}, file_no int, row_no long, n_tokens long, ids_crc32 long"), "token_digest")
    inside = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = out.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))  # one row a file
    before = totals.select("file_no", F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return out.join(before, "file_no").select("doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens_orc")
    write_token_orc(documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digest(read_token_orc(spark, out))
