"""Helpers that the corpus operators share: scratch tables, Arrow maps and byte/word arithmetic."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent on a local master (tests) a temporary folder is made and set; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hydrostrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, limit: int = 8 << 20) -> DataFrame:
    """fn on every Arrow batch, in parts of about `limit` bytes; empty ones are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, limit):
                if (out := fn(part)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of a batch of about `limit` bytes at most (one row at least)."""
    if batch.num_rows > 1 and batch.get_total_buffer_size() and batch.nbytes > limit:
        half = batch.num_rows // 2
        yield from sliced(batch.slice(0, half), limit)
        yield from sliced(batch.slice(half), limit)
    elif batch.num_rows:
        yield batch


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Cut and join Arrow batches to about `limit` bytes, so that per-block work is amortised in bounded memory."""
    pool = pa.default_memory_pool()
    held, size = [], 0
    for batch in batches:
        for part in sliced(batch, limit):
            if held and size + part.nbytes > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                pool.release_unused()
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... start+len-1 of each pair, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (public domain murmur3 constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def binary_rows(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
