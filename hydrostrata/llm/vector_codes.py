"""Compression of vectors to codes by integer codebooks: product quantisation in exact arithmetic.

Each component becomes floor(256 * x), each vector is cut into equal parts, and each part position has a codebook whose
entries begin as the parts of the first vectors. A round assigns every part to its nearest entry and moves each entry
to the floored mean of its parts. Codebooks are small (entries times components) and go to every task; an Arrow batch
gets all its distances as |x|^2 - 2 x.c + |c|^2 from int64 matrix products, which are exact within BOUND, and takes the
first least one. A task adds up its parts by entry, one row an entry, and a grouped shuffle merges the tasks' rows.

Defined cases: a vector that is null, or holds a null or a component that is not finite, is left out; a null label is a
label of its own; a null vec_id comes after all others when first vectors are taken; rows that share a vec_id are
vectors of their own, ordered by their components; of equally near entries the first counts; an entry without parts
stays; with fewer vectors than entries there are as many entries as vectors; an empty table gives an empty result;
other columns are ignored. Vectors of different lengths, a length that the parts don't divide and
vectors beyond LONGEST raise a ValueError, and components beyond BOUND / 256 fail the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, stored
from .even_join import even_join

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The largest integer component and the longest vector: errors, at most LONGEST * (2 * BOUND)**2, stay below 2**63.
BOUND, LONGEST = 1 << 24, 4096
#: Distances of a batch at a time.
BATCH_ROWS = 2048


def integer_vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, code: components as integers) of the vectors that are kept."""
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(whole).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("_v"))
    scaled = lambda x: F.floor(x.cast("double") * SCALE)
    return rows.select("vec_id", "label", F.transform("_v", lambda x: F.when(F.abs(x.cast("double")) * SCALE <= BOUND, scaled(x)).otherwise(F.raise_error(F.lit(f"a component is beyond {BOUND // SCALE}"))).cast("int")).alias("code"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return pc.list_flatten(batch.column("code")).to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (rows, components): its entry for each part and the squared distances to them. books: parts, entries, components of a part."""
    parts, entries, size = books.shape
    codes, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    norms = (books * books).sum(axis=2)
    for p in range(parts):
        own = x[:, p * size : (p + 1) * size]
        d = norms[p] - 2 * (own @ books[p].T)
        codes[:, p] = d.argmin(axis=1)
        far[:, p] = d[np.arange(len(x)), codes[:, p]] + (own * own).sum(axis=1)
    return codes, far


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The first vectors by (vec_id, components), cut into parts."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "code").limit(entries).select("code").collect()
    width = len(rows[0]["code"]) if rows else 0
    return np.array([r["code"] for r in rows], np.int64).reshape(len(rows), parts, width // parts).transpose(1, 0, 2)


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: sums by entry in each task, merged by a grouped shuffle."""
    parts, entries, size = books.shape
    sums = [f"s{k}" for k in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                x = _matrix(batch.slice(at, BATCH_ROWS), parts * size)
                slots = (nearest(x, books)[0] + np.arange(parts) * entries).ravel()
                count += np.bincount(slots, minlength=parts * entries)
                order = np.argsort(slots, kind="stable")
                used, first = np.unique(slots[order], return_index=True)
                total[used] += np.add.reduceat(x.reshape(-1, size)[order], first, axis=0)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), *(pa.array(total[used, k]) for k in range(size))], ["slot", "n", *sums])

    merged = vectors.select("code").mapInArrow(run, ", ".join(["slot int", "n long", *(f"{s} long" for s in sums)])).groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("n", *sums)))
    out = books.reshape(parts * entries, size).copy()
    for r in merged.collect():  # one row an entry
        out[r["slot"]] = [r[s] // r["n"] for s in sums]
    return out.reshape(books.shape)


def assigned(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): entries by part in two hex digits each, and the squared distance to them."""
    parts, _, size = books.shape
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 8 << 20):
                for at in range(0, part.num_rows, BATCH_ROWS):
                    own = part.slice(at, BATCH_ROWS)
                    codes, far = nearest(_matrix(own, parts * size), books)
                    text = codes.astype(np.uint8).tobytes().hex()
                    yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()), pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order, joined by ','."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks (parts, entries, components)."""
    if entries > 256:
        raise ValueError("a code has two hex digits")
    vectors = stored(integer_vectors(df, key, vector, label), "integer_vectors")
    least, most = vectors.agg(F.min(F.size("code")), F.max(F.size("code"))).first()
    if least != most or (least or 0) % parts or (most or 0) > LONGEST:
        raise ValueError(f"vectors need one length up to {LONGEST} that {parts} divides, not {least} to {most}")
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved(vectors, books)
    return assigned(vectors, books), books


def decompress(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, vector of doubles): the entries' components of each code, at the middle of their steps."""
    parts, _, size = books.shape
    kind = codes.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, parts)
            rows = (books[np.arange(parts), at].reshape(len(at), parts * size) + 0.5) / SCALE
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(rows), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, f"vec_id {kind}, vector array<double>")


def op12_integer_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = stored(codes, "vector_codes")
    errors = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = even_join(rows, errors, "label", "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
