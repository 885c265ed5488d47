"""Spectral embedding of a sparse affinity: leading eigenvectors of the normalised matrix by a block Krylov method.

The matrix is an edge table, and a product with a block of vectors is a join with the edges and a sum by row. Vectors
stay rows of a table; only inner products, as many as vectors squared, come to the driver. The basis grows by one block
a step until the wanted Ritz pairs have settled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .simulation import standard_normal


def neighbour_affinity(neighbours: DataFrame) -> DataFrame:
    """(a, b, w): the symmetric affinity of a neighbour table (qid, pid): 1 where each is a neighbour of the other, 0.5 where one is, and 1 of each point with itself."""
    rows = neighbours.where("qid <> pid").select("qid", "pid").distinct()
    half = F.lit(0.5).alias("w")
    both = rows.select(F.col("qid").alias("a"), F.col("pid").alias("b"), half).unionByName(rows.select(F.col("pid").alias("a"), F.col("qid").alias("b"), half))
    own = both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w")).unionByName(own)


def normalised(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, w / sqrt(degree a * degree b)) and (id, degree)."""
    degree = checkpointed(edges.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree")).where("degree > 0"))
    of = lambda c: degree.select(F.col("id").alias(c), F.col("degree").alias(f"_{c}"))
    rows = edges.join(of("a"), "a").join(of("b"), "b")
    return rows.select("a", "b", (F.col("w") / F.sqrt(F.col("_a") * F.col("_b"))).alias("w")), degree


def _products(rows: DataFrame) -> np.ndarray:
    """[Q V]' V over all rows (q: array, v: array): partial sums in each task, merged by a grouped sum."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in frames:
            if len(pdf):
                v = np.array(pdf["v"].tolist(), float)
                all_ = np.hstack([np.array(pdf["q"].tolist(), float).reshape(len(v), -1), v])
                total = all_.T @ v if total is None else total + all_.T @ v
        if total is not None:
            yield pd.DataFrame({"k": np.arange(total.size), "width": total.shape[1], "x": total.ravel()})

    found = rows.select("q", "v").mapInPandas(run, "k int, width int, x double").groupBy("k", "width").agg(F.sum("x").alias("x")).orderBy("k").collect()
    return np.array([r["x"] for r in found]).reshape(-1, found[0]["width"])


def _changed(rows: DataFrame, mix: np.ndarray, turn: np.ndarray) -> DataFrame:
    """v becomes (v - q mix) turn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                v, q = np.array(pdf["v"].tolist(), float), np.array(pdf["q"].tolist(), float).reshape(len(pdf), -1)
                yield pdf.assign(v=list((v - q @ mix) @ turn))

    return rows.mapInPandas(run, rows.schema)


def leading_vectors(matrix: DataFrame, count: int, block: int | None = None, steps: int = 60, tolerance: float = 1e-8, seed: int = 1) -> tuple[np.ndarray, DataFrame]:
    """The greatest eigenvalues of a symmetric matrix (a, b, w), descending, and (id, vector: array of the eigenvectors' components, each of length 1).

    block: vectors that grow together, more than the multiplicity of any wanted value. Raises if the residuals are over
    `tolerance` after `steps` blocks. An eigenvector's sign is such that its component of greatest size is positive.
    """
    matrix = checkpointed(matrix)
    ids = matrix.select(F.col("a").alias("id")).distinct()
    n = ids.count()
    block = min(block or count + 2, n)
    rows = ids.select("id", F.array().cast("array<double>").alias("q"), F.array(*(standard_normal("id", F.lit(k), F.lit(seed)) for k in range(block))).alias("v"))
    h = np.zeros((0, 0))
    for step in range(steps + 1):
        rows = checkpointed(rows)
        kept, width = len(h), block
        mix, turn = np.zeros((kept, width)), np.eye(width)
        for _ in range(2):  # orthogonal to the basis, twice for accuracy, and then among themselves
            p = _products(rows)
            inside, gram = p[:kept], p[kept:] - p[:kept].T @ p[:kept]
            size, axes = np.linalg.eigh(gram)
            good = size > max(size[-1], 0) * 1e-14 + 1e-28
            out = axes[:, good] / np.sqrt(size[good])
            rows = _changed(rows, inside, out)
            mix, turn = mix + inside @ np.linalg.pinv(turn), turn @ out  # v before = q mix + v pinv(turn)
            if not turn.shape[1]:  # the basis already holds all its images
                break
        rest = np.linalg.pinv(turn)
        if step:
            h[:, -last:] = mix  # the basis' image of the last block
        done = turn.shape[1] == 0 or kept >= n
        if step:
            values, vectors = np.linalg.eigh((h + h.T) / 2)
            order = np.argsort(-values)[:count]
            residual = np.abs(rest @ vectors[-last:, order]).max() if rest.size else 0.0
            if kept >= count and (residual < tolerance or done):
                break
        if step == steps or done:
            raise ValueError(f"not settled after {step} steps")
        last = block = turn.shape[1]
        grown = np.zeros((kept + last, kept + last))
        grown[:kept, :kept] = h
        if step:
            grown[kept:, kept - rest.shape[1] : kept] = rest
        h = grown
        held = checkpointed(rows.select("id", F.concat("q", "v").alias("q"), F.col("v").alias("x")))
        image = matrix.join(held.select(F.col("id").alias("b"), "x"), "b").groupBy(F.col("a").alias("id")).agg(*(F.sum(F.col("w") * F.col("x")[k]).alias(f"v{k}") for k in range(last)))
        rows = held.select("id", "q").join(image, "id").select("id", "q", F.array(*(f"v{k}" for k in range(last))).alias("v"))
    best = vectors[:, order]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "vector": list(np.array(pdf["q"].tolist(), float) @ best)})

    found = checkpointed(held.select("id", "q").mapInPandas(run, f"id {ids.schema['id'].dataType.simpleString()}, vector array<double>"))
    top = found.agg(*(F.max_by(F.col("vector")[k], F.struct(F.round(F.abs(F.col("vector")[k]), 9), -F.col("id"))).alias(f"m{k}") for k in range(count))).first()
    signs = F.array(*(F.lit(-1.0 if top[k] < 0 else 1.0) for k in range(count)))
    return values[order], found.select("id", F.zip_with("vector", signs, lambda x, s: x * s).alias("vector"))


def spectral_embedding(edges: DataFrame, count: int, tolerance: float = 1e-8) -> tuple[np.ndarray, DataFrame]:
    """The leading eigenvalues of an affinity (a, b, w) and (id, vector): components of the eigenvectors over the root of the degree, in which clusters lie apart."""
    matrix, degree = normalised(edges)
    values, found = leading_vectors(matrix, count, tolerance=tolerance)
    return values, found.join(degree, "id").select("id", F.transform("vector", lambda x: x / F.sqrt("degree")).alias("vector"))
