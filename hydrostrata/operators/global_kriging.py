"""Simple kriging from all points at once, by preconditioned conjugate gradients over blocks of points.

Points are dealt to square buckets at least as wide as the covariance reaches and, where a bucket holds many, to several blocks;
a block's coordinates and vectors are arrays of one row. A product with the covariance matrix joins blocks of
neighbouring buckets, works out their covariances on the spot and sums by point: the matrix is nowhere kept, and beyond
its support the covariance is 0 in double precision. Each block's own system is the preconditioner. Only inner products come
to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .interpolation import _model

#: Points of a block, about.
BLOCK = 400
#: Reaches beyond which a covariance is less than 1e-17 of the sill.
SUPPORT = {"spherical": 1.0, "exponential": math.log(1e17) / 3, "gaussian": math.sqrt(math.log(1e17) * 16 / 49)}
_COLUMNS = "block long, bx long, by long, ids array<long>, xs array<double>, ys array<double>"


def _blocks(points: DataFrame, key: str, x: str, y: str, side: float, value: str | None = None) -> DataFrame:
    """One row a block: bucket, ids in order, coordinates, and `r`: the values."""
    rows = points.select(F.col(key).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(value) if value else F.lit(0.0)).cast("double").alias("v"))
    rows = rows.withColumns({"bx": F.floor(F.col("x") / side), "by": F.floor(F.col("y") / side)})
    counts = rows.groupBy("bx", "by").agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    dealt = rows.join(counts, ["bx", "by"]).withColumn("_c", F.pmod(F.xxhash64("id"), F.col("_n")))
    held = dealt.groupBy("bx", "by", "_c").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y", "v"))).alias("p"))
    part = lambda c: F.col(f"p.{c}")
    return held.select(F.monotonically_increasing_id().alias("block"), "bx", "by", part("id").alias("ids"), part("x").alias("xs"), part("y").alias("ys"), part("v").alias("r"))


def _stack(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(x, float) for x in column]


def _product(left: DataFrame, right: DataFrame, cov, vector: str) -> DataFrame:
    """(block, k, y): the covariance between left's points and right's times right's vector, summed over right; k counts a block's points from 0."""
    step = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    asked = left.select("block", F.col("xs").alias("lx"), F.col("ys").alias("ly"), "bx", "by").withColumn("_i", step).withColumn("_j", step)
    asked = asked.withColumns({"bx": F.col("bx") + F.col("_i"), "by": F.col("by") + F.col("_j")}).drop("_i", "_j")
    pairs = asked.join(right.select("bx", "by", "xs", "ys", F.col(vector).alias("v")), ["bx", "by"]).select("block", "lx", "ly", "xs", "ys", "v")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            total: dict[int, np.ndarray] = {}
            for block, lx, ly, xs, ys, v in zip(pdf["block"], *map(_stack, (pdf["lx"], pdf["ly"], pdf["xs"], pdf["ys"], pdf["v"])), strict=True):
                y = cov(np.hypot(lx[:, None] - xs, ly[:, None] - ys)) @ v
                total[block] = total[block] + y if block in total else y
            if total:
                yield pd.DataFrame({"block": np.repeat(list(total), [len(y) for y in total.values()]), "k": np.concatenate([np.arange(len(y)) for y in total.values()]), "y": np.concatenate(list(total.values()))})

    return pairs.mapInPandas(run, "block long, k int, y double").groupBy("block", "k").agg(F.sum("y").alias("y"))


def _dot(a: str, b: str):
    return F.sum(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def simple_kriging(targets: DataFrame, points: DataFrame, value: str, kind: str, nugget: float, sill: float, reach: float, tolerance: float = 1e-10, rounds: int = 500) -> DataFrame:
    """(qid, estimate) of simple kriging from all points (pid, px, py, value), around their mean; targets: qid, qx, qy.

    Raises if the residual is over `tolerance` times the values' length after `rounds`. Points that coincide share their
    weight. Without points estimates are null.
    """
    n, mean, *ends = points.where(F.col(value).isNotNull()).agg(F.count("*"), F.avg(value), *(f(c) for c in ("px", "py") for f in (F.min, F.max))).first()
    if mean is None:
        return targets.select("qid", F.lit(None).cast("double").alias("estimate"))
    cov, wide = _model(kind, nugget, sill, reach), max(ends[1] - ends[0], ends[3] - ends[2])
    side = max(SUPPORT[kind] * reach, wide * math.sqrt(BLOCK / n))  # few points: few blocks
    about = points.where(F.col(value).isNotNull()).withColumn("_v", F.col(value) - F.lit(float(mean)))
    blocks = checkpointed(_blocks(about, "pid", "px", "py", side, "_v"))
    solution = _solved(blocks, cov, tolerance, rounds)

    asked = checkpointed(_blocks(targets, "qid", "qx", "qy", side).drop("r"))
    sums = _product(asked, solution, cov, "x")
    every = asked.select("block", F.posexplode("ids").alias("k", "qid"))
    return every.join(sums, ["block", "k"], "left").select("qid", (F.lit(float(mean)) + F.coalesce("y", F.lit(0.0))).alias("estimate"))


def _solved(blocks: DataFrame, cov, tolerance: float, rounds: int) -> DataFrame:
    """The blocks with x: the solution of the covariance system for their values r."""

    def own(pdf: pd.DataFrame, r: list[np.ndarray]) -> list[np.ndarray]:
        """Each block's residuals through its own system."""
        out = []
        for xs, ys, b in zip(_stack(pdf["xs"]), _stack(pdf["ys"]), r, strict=True):
            c = cov(np.hypot(xs[:, None] - xs, ys[:, None] - ys))
            try:
                low = np.linalg.cholesky(c)
                out.append(np.linalg.solve(low.T, np.linalg.solve(low, b)))
            except np.linalg.LinAlgError:
                out.append(np.linalg.pinv(c, rcond=1e-12, hermitian=True) @ b)
        return out

    def stepped(state: DataFrame, alpha: float) -> DataFrame:
        """x and r moved along p, and z from the new r."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                x, r, p, y = (_stack(pdf[c]) for c in ("x", "r", "p", "y"))
                r = [a - alpha * b for a, b in zip(r, y, strict=True)]
                yield pdf.drop(columns="y").assign(x=[a + alpha * b for a, b in zip(x, p, strict=True)], r=r, z=own(pdf, r))

        return state.mapInPandas(run, f"{_COLUMNS}, x array<double>, r array<double>, p array<double>, z array<double>")

    zeros = F.transform("r", lambda _: F.lit(0.0))
    state = checkpointed(stepped(blocks.select("block", "bx", "by", "ids", "xs", "ys", zeros.alias("x"), "r", zeros.alias("p"), zeros.alias("y")), 0.0))
    rz, rr = state.agg(_dot("r", "z"), _dot("r", "r")).first()
    goal, beta = tolerance * math.sqrt(rr), 0.0
    for _ in range(rounds):
        if math.sqrt(rr) <= goal:
            return state
        moved = state.withColumn("p", F.zip_with("z", "p", lambda z, p: z + beta * p)).drop("z")  # noqa: B023
        image = _product(moved, moved, cov, "p").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "y"))).alias("_y")).select("block", F.col("_y.y").alias("y"))
        moved = checkpointed(moved.join(image, "block").select("block", "bx", "by", "ids", "xs", "ys", "x", "r", "p", "y"))
        alpha = rz / moved.agg(_dot("p", "y")).first()[0]
        state = checkpointed(stepped(moved, alpha))
        before = rz
        rz, rr = state.agg(_dot("r", "z"), _dot("r", "r")).first()
        beta = rz / before
    if math.sqrt(rr) <= goal:
        return state
    raise ValueError(f"residual {math.sqrt(rr):.3g} after {rounds} rounds, not {goal:.3g}")
