"""Variogram models fitted to empirical bins, for any number of groups in one grouped pass, and their lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model that explains less of the bins' variation than this is no model: the variogram is flat.
FLAT = 1e-9
#: Candidates of the first pass, of each further one, and how many of these: a bracket is 16 times narrower each time.
FIRST, STEPS, ROUNDS = 128, 32, 7
#: Distance parameter of the model's formula (h / a inside) as a share of the reach.
SCALES = {"spherical": 1.0, "exponential": 1 / 3, "gaussian": 4 / 7}
WEIGHTS = {"pairs": "pairs", "pairs_by_distance": "pairs / (distance * distance)", "equal": "1"}


def shape(kind: str, h: Column) -> Column:
    """What a model has risen by at h = distance / reach, from 0 to 1; reach is the practical range (0.95 for models that end nowhere)."""
    return {
        "spherical": lambda: F.when(h < 1, 1.5 * h - 0.5 * h * h * h).otherwise(F.lit(1.0)),
        "exponential": lambda: 1 - F.exp(-3 * h),
        "gaussian": lambda: 1 - F.exp(-49.0 / 16.0 * h * h),
    }[kind]()


def _risen(kind: str, h: np.ndarray) -> np.ndarray:
    near = np.minimum(h, 1.0)
    return {"spherical": lambda: 1.5 * near - 0.5 * near**3, "exponential": lambda: -np.expm1(-3 * h), "gaussian": lambda: -np.expm1(-49.0 / 16.0 * h * h)}[kind]()


def _at_reaches(kind: str, reach: np.ndarray, d: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each reach the best nugget and partial sill, neither negative, and the share of the variation that they explain."""
    rise, n = _risen(kind, d / reach[:, None]), w.sum()
    mf, mg = rise @ w / n, g @ w / n
    off = rise - mf[:, None]
    var = (off * off) @ w
    sill = np.maximum(np.divide((off * (g - mg)) @ w, var, out=np.zeros_like(var), where=var > 1e-12 * n), 0.0)
    nugget = mg - sill * mf
    through = (rise * g) @ w / np.maximum((rise * rise) @ w, 1e-300)
    sill, nugget = np.where(nugget < 0, through, sill), np.maximum(nugget, 0.0)
    total = ((g - mg) ** 2) @ w
    left = ((g - nugget[:, None] - sill[:, None] * rise) ** 2) @ w
    return nugget, sill, 1 - left / total if total > 0 else np.zeros_like(left)


def fit_variogram(bins: DataFrame, kind: str, by: list[str] = [], weights: str = "pairs", least: float | None = None, most: float | None = None) -> DataFrame:  # noqa: B006
    """(by, reach, scale, nugget, sill, r2, at_bound): the model of least weighted squares to the bins (distance, gamma, pairs) of each group.

    For a given reach the best nugget and partial sill are in closed form; the reach is bracketed from `least` to `most`
    (by default half the group's least distance and ten times its greatest): a first pass of candidates at equal steps
    of its logarithm, then passes between the neighbours of the best. Of equally good reaches the least counts.
    weights: "pairs", "pairs_by_distance" (pairs / distance squared) or "equal". A group of which no
    model explains anything (fewer than two bins, or variation that falls with distance) is flat: its reach is null, its
    sill 0, its nugget the weighted mean and its r2 0. at_bound: the best reach is an end of the bracket. A group's bins, a
    few by their definition, are one row.
    """
    rows = bins.where("distance > 0 and gamma is not null and pairs > 0").withColumn("_w", F.expr(WEIGHTS[weights]).cast("double"))
    groups = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.array(F.col("distance").cast("double"), F.col("gamma").cast("double"), "_w"))).alias("_bins")).where(F.size("_bins") > 0)

    def fit(rows: np.ndarray) -> tuple:
        d, g, w = rows.T
        lo, hi = np.log(least or d[0] / 2), np.log(most or d[-1] * 10)
        a, b, steps = lo, hi, FIRST
        for _ in range(ROUNDS + 1):
            at = np.linspace(a, b, steps + 1)
            nugget, sill, r2 = _at_reaches(kind, np.exp(at), d, g, w)
            k = int(r2.argmax())
            a, b, steps = at[max(k - 1, 0)], at[min(k + 1, steps)], STEPS
        if len(d) < 2 or r2[k] < FLAT or sill[k] <= 0:
            return None, None, float(g @ w / w.sum()), 0.0, 0.0, False
        reach = float(np.exp(at[k]))
        return reach, reach * SCALES[kind], float(nugget[k]), float(sill[k]), float(r2[k]), bool(min(at[k] - lo, hi - at[k]) < 1e-6)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fits = [fit(np.array([list(x) for x in own], float)) for own in pdf.pop("_bins")]
            yield pdf.assign(**{c: pd.Series(v, dtype=t, index=pdf.index) for c, v, t in zip(("reach", "scale", "nugget", "sill", "r2", "at_bound"), zip(*fits, strict=True), ("float64",) * 5 + ("bool",), strict=True)})

    own = "".join(f"`{c}` {bins.schema[c].dataType.simpleString()}, " for c in by)
    return groups.mapInPandas(run, own + "reach double, scale double, nugget double, sill double, r2 double, at_bound boolean")


def variogram_line(fits: DataFrame, kind: str, most: float, steps: int) -> DataFrame:
    """The fits' columns with (step from 1, distance, gamma): the models at equal steps up to `most`."""
    rows = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("distance", F.col("step") * (most / steps))
    return rows.withColumn("gamma", F.col("nugget") + F.coalesce(F.col("sill") * shape(kind, F.col("distance") / F.col("reach")), F.lit(0.0)))


def anisotropy(fits: DataFrame, by: list[str], direction: str, major: str) -> DataFrame:
    """(by, direction, ratio): each direction's reach over that of the major one."""
    base = fits.where(F.col(direction) == major).select(*by, F.col("reach").alias("_major"))
    rows = fits.join(base, by) if by else fits.crossJoin(F.broadcast(base))  # without groups: one row
    return rows.select(*by, direction, (F.col("reach") / F.col("_major")).alias("ratio"))
