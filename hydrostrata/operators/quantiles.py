"""Exact order statistics of a column without holding its distinct values in one state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a counting pass, and values that are at last sorted on the driver.
BINS, MOST = 2048, 100_000


def _at(df: DataFrame, ranks: list[int], lo: float, hi: float) -> dict[int, float]:
    """The values of the given ranks (from 0) among df's values `v`, which all lie in [lo, hi]."""
    if not ranks:
        return {}
    if lo == hi:
        return dict.fromkeys(ranks, lo)
    width = (hi - lo) / BINS
    bin_ = F.least(F.greatest(F.floor((F.col("v") - lo) / width), F.lit(0)), F.lit(BINS - 1)).cast("int") if width > 0 else F.lit(0)
    counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in df.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    wanted, before = {}, 0
    for b in sorted(counts):
        inside = [r for r in ranks if before <= r < before + counts[b][0]]
        if inside:
            wanted[b] = (before, inside)
        before += counts[b][0]
    out: dict[int, float] = {}
    few = [b for b in wanted if counts[b][1] < counts[b][2] and counts[b][0] <= MOST // len(wanted)]
    held: dict[int, list[float]] = {b: [] for b in few}
    for r in df.where(bin_.isin(few)).select(bin_.alias("b"), "v").collect() if few else []:
        held[r["b"]].append(r["v"])
    for b, (start, inside) in wanted.items():
        n, first, last = counts[b]
        if b in held:
            values = sorted(held[b])
            out |= {r: values[r - start] for r in inside}
        elif first == last:
            out |= dict.fromkeys(inside, first)
        else:  # a full bin is counted again on its own
            out |= {r + start: v for r, v in _at(df.where(bin_ == b), [r - start for r in inside], first, last).items()}
    return out


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation, nulls left out: each pass counts the values in bins, and only bins that hold a wanted rank go on, until they are small."""
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    found = _at(rows, sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))}), lo, hi)
    return [found[int(p)] if p == int(p) else (int(p) + 1 - p) * found[int(p)] + (p - int(p)) * found[int(p) + 1] for p in places]
