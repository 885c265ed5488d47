"""Rows for flow-model inputs: irrigation starts, inflow shares, ditches, evapotranspiration, conductances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def irrigation_starts(triggers: DataFrame, neighbours: int, by: list[str] | None = None) -> DataFrame:
    """(by, field, own, start): a field starts on its first triggered day of the season, or, once `neighbours` fields have
    started, on the day after that, whichever is first. triggers: by, field, day (rows on which a field's rule holds)."""
    by = by or ["season"]
    own = triggers.groupBy(*by, "field").agg(F.min("day").alias("own"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("own", "field"))
    reached = own.withColumn("_n", rank).where(F.col("_n") == neighbours).select(*by, F.date_add("own", 1).alias("_all"))
    return own.join(reached, by, "left").withColumn("start", F.least("own", F.coalesce("_all", "own"))).drop("_all")


def shares(inflow: DataFrame, segments: DataFrame, on: list[str], volume: str, share: str) -> DataFrame:
    """Inflow of each segment: the group's volume by the segment's part of the group's shares."""
    part = F.col(share) / F.nullif(F.sum(share).over(Window.partitionBy(*on)), F.lit(0.0))
    return inflow.join(segments.withColumn("_p", part), on).withColumn("flow", F.col(volume) * F.col("_p")).drop("_p")


def ditch_wells(cells: DataFrame, monthly: DataFrame) -> DataFrame:
    """(ditch, month, cell, rate): each month's leakage over the ditch's cells, months without leakage left out."""
    n = cells.groupBy("ditch").agg(F.count("*").alias("_n"))
    return monthly.where("leakage > 0").join(n, "ditch").join(cells, "ditch").select("ditch", "month", "cell", (F.col("leakage") / F.col("_n")).alias("rate"))


def unused_et(daily: DataFrame, by: list[str], active: str, eto: str) -> DataFrame:
    """Mean reference evapotranspiration of a period by the share of its days on which no crop was active."""
    n = F.count("*")
    return daily.groupBy(*by).agg((F.avg(eto) * (1 - F.count_if(F.col(active)) / n)).alias("et"), n.alias("days"))


def top_active(cells: DataFrame, column: list[str], layer: str, active: str) -> DataFrame:
    """The top-most active layer of each column of cells; columns without one are left out."""
    return cells.where(F.col(active) != 0).groupBy(*column).agg(F.min(layer).alias(layer))


def et_by_depth(depth: Column, extinction: float, segments: list[tuple[float, float]]) -> Column:
    """Share of the full rate at a depth: 1 at the surface, 0 from the extinction depth, straight between the given (share of depth, share of rate) points."""
    points = [(0.0, 1.0), *segments, (1.0, 0.0)]
    x = depth / extinction
    out = F.when(x <= 0, 1.0)
    for (a, p), (b, q) in zip(points[:-1], points[1:], strict=True):
        out = out.when(x < b, p + (x - a) * ((q - p) / (b - a)))
    return out.otherwise(0.0)


def conductance(cells: DataFrame, along: str, across: list[str], k: str, width: str) -> DataFrame:
    """Logarithmic-mean conductance between each cell and the next along one axis; null at the end."""
    w = Window.partitionBy(*across).orderBy(along)
    k1, k2 = F.col(k), F.lead(k).over(w)
    ratio = k2 / k1
    mean = F.when(F.abs(ratio - 1) < 5e-3, (k1 + k2) / 2).otherwise((k2 - k1) / F.ln(ratio))
    return cells.withColumn("conductance", 2 * mean / (F.col(width) + F.lead(width).over(w)))


def at_point(cells: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """Bilinear value at points (id, row, col, roff, coff) from cells (row, col, value): four equi-joined corners; missing corners drop out and the weights are rescaled."""
    dr, dc = F.when(F.col("roff") >= 0, 1).otherwise(-1), F.when(F.col("coff") >= 0, 1).otherwise(-1)
    a, b = F.abs("roff"), F.abs("coff")
    corner = lambda r, c, w: F.struct((F.col("row") + r).cast("int").alias("row"), (F.col("col") + c).cast("int").alias("col"), w.alias("w"))
    corners = F.array(corner(F.lit(0), F.lit(0), (1 - a) * (1 - b)), corner(dr, F.lit(0), a * (1 - b)), corner(F.lit(0), dc, (1 - a) * b), corner(dr, dc, a * b))
    rows = points.select("id", F.explode(corners).alias("c")).select("id", "c.row", "c.col", "c.w").where("w > 0")
    return rows.join(cells.select("row", "col", value), ["row", "col"]).groupBy("id").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def class_breaks(df: DataFrame, value: str, n: int = 5) -> DataFrame:
    """Breaks of n equal classes between the 5th and the 95th percentile, and the maximum."""
    low, high = quantiles(df, value, [0.05, 0.95])
    steps = F.array(*(F.lit(None if low is None else low + k * (high - low) / n).cast("double") for k in range(n)))
    return df.agg(F.max(value).cast("double").alias("m")).select(F.posexplode(F.concat(steps, F.array("m"))).alias("class", "break"))


def chained(df: DataFrame, chain: list[str], base: str) -> DataFrame:
    """Parameters given as factors of the one before: each becomes base times all factors up to it."""
    total = F.col(base)
    out = {}
    for c in chain:
        total = total * F.col(c)
        out[c] = total
    return df.withColumns(out)
