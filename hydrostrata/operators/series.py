"""Time series: calendar sums, differences, centred rolling statistics, gaps, duration curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrostrata.functions.calendar import month_start, water_year

from .graph import checkpointed
from .quantiles import quantiles


def calendar_sums(df: DataFrame, date: str, value: str, unit: str) -> DataFrame:
    """Sum and count of value by 'month' or 'water_year'."""
    label = {"month": month_start, "water_year": water_year}[unit](F.col(date))
    return df.groupBy(label.alias(unit)).agg(F.sum(value).alias("volume"), F.count("*").alias("n"))


def differences(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "diff") -> DataFrame:
    """Value less the one before it; null at each group's first row."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def _frame(by: list[str], order: list[str], width: int) -> Window:
    """Centred rows; an even width reaches one row further back."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width // 2), (width - 1) // 2)


def rolling(df: DataFrame, by: list[str], order: list[str], value: str, width: int, least: int, how: str, out: str) -> DataFrame:
    """Centred rolling 'mean' or 'median'; null with fewer than `least` values."""
    w = _frame(by, order, width)
    stat = F.avg(value).over(w) if how == "mean" else F.expr(f"percentile(`{value}`, 0.5)").over(w)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, stat))


def densify(df: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    """One row a day between each group's first and last; days without data have a null value."""
    span = df.groupBy(*by).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = span.select(*by, F.explode(F.sequence("_a", "_b")).alias(date))
    return days.join(df.select(*by, date, value), [*by, date], "left")


def interpolate_gaps(df: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    """Null values between two known ones, on the straight line in time."""
    back = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(date).alias("d"), F.col(value).alias("v")))
    df = df.withColumns({"_p": F.last(at, True).over(back), "_n": F.first(at, True).over(ahead)})
    whole = F.datediff("_n.d", "_p.d")
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.datediff(date, F.col("_p.d")) / F.when(whole > 0, whole)
    return df.withColumn(value, F.coalesce(F.col(value), line)).drop("_p", "_n")


def pchip_gaps(df: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    """Null values between known ones by monotone cubic (Fritsch-Carlson) interpolation: tangents from windows over the known rows alone, then a cubic between the known rows about each gap."""
    none_if_0 = lambda c: F.nullif(c, F.lit(0.0))
    t, v = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("double"), F.col(value).cast("double")
    known = F.col(value).isNotNull()
    w = Window.partitionBy(*by, known).orderBy(date)
    rows = df.select(*by, date, v.alias(value)).withColumn("_t", t)
    gap = lambda c, k: F.lead(c, k).over(w) - F.lead(c, k - 1).over(w)
    for k, name in ((-1, "p"), (0, "0"), (1, "1"), (2, "2")):  # interval 0 ends at the row, 1 starts there
        rows = rows.withColumns({f"_h{name}": gap("_t", k), f"_g{name}": gap(value, k) / none_if_0(gap("_t", k))})

    def end(first: str, second: str, h0: str, h1: str) -> Column:
        f, s = F.col(first), F.col(second)
        e = ((2 * F.col(h0) + F.col(h1)) * f - F.col(h0) * s) / none_if_0(F.col(h0) + F.col(h1))
        return F.when(s.isNull(), f).when(e * f <= 0, 0.0).when((f * s < 0) & (F.abs(e) > 3 * F.abs(f)), 3 * f).otherwise(e)

    w1, w2 = 2 * F.col("_h1") + F.col("_h0"), F.col("_h1") + 2 * F.col("_h0")
    inner = F.when(F.col("_g0") * F.col("_g1") > 0, (w1 + w2) / (w1 / none_if_0(F.col("_g0")) + w2 / none_if_0(F.col("_g1")))).otherwise(0.0)
    tangent = F.when(F.col("_h0").isNull(), end("_g1", "_g2", "_h1", "_h2")).when(F.col("_h1").isNull(), end("_g0", "_gp", "_h0", "_hp")).otherwise(inner)
    at = F.when(known, F.struct(F.col("_t").alias("t"), F.col(value).alias("v"), tangent.alias("m")))
    back = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_at", at).withColumns({"_p": F.last("_at", True).over(back), "_n": F.first("_at", True).over(ahead)})
    h = F.col("_n.t") - F.col("_p.t")
    s = (F.col("_t") - F.col("_p.t")) / none_if_0(h)
    cubic = (1 + 2 * s) * (1 - s) * (1 - s) * F.col("_p.v") + s * (1 - s) * (1 - s) * h * F.col("_p.m") + s * s * (3 - 2 * s) * F.col("_n.v") + s * s * (s - 1) * h * F.col("_n.m")
    return rows.select(*by, date, F.coalesce(F.col(value), cubic).alias(value))


def duration_curve(df: DataFrame, by: list[str], value: str, tie: list[str]) -> DataFrame:
    """Share of values at or above each one: rank by descending value over the group's size.

    Rows are dealt by ranges of (group, value, tie), counted and ranked by range, and shifted by the ranges before, so
    that a group of any size is ranked by many tasks. Ranges are checkpointed: a range's number must not change.
    """
    order = [F.desc(value), *tie]
    ranged = checkpointed(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    counts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_n").over(group).alias("_all"))
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return ranked.join(counts, [*same, F.col("_part") == F.col("_p")]).select(*df.columns, ((F.col("_r") + F.col("_before")) / F.col("_all")).alias("exceedance"))


def paired_difference(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Difference of two series where both have a value."""
    return a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on).select(*on, (F.col("_a") - F.col("_b")).alias("diff"))


def flow_groups(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """flow_group 0.. by quantiles of all values (linear interpolation)."""
    group = F.lit(0)
    for cut in quantiles(df, value, shares):
        group = group + F.when(F.col(value) > F.lit(cut), 1).otherwise(0)
    return df.withColumn("flow_group", group)


def skips(df: DataFrame, by: list[str], date: str) -> DataFrame:
    """Days from the row before to each row, less one: lines to skip in a daily output; null at the first."""
    gap: Column = F.datediff(F.col(date), F.lag(date).over(Window.partitionBy(*by).orderBy(date))) - 1
    return df.withColumn("skip_lines", gap)
