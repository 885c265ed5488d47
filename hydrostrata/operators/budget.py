"""Daily soil-water budget, source allocation and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrostrata.functions.calendar import month_start, water_year


def effective_precip(precip: Column, eto: Column, factor: Column | float = 1.0) -> Column:
    """Scaled precipitation; 0 where it is under a fifth of reference evapotranspiration."""
    p = precip * factor
    return F.when(p < 0.2 * eto, 0.0).otherwise(p)


def irrigation_demand(pet: Column, eff_precip: Column, efficiency: Column, curtail: Column | float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), (pet - eff_precip) / efficiency) * (1 - curtail)


def allocate(df: DataFrame, by: list[str], order: list[str], demand: str, available: str) -> DataFrame:
    """Surface water in the order given: each takes what is left, up to its demand; the rest is `short`."""
    before = F.coalesce(F.sum(demand).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    got = F.greatest(F.lit(0.0), F.least(F.col(demand), F.col(available) - before))
    return df.withColumn("surface_water", got).withColumn("short", F.col(demand) - got)


def sources(source: Column, surface_water: Column, short: Column) -> Column:
    """Groundwater by source: 1 surface only, 2 or 999 groundwater only, 3 both, 4 and 5 none."""
    return F.when(source.isin(2, 999), surface_water + short).when(source == 3, short).otherwise(0.0)


def soil_water(df: DataFrame, field: str, day: str, capacity: float, initial: float) -> DataFrame:
    """The daily balance of each field: aet, recharge, swc (soil water at the day's end).

    aet = min(pet, swc + precip + irr); recharge = what exceeds the capacity after that. A recurrence in time:
    each field's days are one sorted array, folded by built-in functions, so fields are independent and a field
    costs one group of its own days.
    """
    days = df.groupBy(field).agg(F.array_sort(F.collect_list(F.struct(day, "precip", "irr", "pet"))).alias("_d"))
    start = F.struct(F.lit(float(initial)).alias("swc"), F.array().cast("array<struct<aet:double,recharge:double,swc:double>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        wet = acc["swc"] + d["precip"] + d["irr"]
        aet = F.least(d["pet"], wet)
        recharge = F.greatest(F.lit(0.0), wet - aet - capacity)
        swc = wet - aet - recharge
        return F.struct(swc.alias("swc"), F.concat(acc["out"], F.array(F.struct(aet.alias("aet"), recharge.alias("recharge"), swc.alias("swc")))).alias("out"))

    folded = days.withColumn("_o", F.aggregate("_d", start, step, lambda acc: acc["out"]))
    return folded.select(field, F.explode(F.arrays_zip("_d", "_o")).alias("_z")).select(field, f"_z._d.{day}", "_z._d.precip", "_z._d.irr", "_z._d.pet", "_z._o.aet", "_z._o.recharge", "_z._o.swc")


def soil_water_groups(df: DataFrame, field: str, day: str, capacity: float, initial: float) -> DataFrame:
    """The same balance for long records, one Arrow group a field, in time linear in its days."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        p, i, e = (pdf[c].to_numpy(float) for c in ("precip", "irr", "pet"))
        aet, recharge, swc, now = np.empty(len(p)), np.empty(len(p)), np.empty(len(p)), initial
        for k in range(len(p)):
            wet = now + p[k] + i[k]
            aet[k] = min(e[k], wet)
            recharge[k] = max(0.0, wet - aet[k] - capacity)
            swc[k] = now = wet - aet[k] - recharge[k]
        return pdf.assign(aet=aet, recharge=recharge, swc=swc)

    rows = df.select(field, day, "precip", "irr", "pet")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("aet", "recharge", "swc"))])
    return rows.groupBy(field).applyInPandas(run, schema)


def rollup(df: DataFrame, by: list[str], day: str, unit: str, measures: list[str]) -> DataFrame:
    """Sums of daily measures by month or water year."""
    label = {"month": month_start, "water_year": water_year}[unit](F.col(day)).alias(unit)
    return df.groupBy(*by, label).agg(*(F.sum(m).alias(m) for m in measures), F.count("*").alias("days"))


def closure(df: DataFrame, by: list[str]) -> DataFrame:
    """What each group's water budget leaves over: inflow - aet - recharge - change of storage."""
    return df.groupBy(*by).agg((F.sum("precip") + F.sum("irr") - F.sum("aet") - F.sum("recharge")).alias("net"))


def drain_flow(cells: DataFrame, heads: DataFrame, on: list[str], reach: list[str]) -> DataFrame:
    """Drain flow conductance * (head - elevation) where the head is above, summed by stream reach."""
    q = F.when(F.col("head") > F.col("elevation"), F.col("conductance") * (F.col("head") - F.col("elevation"))).otherwise(0.0)
    return cells.join(heads, on).groupBy(*reach).agg(F.sum(q).alias("flow"), F.count_if(F.col("head") > F.col("elevation")).alias("active"))


def effective_moves(moves: DataFrame, months: DataFrame) -> DataFrame:
    """Water moves in force in each month: start <= month < end. Moves are a stated table, exploded to their months and equi-joined."""
    span = moves.where("start_month < end_month").withColumn("month", F.explode(F.sequence("start_month", F.col("end_month") - 1)))
    return months.join(span, "month")


def depth_to_volume(df: DataFrame, depths: list[str], area: str) -> DataFrame:
    """Depths of water over a field's area as volumes."""
    return df.withColumns({c: F.col(c) * F.col(area) for c in depths})


def pumping(df: DataFrame, well: list[str], day: str, order: str, volume: str) -> DataFrame:
    """By well and month: daily values kept as they are overwritten (the last field of the day), and the month's volume and mean rate, which add every field up."""
    month = F.trunc(day, "month")
    days = df.groupBy(*well, day).agg(F.max_by(volume, order).alias("last"), F.sum(volume).alias("all"))
    return days.groupBy(*well, month.alias("month")).agg(F.sum("last").alias("daily_sum"), F.sum("all").alias("monthly"), (F.sum("all") / F.day(F.last_day(F.max(day)))).alias("rate"))


def segment_runoff(df: DataFrame, segment: list[str], runoff: str, days: int) -> DataFrame:
    """A month's runoff by stream segment as a daily rate."""
    return df.groupBy(*segment).agg((F.sum(runoff) / days).alias("rate"))
