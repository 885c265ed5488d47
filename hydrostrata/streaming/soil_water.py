"""The soil-water balance as a stream: an extension, for daily drivers that arrive in micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "field long, day date, aet double, recharge double, swc double"


def soil_water_stream(drivers: DataFrame, capacity: float, initial: float) -> DataFrame:
    """Balance of each (field, day, precip, irr, pet) row; a field's days come in order, and its state is its last soil water."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else initial
        rows = pd.concat(list(frames)).sort_values("day")
        out = []
        for day, precip, irr, pet in rows[["day", "precip", "irr", "pet"]].itertuples(index=False):
            wet = now + precip + irr
            aet = min(pet, wet)
            recharge = max(0.0, wet - aet - capacity)
            now = wet - aet - recharge
            out.append((key[0], day, aet, recharge, now))
        state.update((now,))
        yield pd.DataFrame(out, columns=["field", "day", "aet", "recharge", "swc"])

    return drivers.groupBy("field").applyInPandasWithState(step, SCHEMA, "swc double", "append", GroupStateTimeout.NoTimeout)


def monthly_volume_stream(rows: DataFrame, time: str, value: str, late: str = "10 days") -> DataFrame:
    """Sums of 30-day windows with a watermark; a window is given out once, when no late row can reach it."""
    from pyspark.sql import functions as F

    return rows.withWatermark(time, late).groupBy(F.window(time, "30 days")).agg(F.sum(value).alias("volume"), F.count("*").alias("n"))
