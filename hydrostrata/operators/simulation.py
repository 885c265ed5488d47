"""Sequential Gaussian simulation by nested levels, for all zones and realisations at once.

A node's level is the coarsest of a pyramid of square buckets in which it has the least hash of its bucket, so that
early levels are spread over the area and every level has about four times the nodes of the one before. Nodes of a level
are drawn together, each given its nearest neighbours among the data and the nodes of earlier levels: neighbours
and kriging systems don't depend on values, so those of all levels and realisations are worked out in one pass, and
only the sums of weighted values go level by level. Nodes of one level do not see each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .interpolation import Model, kriging_weights
from .learning import draw
from .spatial import knn

_UNIT = float(1 << 28)


def standard_normal(*keys: Column | str) -> Column:
    """A standard normal variate that depends on the keys alone, by the Box-Muller transform of two hashes."""
    u = lambda k: (draw(*keys, F.lit(k)) + 0.5) / _UNIT
    return F.sqrt(-2 * F.ln(u("r"))) * F.cos(2 * math.pi * u("a"))


def levels(nodes: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(nodes' columns, level from 0) of nodes (zone, id, x, y), and the last level, which also takes the nodes that come first in no bucket."""
    n, x0, x1, y0, y1 = nodes.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    last = math.ceil(math.log(max(n, 1), 4)) + 1
    wide = max(x1 - x0, y1 - y0, 1e-300) if n else 1.0
    side = F.pow(F.lit(2.0), -F.col("level")) * (wide * 1.000001)
    bucket = lambda c, c0: F.floor((F.col(c) - F.lit(c0)) / side)
    rows = nodes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(last - 1))))
    first = rows.groupBy("zone", "level", bucket("x", x0 or 0.0).alias("_bx"), bucket("y", y0 or 0.0).alias("_by")).agg(F.min(F.struct(draw("id", F.lit(seed)).alias("u"), "id")).alias("_m"))
    found = first.select(F.col("_m.id").alias("id"), "level").groupBy("id").agg(F.min("level").alias("level"))
    return nodes.join(found, "id", "left").select(*nodes.columns, F.coalesce("level", F.lit(last)).alias("level")), last


def simulate(points: DataFrame, model: Model, k: int, side: float, realisations: int, seed: int = 1, low: float | None = 0.0, high: float | None = 1.0) -> DataFrame:
    """(zone, realisation from 1, id, value) of points (zone, id, x, y, value; null: to simulate); ids are unique over all zones.

    A node is drawn around its ordinary kriging estimate from the k nearest known or earlier nodes of its zone, with the
    kriging variance, and held between low and high (None: no limit). Draws depend on id, realisation and seed only.
    side: of the finest buckets of the neighbour search. Raises if a zone to simulate has no data.
    """
    known, nodes = points.where("value is not null"), points.where("value is null").select("zone", "id", "x", "y")
    if bare := nodes.select("zone").distinct().join(known.select("zone").distinct(), "zone", "left_anti").limit(5).collect():
        raise ValueError(f"zones without data: {[r['zone'] for r in bare]}")
    placed, last = levels(nodes, seed)
    placed = checkpointed(placed)
    # A number for each datum (even) and node (odd); a point is there for all levels that may see it.
    there = lambda df, odd, first: df.select("zone", F.explode(F.sequence(first, F.lit(last))).alias("level"), (F.col("id") * 2 + odd).alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    seen = there(known, 0, F.lit(0)).unionByName(there(placed.where(F.col("level") < last), 1, F.col("level") + 1))
    asked = placed.select("zone", "level", F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    weights = kriging_weights(knn(asked, seen, k, side, by=("zone", "level")), *model, variance=True)
    weights = checkpointed(weights.join(placed.select(F.col("id").alias("qid"), "zone", "level"), "qid"))

    ordered_sum = F.aggregate(F.array_sort(F.collect_list(F.struct("pid", (F.col("weight") * F.col("value")).alias("v")))), F.lit(0.0), lambda a, x: a + x["v"])
    given = known.select((F.col("id") * 2).alias("pid"), "value")
    base = weights.groupBy("qid", "zone", "level").agg(F.sqrt(F.greatest(F.max("variance"), F.lit(0.0))).alias("dev"))
    base = checkpointed(base.join(weights.join(given, "pid").groupBy("qid").agg(ordered_sum.alias("_data")), "qid", "left"))
    runs = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(realisations).cast("long"))).alias("realisation")
    done: DataFrame | None = None
    for level in range(last + 1):
        value = F.coalesce("_data", F.lit(0.0))
        own = base.where(F.col("level") == level).select("*", runs)
        if done is not None:
            drawn = done.select((F.col("id") * 2 + 1).alias("pid"), "realisation", "value")
            earlier = weights.where((F.col("level") == level) & (F.col("pid") % 2 != 0)).select("qid", "pid", "weight").join(drawn, "pid")
            own = own.join(earlier.groupBy("qid", "realisation").agg(ordered_sum.alias("_nodes")), ["qid", "realisation"], "left")
            value = value + F.coalesce("_nodes", F.lit(0.0))
        value = value + F.col("dev") * standard_normal("qid", "realisation", F.lit(seed))
        value = value if low is None else F.greatest(value, F.lit(float(low)))
        value = value if high is None else F.least(value, F.lit(float(high)))
        new = checkpointed(own.select("zone", "realisation", F.col("qid").alias("id"), value.alias("value")))
        done = new if done is None else done.unionByName(new)
    return done.unionByName(known.select("zone", runs, "id", F.col("value").cast("double").alias("value")))
