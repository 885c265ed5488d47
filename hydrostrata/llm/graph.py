"""Connected components of an edge table, by joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b): component is the least id that the node reaches.

    Alternates the large-star and small-star steps, each round written to shared storage, until the edges no
    longer change; rounds grow with the logarithm of the longest path. Grouped minima combine before their
    shuffle, and the joins back may be split where a node has very many neighbours.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == last or not state["n"]:
            break
        last = tuple(state)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(nearest.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
