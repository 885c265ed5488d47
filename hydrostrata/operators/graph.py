"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names; in a temporary folder only on a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which leaves nothing of its plan."""
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component: the least id reached) of nodes (id), from edges (a, b) given once each.

    A node takes the least label about it and then its label's own label, so that rounds grow with the logarithm of a
    path; each round is checkpointed.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = checkpointed(nodes.select("id", F.col("id").alias("component")))
    while True:
        of = state.withColumnRenamed("id", "b")
        about = both.join(of, "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_m"))
        lower = state.join(about, "id", "left").select("id", F.least("component", F.coalesce("_m", "component")).alias("_c"), F.col("component").alias("_was"))
        # A label that has found a lower one hands it on to all that carry it.
        best = lower.groupBy("_was").agg(F.min("_c").alias("_best"))
        hop = lower.join(best, "_was").select("id", F.least("_c", "_best").alias("_c"), "_was")
        new = checkpointed(hop)
        changed = new.where("_c <> _was").limit(1).count()
        state = new.select("id", F.col("_c").alias("component"))
        if not changed:
            return state
