"""Simulation by levels against a loop in numpy, and its conditional mean and variance."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrostrata.operators import simulation

MODEL = ("exponential", 0.0, 1.0, 0.5)


def points(spark, n, zones=2, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k % zones, k, float(x), float(y), float(rng.normal(0.5, 0.3)) if k % 5 == 0 else None) for k, (x, y) in enumerate(rng.uniform(-1, 1, (n, 2)))]
    return spark.createDataFrame(rows, "zone long, id long, x double, y double, value double")


def cov(d):
    return MODEL[2] * np.exp(-3 * d / MODEL[3])


def kriged(near, x, y):
    """Ordinary kriging: weights and variance."""
    xy = np.array([(p[0], p[1]) for p in near])
    n = len(near)
    a, b = np.ones((n + 1, n + 1)), np.ones(n + 1)
    a[:n, :n] = cov(np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)))
    a[n, n] = 0
    b[:n] = cov(np.hypot(xy[:, 0] - x, xy[:, 1] - y))
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    return w[:n], max(MODEL[2] - w @ b, 0.0)


def normal(i, r, seed):
    u = [(int(hashlib.md5(f"{i}-{r}-{seed}-{k}".encode()).hexdigest()[:7], 16) + 0.5) / 2**28 for k in "ra"]
    return math.sqrt(-2 * math.log(u[0])) * math.cos(2 * math.pi * u[1])


def test_levels(spark):
    nodes = points(spark, 300).drop("value")
    placed, last = simulation.levels(nodes, 3)
    rows = placed.collect()
    count = np.bincount([r["level"] for r in rows], minlength=last + 1)
    assert len(rows) == 300 and count[0] == 2 and all(b > a for a, b in zip(count[:4], count[1:4])) and count[-1] < 60
    early = [r for r in rows if r["zone"] == 0 and r["level"] <= 2]
    assert {(r["x"] > 0, r["y"] > 0) for r in early} == {(a, b) for a in (False, True) for b in (False, True)}


def test_against_a_loop(spark):
    pts, k, seed = points(spark, 160), 6, 7
    got = {(r["zone"], r["realisation"], r["id"]): r["value"] for r in simulation.simulate(pts, MODEL, k, 0.1, 3, seed).collect()}
    level = {r["id"]: r["level"] for r in simulation.levels(pts.where("value is null").drop("value"), seed)[0].collect()}
    rows = pts.collect()
    assert len(got) == 3 * 160
    for run in (1, 2, 3):
        value = {r["id"]: r["value"] for r in rows if r["value"] is not None}
        order = sorted((r for r in rows if r["value"] is None), key=lambda r: level[r["id"]])
        for r in order:
            known = [p for p in rows if p["zone"] == r["zone"] and (p["value"] is not None or level[p["id"]] < level[r["id"]])]
            near = sorted(known, key=lambda p: ((p["x"] - r["x"]) ** 2 + (p["y"] - r["y"]) ** 2, p["id"]))[:k]
            w, var = kriged([(p["x"], p["y"]) for p in near], r["x"], r["y"])
            value[r["id"]] = min(max(sum(a * value[p["id"]] for a, p in zip(w, near)) + math.sqrt(var) * normal(r["id"], run, seed), 0.0), 1.0)
        for r in rows:
            assert got[r["zone"], run, r["id"]] == pytest.approx(value[r["id"]], abs=1e-7)


def test_partitions_do_not_matter(spark):
    pts = points(spark, 120)
    found = []
    for n in (4, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, simulation.simulate(pts.repartition(n), MODEL, 5, 0.2, 2, 3).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]


def test_conditional_mean_and_variance(spark):
    rows = [(1, 0, 0.0, 0.0, 1.0), (1, 1, 0.3, 0.0, -1.0), (1, 2, 0.0, 0.4, 0.5), (1, 3, 0.1, 0.1, None), (1, 4, 0.12, 0.3, None)]
    pts = spark.createDataFrame(rows, "zone long, id long, x double, y double, value double")
    many = simulation.simulate(pts, MODEL, 4, 0.2, 4000, 11, None, None).where("id > 2")
    got = {r["id"]: (r["m"], r["v"]) for r in many.groupBy("id").agg(F.avg("value").alias("m"), F.variance("value").alias("v")).collect()}
    for i, x, y in ((3, 0.1, 0.1), (4, 0.12, 0.3)):  # given the data alone, whichever node comes first
        w, var = kriged([r[2:4] for r in rows[:3]], x, y)
        assert got[i][0] == pytest.approx(float(w @ [1.0, -1.0, 0.5]), abs=4 * math.sqrt(var / 4000) + 0.02) and got[i][1] == pytest.approx(var, rel=0.12)
    held = simulation.simulate(pts, MODEL, 4, 0.2, 50, 11).where("id > 2").agg(F.min("value"), F.max("value")).first()
    assert tuple(held) == (0.0, 1.0)


def test_zone_without_data_and_nothing_to_do(spark):
    with pytest.raises(ValueError, match="without data: \\[9\\]"):
        simulation.simulate(spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0), (9, 2, 0.0, 0.0, None)], "zone long, id long, x double, y double, value double"), MODEL, 2, 1.0, 1)
    only = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0)], "zone long, id long, x double, y double, value double")
    assert [tuple(r) for r in simulation.simulate(only, MODEL, 2, 1.0, 2).orderBy("realisation").collect()] == [(1, 1, 1, 1.0), (1, 2, 1, 1.0)]
