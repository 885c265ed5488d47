"""Simple kriging from all points against a direct solve."""

import time

import numpy as np
import pytest

from hydrostrata.operators import global_kriging

COV = {
    "spherical": lambda h: np.where(h < 1, 1 - 1.5 * h + 0.5 * h**3, 0.0),
    "exponential": lambda h: np.exp(-3 * h),
    "gaussian": lambda h: np.exp(-49 / 16 * h * h),
}


def frames(spark, n, m, seed=1):
    rng = np.random.default_rng(seed)
    xy, at = rng.uniform(0, 1, (n, 2)), rng.uniform(-0.1, 1.1, (m, 2))
    v = np.sin(5 * xy[:, 0]) + xy[:, 1] + rng.normal(0, 0.1, n)
    points = spark.createDataFrame([(i, *map(float, (*xy[i], v[i]))) for i in range(n)], "pid long, px double, py double, v double")
    targets = spark.createDataFrame([(i, *map(float, at[i])) for i in range(m)], "qid long, qx double, qy double")
    return xy, v, at, points, targets


def direct(xy, v, at, kind, nugget, sill, reach):
    apart = lambda a, b: np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    c = sill * COV[kind](apart(xy, xy) / reach) + nugget * (apart(xy, xy) < 1e-10)
    b = sill * COV[kind](apart(at, xy) / reach) + nugget * (apart(at, xy) < 1e-10)
    return v.mean() + b @ np.linalg.lstsq(c, v - v.mean(), rcond=None)[0]


@pytest.mark.parametrize("model", [("spherical", 0.7, 0.3, 0.12)])
def test_equals_the_direct_solve(spark, model):
    xy, v, at, points, targets = frames(spark, 900, 300)
    got = {r["qid"]: r["estimate"] for r in global_kriging.simple_kriging(targets, points, "v", *model, tolerance=1e-7).collect()}
    assert np.abs(np.array([got[i] for i in range(300)]) - direct(xy, v, at, *model)).max() < 1e-6


def test_small_and_odd_cases(spark):
    xy, v, at, points, targets = frames(spark, 60, 20)
    for model in (("gaussian", 0.05, 0.9, 0.3), ("exponential", 0.0, 1.0, 0.3)):
        got = {r["qid"]: r["estimate"] for r in global_kriging.simple_kriging(targets, points.repartition(5), "v", *model).collect()}
        assert np.allclose([got[i] for i in range(20)], direct(xy, v, at, *model), atol=1e-6)
    twice = points.unionByName(points.where("pid < 5").withColumn("pid", points.pid + 100))
    xy2, v2 = np.vstack([xy, xy[:5]]), np.concatenate([v, v[:5]])
    got = {r["qid"]: r["estimate"] for r in global_kriging.simple_kriging(targets, twice, "v", "spherical", 0.1, 0.9, 0.4).collect()}
    assert np.allclose([got[i] for i in range(20)], direct(xy2, v2, at, "spherical", 0.1, 0.9, 0.4), atol=1e-6)
    assert [r["estimate"] for r in global_kriging.simple_kriging(targets, points.where("false"), "v", "spherical", 0.1, 0.9, 0.4).collect()] == [None] * 20
    far = spark.createDataFrame([(1, 50.0, 50.0)], "qid long, qx double, qy double")
    assert global_kriging.simple_kriging(far, points, "v", "spherical", 0.1, 0.9, 0.4).first()["estimate"] == pytest.approx(v.mean())
    with pytest.raises(ValueError, match="after 0 rounds"):
        global_kriging.simple_kriging(targets, points, "v", "spherical", 0.1, 0.9, 0.4, rounds=0)


def test_many_points(spark):
    """20,000 points, four times what one matrix on a driver was allowed before."""
    _, _, _, points, targets = frames(spark, 20_000, 100)
    began = time.time()
    rows = global_kriging.simple_kriging(targets, points, "v", "spherical", 0.8, 0.2, 0.02, tolerance=1e-2).collect()
    at = {r["qid"]: np.sin(5 * r["qx"]) + r["qy"] for r in targets.where("least(qx, qy) > 0.05 and greatest(qx, qy) < 0.95").collect()}
    got = {r["qid"]: r["estimate"] for r in rows}
    assert len(rows) == 100 and len(at) > 40 and np.corrcoef([got[i] for i in at], list(at.values()))[0, 1] > 0.8  # drawn to the mean by the nugget
    assert time.time() - began < 200
