"""Leading eigenvectors and the embedding against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrostrata.operators import spatial, spectral


def blobs(n, seed):
    rng = np.random.default_rng(seed)
    centres = np.array([(0, 0), (1.6, 0.2), (0.4, 1.8)])
    return [(int(i), *map(float, centres[i % 3] + rng.normal(0, 0.35, 2))) for i in range(n)]


def dense(edges, ids):
    a = np.zeros((len(ids), len(ids)))
    for r in edges.collect():
        a[ids.index(r["a"]), ids.index(r["b"])] += r["w"]
    return a


def test_embedding_against_numpy(spark):
    pts = spark.createDataFrame(blobs(150, 3), "pid long, px double, py double")
    q = pts.select(F.col("pid").alias("qid"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    edges = spectral.neighbour_affinity(spatial.knn(q, pts, 15, 0.3))
    ids = list(range(150))
    a = dense(edges, ids)
    near = {(r["qid"], r["pid"]) for r in spatial.knn(q, pts, 15, 0.3).collect()}
    assert np.array_equal(a, [[1.0 if i == j else 0.5 * ((i, j) in near) + 0.5 * ((j, i) in near) for j in ids] for i in ids])
    degree = a.sum(axis=1)
    values, vectors = np.linalg.eigh(a / np.sqrt(degree[:, None] * degree))
    got, found = spectral.spectral_embedding(edges, 3)
    assert got == pytest.approx(values[::-1][:3], abs=1e-10)
    rows = np.array([r["vector"] for r in found.orderBy("id").collect()]) * np.sqrt(degree)[:, None]
    for k in range(3):
        want = vectors[:, -1 - k]
        want = want * np.sign(want[np.abs(want).round(9).argmax()])
        assert np.abs(rows[:, k] - want).max() < 1e-6


def test_equal_values_and_small_matrices(spark):
    edges = spark.createDataFrame([(i, j, 1.0) for g in range(3) for i in range(4 * g, 4 * g + 4) for j in range(4 * g, 4 * g + 4)], "a long, b long, w double")
    values, found = spectral.leading_vectors(spectral.normalised(edges)[0], 3)
    assert values == pytest.approx([1.0] * 3)
    rows = np.array([r["vector"] for r in found.orderBy("id").collect()])
    assert np.allclose(rows.T @ rows, np.eye(3)) and all(np.allclose(rows[k], rows[k - k % 4]) for k in range(12))
    with pytest.raises(ValueError, match="not settled"):
        spectral.leading_vectors(spark.createDataFrame([(i, (i + 1) % 60, 0.5) for i in range(60)] + [((i + 1) % 60, i, 0.5) for i in range(60)], "a long, b long, w double"), 2, steps=2)
