"""Fitted variograms against an independent search, and the layout of their block."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrostrata.operators import variogram
from hydrostrata.sources import sinks

RISE = {"spherical": lambda h: np.where(h < 1, 1.5 * h - 0.5 * h**3, 1.0), "exponential": lambda h: 1 - np.exp(-3 * h), "gaussian": lambda h: 1 - np.exp(-49 / 16 * h * h)}


def loss(kind, reach, d, g, w):
    """Least squares on the two free numbers by numpy, with the sides of the quarter plane tried one by one."""
    f, root = RISE[kind](d / reach), np.sqrt(w)
    tries = [np.linalg.lstsq(np.stack([root, root * f], 1), root * g, rcond=None)[0], np.array([g @ w / w.sum(), 0.0]), np.array([0.0, (w * f) @ g / ((w * f) @ f)])]
    return min((float(w @ (g - c[0] - c[1] * f) ** 2), tuple(c)) for c in tries if c.min() >= 0)


def golden(kind, d, g, w):
    """The least loss over the reach: a fine grid, then a golden section."""
    grid = np.geomspace(d[0] / 2, d[-1] * 10, 3000)
    k = int(np.argmin([loss(kind, r, d, g, w)[0] for r in grid]))
    a, b, s = grid[max(k - 1, 0)], grid[min(k + 1, 2999)], (5**0.5 - 1) / 2
    while b - a > 1e-10 * b:
        x, y = b - s * (b - a), a + s * (b - a)
        a, b = (a, y) if loss(kind, x, d, g, w)[0] < loss(kind, y, d, g, w)[0] else (x, b)
    return (a + b) / 2


@pytest.mark.parametrize("kind", sorted(RISE))
def test_reach_is_the_optimum(spark, kind):
    rng = np.random.default_rng(8)
    rows, own = [], {}
    for k, (nugget, sill, reach) in enumerate([(0.1, 0.9, 0.3), (0.0, 0.5, 0.1), (0.4, 0.2, 0.21)]):
        d, w = np.sort(rng.uniform(0.01, 0.5, 18)), rng.integers(5, 500, 18)
        g = nugget + sill * RISE[kind](d / reach) + rng.normal(0, 0.02, 18)
        rows += [(f"c{k}", float(a), float(b), int(n)) for a, b, n in zip(d, g, w)]
        own[f"c{k}"] = (d, g, w.astype(float))
    bins = spark.createDataFrame(rows, "class string, distance double, gamma double, pairs long").repartition(3)
    for weights, weigh in (("pairs", lambda d, w: w), ("pairs_by_distance", lambda d, w: w / d**2), ("equal", lambda d, w: np.ones_like(w))):
        fits = variogram.fit_variogram(bins, kind, ["class"], weights).collect()
        assert len(fits) == 3
        for r in fits:
            d, g, w = own[r["class"]]
            w = weigh(d, w)
            best = golden(kind, d, g, w)
            assert r["reach"] == pytest.approx(best, rel=1e-6)
            left, (nugget, sill) = loss(kind, best, d, g, w)
            assert (r["nugget"], r["sill"]) == (pytest.approx(nugget, abs=1e-6), pytest.approx(sill, rel=1e-5))
            mean = g @ w / w.sum()
            assert r["r2"] == pytest.approx(1 - left / (w @ (g - mean) ** 2), abs=1e-9)
            assert r["scale"] == pytest.approx(r["reach"] * {"spherical": 1, "exponential": 1 / 3, "gaussian": 4 / 7}[kind]) and not r["at_bound"]


def test_flat_and_short_variograms(spark):
    rows = [("flat", 0.1 * k, 2.0, 10) for k in range(1, 8)] + [("falls", 0.1 * k, 3.0 - 0.2 * k, 10 + k) for k in range(1, 8)] + [("one", 0.3, 1.0, 4)]
    rows += [("zero", 0.1 * k, 0.0, 3) for k in range(1, 4)] + [("line", 0.1 * k, 0.1 * k, 5) for k in range(1, 9)] + [("none", 0.0, 1.0, 5), ("none", 0.1, None, 5), ("none", 0.2, 1.0, 0)]
    bins = spark.createDataFrame(rows, "class string, distance double, gamma double, pairs long")
    got = {r["class"]: r for r in variogram.fit_variogram(bins, "spherical", ["class"]).collect()}
    assert sorted(got) == ["falls", "flat", "line", "one", "zero"]
    for name, mean in (("flat", 2.0), ("one", 1.0), ("zero", 0.0), ("falls", sum((3 - 0.2 * k) * (10 + k) for k in range(1, 8)) / sum(10 + k for k in range(1, 8)))):
        r = got[name]
        assert (r["reach"], r["scale"], r["sill"], r["r2"], r["at_bound"]) == (None, None, 0.0, 0.0, False) and r["nugget"] == pytest.approx(mean)
    assert got["line"]["at_bound"] and got["line"]["reach"] == pytest.approx(8.0)  # no reach is long enough
    bounded = variogram.fit_variogram(bins.where("class = 'line'"), "spherical", [], "equal", 0.2, 0.9).first()
    assert bounded["at_bound"] and bounded["reach"] == pytest.approx(0.9)
    assert variogram.fit_variogram(bins.where("false"), "spherical", ["class"]).count() == 0


def test_line_and_anisotropy(spark):
    fits = spark.createDataFrame([("a", 0.4, 0.1, 0.9), ("b", None, 2.0, 0.0), ("c", 0.1, 0.0, 1.0)], "direction string, reach double, nugget double, sill double")
    line = {(r["direction"], r["step"]): r["gamma"] for r in variogram.variogram_line(fits, "spherical", 0.8, 4).collect()}
    assert line["a", 1] == pytest.approx(0.1 + 0.9 * (0.75 - 0.0625)) and line["a", 4] == pytest.approx(1.0) and line["b", 2] == 2.0
    ratios = {r["direction"]: r["ratio"] for r in variogram.anisotropy(fits, [], "direction", "a").collect()}
    assert ratios == {"a": 1.0, "b": None, "c": pytest.approx(0.25)}


def test_block_layout(spark):
    models = spark.createDataFrame([("Fine", 1, "Exp", 0.0, 0.1, 2000.0, 2000.0, 0.0, 300), ("Sand", 1, "Sph", 0.0125, 0.25, 15000.0, 30000.0, 45.0, 16), ("Sand", 2, "Exp", 0.0, 1.0, 1.0, 2.0, 0.0, 16)], "class string, structure int, kind string, nugget double, sill double, range_min double, range_max double, angle double, nnear int")
    rows = sinks.variogram_lines(models).orderBy("part", F.col("class"), "structure").collect()
    assert "\n".join(r["value"] for r in rows).split("\n") == [
        "BEGIN VARIOGRAMS", "  # Structure Vtype  Nugget  Sill  Range_min Range_max ang1  nnear",
        "  CLASS Fine", "           1    Exp    0.000   0.100    2.00E+03       2.00E+03  0.0    300",
        "  CLASS Sand", "           1    Sph    0.013   0.250    1.50E+04       3.00E+04  45.0    16", "           2    Exp    0.000   1.000    1.00E+00       2.00E+00  0.0    16",
        "END VARIOGRAMS",
    ]


def test_pairs_are_summed_in_tasks(spark, monkeypatch):
    from hydrostrata.operators import interpolation

    monkeypatch.setattr(interpolation, "BLOCK", 40, raising=False)
    rng = np.random.default_rng(6)
    rows = [(k, float(x), float(y), None if k % 17 == 0 else float(v)) for k, (x, y, v) in enumerate(rng.normal(0, 0.2, (300, 3)))]
    rows += [(300, rows[1][1], rows[1][2], 4.0), (301, None, 0.0, 1.0), (302, float("nan"), 0.0, 1.0)]
    df = spark.createDataFrame(rows, "pid long, px double, py double, v double")
    for azimuth in (None, 90.0):
        out = interpolation.empirical_variogram(df, "v", 0.03, 5) if azimuth is None else interpolation.directional_variogram(df, "v", 0.03, 5, azimuth, 30.0)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" in plan and "d2" not in plan  # blocks of points meet, pairs are no rows
        bins = {}
        for i, x, y, v in rows[:301]:
            for j, p, q, u in rows[:i]:
                h = math.sqrt((x - p) * (x - p) + (y - q) * (y - q))
                if h * h <= 0.15 * 0.15 and int(h / 0.03) < 5 and (azimuth is None or (h > 0 and abs(x - p) >= h * math.cos(math.radians(30)))):
                    bins.setdefault(int(h / 0.03), []).append((h, None if None in (u, v) else (u - v) ** 2))
        got = {r["bin"]: (r["pairs"], r["distance"], r["gamma"]) for r in out.collect()}
        assert set(got) == set(bins)
        for b, own in bins.items():
            squares = [s for _, s in own if s is not None]
            assert got[b][0] == len(own) and np.allclose(got[b][1:], (np.mean([h for h, _ in own]), np.mean(squares) / 2))


def _pairs(rows, lag, bins):
    """(bin, h, dx, dy, squares: None where a value is missing) of all pairs in reach."""
    for i, (_, x, y, *v) in enumerate(rows):
        for _, p, q, *u in rows[:i]:
            h = math.sqrt((x - p) * (x - p) + (y - q) * (y - q))
            if h * h <= (lag * bins) ** 2 and int(h / lag) < bins:
                yield int(h / lag), h, x - p, y - q, [None if None in (a, b) else (a - b) ** 2 for a, b in zip(u, v)]


def _some_points(spark, monkeypatch):
    """Points of many small tiles, some at one place, some without a value."""
    from hydrostrata.operators import interpolation

    monkeypatch.setattr(interpolation, "BLOCK", 50)
    monkeypatch.setattr(interpolation, "TILE", 128)
    rng = np.random.default_rng(3)
    rows = [(k, float(x), float(y), None if k % 11 == 0 else float(v), float(w)) for k, (x, y, v, w) in enumerate(rng.normal(0, 0.15, (220, 4)))]
    rows += [(300 + k, rows[k][1], rows[k][2], 1.0, 2.0) for k in range(5)]
    return interpolation, rows, spark.createDataFrame(rows, "pid long, px double, py double, v double, w double")


def test_tiles_of_blocks_in_order(spark, monkeypatch):
    interpolation, rows, df = _some_points(spark, monkeypatch)
    got = {(r["value"], r["bin"]): (r["pairs"], r["distance"], r["gamma"]) for r in interpolation.empirical_variograms(df, ["v", "w"], 0.03, 6).collect()}
    pairs = list(_pairs(rows, 0.03, 6))
    assert len(got) == 12
    for k, name in enumerate(("v", "w")):
        for b in range(6):
            own = [p for p in pairs if p[0] == b]
            squares = [p[4][k] for p in own if p[4][k] is not None]
            assert got[name, b][0] == len(own) and np.allclose(got[name, b][1:], (np.mean([p[1] for p in own]), np.mean(squares) / 2))


def test_tiles_by_direction(spark, monkeypatch):
    interpolation, rows, df = _some_points(spark, monkeypatch)
    got = {(r["direction"], r["bin"]): (r["pairs"], r["distance"], r["gamma"]) for r in interpolation.directional_variograms(df, "v", 0.03, 6, {"north": 0.0, "east": 90.0}, 30.0).collect()}
    pairs, seen = list(_pairs(rows, 0.03, 6)), set()
    for name, along in (("north", 3), ("east", 2)):
        for b in range(6):
            own = [p for p in pairs if p[0] == b and p[1] > 0 and abs(p[along]) >= p[1] * math.cos(math.radians(30))]
            squares = [p[4][0] for p in own if p[4][0] is not None]
            seen |= {(name, b)} if own else set()
            assert not own or (got[name, b][0] == len(own) and np.allclose(got[name, b][1:], (np.mean([p[1] for p in own]), np.mean(squares) / 2)))
    assert set(got) == seen


def _block(rng, n, x0, y0, side, missing=0.0):
    there = rng.uniform(size=n) >= missing
    return {"x": np.sort(rng.uniform(x0, x0 + side, n)), "y": rng.uniform(y0, y0 + side, n), "v": np.where(there, rng.normal(3, 1, n), 0.0), "v_there": there}


def _both_ways(pairs, monkeypatch, one, two, same, ways):
    """The sums of two blocks by cells and point by point, and how many pairs each looked at."""
    out, seen = [], []
    tally = pairs.PairSums._tally
    monkeypatch.setattr(pairs.PairSums, "_tally", lambda self, group, code, dx, dy, d2, diffs: (seen.append(len(d2)), tally(self, group, code, dx, dy, d2, diffs)))
    for dense in (0, 1 << 60):
        monkeypatch.setattr(pairs, "DENSE", dense)
        sums = pairs.PairSums(["v"], 0.02, 10, ways, 1 << 12)
        sums.add(one, two, same)
        out.append((sums.frame().reset_index(drop=True), sum(seen)))
        seen.clear()
    monkeypatch.setattr(pairs.PairSums, "_tally", tally)
    return out


@pytest.mark.parametrize("ways", [[(0.0, 30.0), (90.0, 30.0)], [None], [None, *((20.0 * k, 15.0) for k in range(8))]])
def test_most_pairs_are_summed_by_cells(monkeypatch, ways):
    from hydrostrata.operators import pairs

    rng = np.random.default_rng(4)
    for one, two in ((_block(rng, 3000, 5.0, -2.0, 0.03), None), (_block(rng, 3000, 0, 0, 0.03, 0.1), _block(rng, 2500, 0.06, -0.03, 0.03, 0.2))):
        (got, few), (all_, many) = _both_ways(pairs, monkeypatch, one, two or one, two is None, ways)
        assert got[["way", "value", "bin", "n", "there"]].equals(all_[["way", "value", "bin", "n", "there"]])
        assert np.allclose(got["far"], all_["far"], rtol=1e-12, atol=0) and np.allclose(got["square"], all_["square"], rtol=1e-10, atol=0)
        assert 0 < few < (0.6 if two is None else 0.2) * many  # near pairs are looked at, as are those about the bounds


def test_cells_of_odd_blocks(monkeypatch):
    """A lattice whose distances lie on the bounds of bins and directions, copies, one value for all, a value far off, one not a number."""
    from hydrostrata.operators import pairs

    x, y = (k.ravel() for k in np.meshgrid(np.arange(40) * 0.001, np.arange(40) * 0.001, indexing="ij"))
    rng = np.random.default_rng(5)
    lattice = {"x": x, "y": y, "v": rng.normal(0, 1, 1600), "v_there": np.ones(1600, bool)}
    copies = {c: np.repeat(v[::40], 40) for c, v in lattice.items()}
    level, far, none = ({**lattice, "v": v.copy()} for v in (np.full(1600, 1.5), lattice["v"], lattice["v"]))
    far["v"][7], none["v"][7] = 1e12, np.nan
    for one in (lattice, copies, level, far, none):
        two = {**one, "x": one["x"] + 0.04}
        for other in (one, two):
            (got, _), (all_, _) = _both_ways(pairs, monkeypatch, one, other, other is one, [(0.0, 45.0), (90.0, 30.0)])
            assert got[["way", "bin", "n", "there"]].equals(all_[["way", "bin", "n", "there"]])
            assert np.allclose(got[["far", "square"]], all_[["far", "square"]], rtol=1e-10, atol=0, equal_nan=True)
    assert (_both_ways(pairs, monkeypatch, level, level, True, [None])[0][0]["square"] == 0).all()


def test_cells_in_tasks(spark):
    from hydrostrata.operators import interpolation

    rng = np.random.default_rng(7)
    x, y, v = rng.normal(0, 0.03, (3, 6000))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(zip(x, y, v))], "pid long, px double, py double, v double")
    got = {(r["direction"], r["bin"]): (r["pairs"], r["distance"], r["gamma"]) for r in interpolation.directional_variograms(df, "v", 0.02, 10, {"north": 0.0, "east": 90.0}, 30.0).collect()}
    for name, along in (("north", y), ("east", x)):
        n, far, square = np.zeros((3, 10))
        for i in range(1, 6000):
            dx, dy = x[i] - x[:i], y[i] - y[:i]
            h = np.sqrt(dx * dx + dy * dy)
            use = (h * h <= 0.2 * 0.2) & (np.abs(along[i] - along[:i]) >= h * math.cos(math.radians(30)))
            b, d = (h[use] / 0.02).astype(int), (v[i] - v[:i])[use]
            n, far, square = n + np.bincount(b, minlength=10)[:10], far + np.bincount(b, h[use], 10)[:10], square + np.bincount(b, d * d, 10)[:10]
        for b in range(10):
            assert got[name, b][0] == n[b] and np.allclose(got[name, b][1:], (far[b] / n[b], square[b] / n[b] / 2), rtol=1e-11)
