"""Hand-computed cases of the domain operators, sources and sinks, and the stream."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrostrata.functions import numeric
from hydrostrata.operators import budget, interpolation, intervals, metrics, series, spatial, texture, weighting
from hydrostrata.sources import sinks, tables
from hydrostrata.streaming.soil_water import soil_water_stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_idw_by_hand(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 2.0, 0.0, 1.0)], "pid long, px double, py double, v double")
    targets = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 0.0)], "qid long, qx double, qy double")
    near = spatial.knn(targets, points.drop("v"), 2, 1.0)
    out = {r["qid"]: r["estimate"] for r in interpolation.apply_weights(interpolation.idw_weights(near), points, "v").collect()}
    assert out == {1: 0.5, 2: 0.0}


def test_kriging_by_hand(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 3.0), (2, 2.0, 0.0, 5.0)], "pid long, px double, py double, v double")
    targets = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 0.0)], "qid long, qx double, qy double")
    near = spatial.knn(targets, points.drop("v"), 2, 1.0)
    for weights in (interpolation.kriging_two(near, "spherical", 0.0, 1.0, 5.0), interpolation.kriging_weights(near, "spherical", 0.0, 1.0, 5.0)):
        out = {r["qid"]: r["estimate"] for r in interpolation.apply_weights(weights, points, "v").collect()}
        assert math.isclose(out[1], 4.0) and math.isclose(out[2], 3.0, abs_tol=1e-9)


def test_kriging_forms_agree(spark):
    rng = __import__("random").Random(1)
    points = spark.createDataFrame([(k, rng.random(), rng.random(), rng.random()) for k in range(60)], "pid long, px double, py double, v double")
    targets = spark.createDataFrame([(k, rng.random(), rng.random()) for k in range(20)], "qid long, qx double, qy double")
    near = spatial.knn(targets, points.drop("v"), 2, 0.2)
    a = {(r["qid"], r["pid"]): r["weight"] for r in interpolation.kriging_two(near, "exponential", 0.1, 0.9, 0.5).collect()}
    b = {(r["qid"], r["pid"]): r["weight"] for r in interpolation.kriging_weights(near, "exponential", 0.1, 0.9, 0.5).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_knn_far_away_and_few(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, 0.1, 0.0)], "pid long, px double, py double")
    targets = spark.createDataFrame([(1, 400.0, 0.0), (2, 0.0, 0.01)], "qid long, qx double, qy double")
    for k in (1, 2, 5):
        got = {(r["qid"], r["rank"]): r["pid"] for r in spatial.knn(targets, points, k, 1.0).collect()}
        want = {1: [3, 1, 2], 2: [1, 3, 2]}
        assert got == {(q, n + 1): p for q, ps in want.items() for n, p in enumerate(ps[:k])}


def test_intervals(spark):
    one = lambda rows: spark.createDataFrame(rows, "k int, top double, bot double")
    pairs = lambda a, b, w: sorted((r["top_a"], r["top_b"], r["thickness"]) for r in intervals.overlap_join(one(a), one(b), ["k"], w).collect())
    for width in (None, 2.5):
        assert pairs([(1, 0.0, 5.0)], [(1, 5.0, 8.0)], width) == []
        assert pairs([(1, 8.0, 9.0)], [(1, 5.0, 8.0)], width) == [(8.0, 5.0, 0.0)]
        assert pairs([(1, 0.0, 10.0)], [(1, 2.0, 4.0), (1, 9.0, 20.0), (2, 0.0, 9.0)], width) == [(0.0, 2.0, 2.0), (0.0, 9.0, 1.0)]
    parts = [(r["part"], round(r["mid"], 3)) for r in intervals.split(one([(1, 0.0, 10.0)]), 4.0).collect()]
    assert parts == [(1, 1.667), (2, 5.0), (3, 8.333)]
    layers = spark.createDataFrame([(1, 0.0, 8.0)], "layer int, top double, bot double")
    logs = spark.createDataFrame([(1, 0.0, 4.0, 1.0), (1, 4.0, 10.0, 0.0), (1, 0.0, 8.0, -1.0)], "well int, top double, bot double, v double")
    assert intervals.upscale(logs, layers, ["well"], ["v"]).first()["v"] == 0.5


def test_weights(spark):
    groups = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("z", 0.0)], "g string, w double")
    got = sorted(r["balanced"] for r in weighting.balance(groups, "g", "w", {"a": 8.0, "z": 5.0}).collect())
    assert got == [0.0, 2.0, 6.0]
    flows = spark.createDataFrame([(10.0,)], "v double")
    assert math.isclose(weighting.flow_cv(flows, "v", [0.4, 0.8], [0.1, 0.2, 0.5]).first()["weight"], 1.0)


def test_budget(spark):
    day = dt.date(2020, 1, 1)
    rows = spark.createDataFrame([(1, day, 0.02, 0.0, 0.01)], "field long, day date, precip double, irr double, pet double")
    for f in (budget.soil_water, budget.soil_water_groups):
        r = f(rows, "field", "day", 0.105, 0.10).first()
        assert all(math.isclose(r[k], v, abs_tol=1e-12) for k, v in (("aet", 0.01), ("recharge", 0.005), ("swc", 0.105)))
    demand = spark.createDataFrame([(1, k, d, 10.0) for k, d in enumerate((6.0, 6.0, 1.0))], "s int, k int, d double, a double")
    assert [r["surface_water"] for r in budget.allocate(demand, ["s"], ["k"], "d", "a").orderBy("k").collect()] == [6.0, 4.0, 0.0]


def test_texture(spark):
    curves = [texture.ClassCurve("Fine", 0.3, 0.0, 30.0), texture.ClassCurve("Coarse", 0.5, 0.0, 300.0)]
    share = lambda rho: value(spark, texture.class_shares(F.lit(rho), curves))
    assert share(20.0) == [1.0, 0.0] and share(400.0) == [0.0, 1.0]
    mid = share(120.0)
    assert math.isclose(sum(mid), 1.0) and all(0 <= x <= 1 for x in mid)
    names = lambda xs: value(spark, texture.dominant(F.array(*map(F.lit, xs)), ["a", "b", "c"]))
    assert names([0.5, 0.5, 0.0]) == "TIE" and names([0.6, 0.4, 0.0]) == "a"
    params = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("b", 3.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "class string, kmin double, dk double, kd double, ss double, sy double, aniso double")
    cells = spark.createDataFrame([(1, "a", 0.5, 0.0), (1, "b", 0.5, 0.0)], "cell int, class string, fraction double, depth double")
    assert math.isclose(texture.block_parameters(cells, params, ["cell"], 1.0).first()["kh"], 2.0)
    assert math.isclose(texture.block_parameters(cells, params, ["cell"], -1.0).first()["kh"], 1.5)


@pytest.mark.parametrize("x", [-14.0, -3.0, -1.0, 0.0, 0.5, 1.28, 1.3, 4.0, 9.0])
def test_normal_cdf(spark, x):
    assert math.isclose(value(spark, numeric.normal_cdf(F.lit(x))), 0.5 * math.erfc(-x / math.sqrt(2)), rel_tol=1e-6, abs_tol=1e-9)


def test_skill_of_a_perfect_model(spark):
    rows = spark.createDataFrame([(float(k), float(k)) for k in range(1, 9)], "obs double, sim double")
    r = metrics.skill(rows.withColumn("g", F.lit(1)), ["g"]).first()
    assert (r["me"], r["rmse"], r["nse"], r["pbias"]) == (0.0, 0.0, 1.0, 0.0) and math.isclose(r["kge"], 1.0)
    assert metrics.skill(rows.limit(3).withColumn("g", F.lit(1)), ["g"]).first()["nse"] is None


def test_gaps(spark):
    d = lambda k: dt.date(2020, 1, k)
    rows = spark.createDataFrame([(1, d(1), 0.0), (1, d(2), 1.0), (1, d(5), 4.0), (2, d(1), 9.0)], "k int, day date, v double")
    dense = series.densify(rows, ["k"], "day", "v")
    for f in (series.interpolate_gaps, series.pchip_gaps):
        got = [r["v"] for r in f(dense, ["k"], "day", "v").where("k = 1").orderBy("day").collect()]
        assert all(math.isclose(a, b) for a, b in zip(got, [0.0, 1.0, 2.0, 3.0, 4.0], strict=True))


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("comment\n/ LINE FID X\n1 1 9999\n\n1 2 5.5\n")
    rows = tables.headed_table(spark, f"file://{tmp_path}/a.xyz", 2).orderBy("line_no").collect()
    assert [(r["LINE"], r["FID"], r["X"]) for r in rows] == [(1.0, 1.0, None), (1.0, 2.0, 5.5)]
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.DoubleType())])
    (tmp_path / "b.txt").write_text("skip\n  1 2.5\n2 -999\n3 1\n")
    rows = tables.whitespace_table(spark, f"file://{tmp_path}/b.txt", schema, 1, 2, (-999.0,)).orderBy("line_no").collect()
    assert [(r["id"], r["v"]) for r in rows] == [(1, 2.5), (2, None)]
    (tmp_path / "c.json").write_text('{"1": [1.5, 2], "2": []}')
    assert [tuple(r) for r in tables.json_arrays(spark, f"file://{tmp_path}/c.json").collect()] == [("1", 0, 1.5), ("1", 1, 2.0)]
    (tmp_path / "s.sen").write_text("top\nGroup one\na 1\n\nGroup two\nb 2\nc 3\n")
    lines = tables.numbered_lines(spark, f"file://{tmp_path}/s.sen")
    got = [(r["section"], r["line"]) for r in tables.sections(lines, ["file"], "line_no", "line", r"^Group (\w+)").orderBy("line_no").collect()]
    assert got == [("one", "a 1"), ("two", "b 2"), ("two", "c 3")]
    (tmp_path / "z.arr").write_text("1 2\n3\n")
    assert [(r["node"], r["value"]) for r in tables.layered_array(spark, f"file://{tmp_path}/z.arr").orderBy("node").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0)]
    (tmp_path / "k.arr").write_text("CONSTANT 7\n")
    assert [(r["node"], r["value"]) for r in tables.layered_array(spark, f"file://{tmp_path}/k.arr").collect()] == [(0, 7.0)]


def test_sinks(spark, tmp_path):
    w = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5)], "qid long, pid long, weight double")
    sinks.write_weights(w, f"file://{tmp_path}/w")
    assert sorted(map(tuple, sinks.read_weights(spark, f"file://{tmp_path}/w").collect())) == [(1, 2, 0.5), (1, 3, 0.5)]
    with pytest.raises(ValueError):
        w.drop("pid").write.parquet(f"file://{tmp_path}/bad")
        sinks.read_weights(spark, f"file://{tmp_path}/bad")
    assert json.loads(sinks.json_dict(spark.createDataFrame([(1, 2, 2.0), (1, 1, 1.0)], "k int, o int, v double"), "k", "o", "v").first()["value"]) == {"1": [1.0, 2.0]}
    a = spark.createDataFrame([(1,), (2,)], "id int")
    assert sorted(r["id"] for r in sinks.sections_of_logs(a, a, "id").collect()) == [1, 2, 3, 4]
    days = spark.createDataFrame([(dt.date(2020, 1, 3), "a"), (dt.date(2020, 1, 10), "b")], "day date, name string")
    assert [r["value"] for r in sinks.instruction_lines(days, "day", "name", "2020-01-01").orderBy("day").collect()] == ["l2 !a!", "l7 !b!"]


def test_stream_equals_batch(spark, tmp_path):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    rows = [(f, day(k), 0.01 * ((k * 7 + f) % 5), 0.005, 0.02) for f in (1, 2) for k in range(10)]
    schema = "field long, day date, precip double, irr double, pet double"
    for part in (rows[:5] + rows[10:15], rows[5:10] + rows[15:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    drivers = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"file://{tmp_path}/in")
    q = soil_water_stream(drivers, 0.1, 0.05).writeStream.format("memory").queryName("soil").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["field"], r["day"], round(r["swc"], 12)) for r in spark.table("soil").collect())
    want = sorted((r["field"], r["day"], round(r["swc"], 12)) for r in budget.soil_water(spark.createDataFrame(rows, schema), "field", "day", 0.1, 0.05).collect())
    assert got == want


def test_knn_dense_and_empty(spark):
    """Points in one spot, far clusters on both sides of zero, and no points at all."""
    import random

    rng = random.Random(4)
    xy = [(0.001 * rng.random(), 0.001 * rng.random()) for _ in range(300)] + [(-50 + rng.random(), 70 * rng.random()) for _ in range(40)]
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(xy)], "pid long, px double, py double")
    asked = [(k, x, y) for k, (x, y) in enumerate([(0.0005, 0.0005), (-0.2, 0.0), (-49.5, 30.0), (900.0, -900.0), (-25.0, 0.0)])]
    targets = spark.createDataFrame(asked, "qid long, qx double, qy double")
    got = {(r["qid"], r["rank"]): r["pid"] for r in spatial.knn(targets, points, 6, 0.01).collect()}
    for q, x, y in asked:
        near = sorted(range(len(xy)), key=lambda k: ((x - xy[k][0]) * (x - xy[k][0]) + (y - xy[k][1]) * (y - xy[k][1]), k))[:6]
        assert [got[q, n + 1] for n in range(6)] == near
    assert spatial.knn(targets, points.limit(0), 3, 1.0).count() == 0


def test_kriging_batches(spark):
    """Systems of several sizes, a singular one, and corrected weights."""
    import numpy as np

    pts = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0), (4, 1.0, 1.0), (5, 1.0, 1.0)]
    points = spark.createDataFrame(pts, "pid long, px double, py double")
    targets = spark.createDataFrame([(1, 0.3, 0.2), (2, 0.9, 0.9)], "qid long, qx double, qy double")
    near = spatial.knn(targets, points, 3, 1.0).where("qid = 1").unionByName(spatial.knn(targets, points, 5, 1.0).where("qid = 2"))
    got = {}
    for r in interpolation.kriging_weights(near, "exponential", 0.0, 1.0, 2.0).collect():
        got.setdefault(r["qid"], {})[r["pid"]] = r["weight"]
    xy = np.array([p[1:] for p in pts[:3]])
    c = lambda d: np.exp(-1.5 * d)
    a = np.ones((4, 4))
    a[:3, :3], a[3, 3] = c(np.linalg.norm(xy[:, None] - xy[None], axis=2)), 0
    want = np.linalg.solve(a, np.append(c(np.linalg.norm(xy - [0.3, 0.2], axis=1)), 1))[:3]
    assert [got[1][k] for k in (1, 2, 3)] == pytest.approx(want.tolist())
    assert sum(got[2].values()) == pytest.approx(1) and got[2][4] == pytest.approx(got[2][5])


def test_silhouette_and_breaks(spark):
    from hydrostrata.operators import learning

    rows = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0), (3, 1, 10.0), (4, 2, 30.0)], "id long, c int, x double")
    got = {r["id"]: r["silhouette"] for r in learning.silhouette(rows, "id", "c", ["x"]).collect()}
    assert got[1] == pytest.approx((100 - 1) / 100) and got[4] == 0.0
    cut = learning.natural_breaks(spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 9.0, 10.0, 30.0)], "v double"), "v", 3)
    assert [r["upper"] for r in cut.orderBy("class").collect()] == [2.0, 10.0, 30.0]
    with pytest.raises(ValueError):
        learning.natural_breaks(spark.range(50).selectExpr("id * 1.0 v"), "v", 3, 10)


def test_bottom_scan_by_hand(spark):
    def scan(labels, start, bedrock=3.0, doi=-100.0):
        rows = [(1, k + 1, x, -k - 0.5, -k - 1.0) for k, x in enumerate(labels)]
        starts = spark.createDataFrame([(1, start, doi)], "w int, start double, doi double")
        r = intervals.bottom_scan(spark.createDataFrame(rows, "w int, point int, label string, mid double, bot double"), starts, ["w"], ["R"], bedrock).first()
        return r["pid"], r["bottom"]

    assert scan("AAARA", -0.5) == (3, -3.0)  # down to the last pixel above the bottom class
    assert scan("AAAAA", -0.5) == (4, -4.0)  # none: the pixel above the last one
    assert scan("AARRRRRR", -5.5) == (2, -2.0)  # rock for long: up and out of it
    assert scan("RRRRRRR", -4.5) == (1, None)  # up to the first pixel, which does not count
    assert scan("AARRAAAA", -3.5) == (3, -3.0)  # not rock for long: the pixel above
    assert scan("AAARA", -0.5, doi=-2.0) == (3, None)  # below the depth of investigation
    assert scan([None] * 4, -0.5) == (None, None)


def test_well_weights_need_their_wells(spark):
    rows = spark.createDataFrame([("a", dt.date(2020, 1, d), float(d)) for d in range(1, 6)] + [("b", dt.date(2020, 1, 1), 1.0)], "well string, day date, v double")
    cut = spark.createDataFrame([("a", dt.date(2020, 1, 3))], "well string, cutoff date")
    med = spark.createDataFrame([], "well string, width int, threshold double, low double")
    got = sorted((r["well"], r["day"].day, r["weight"]) for r in weighting.well_weights(rows, "well", "day", "v", cut, med).collect())
    assert got == [("a", 1, 0.2), ("a", 2, 0.2), ("a", 3, 0.2), ("a", 4, 0.0), ("a", 5, 0.0), ("b", 1, 0.0)]
    with pytest.raises(ValueError):
        weighting.well_weights(rows, "well", "day", "v", cut.unionByName(spark.createDataFrame([("z", dt.date(2020, 1, 1))], "well string, cutoff date")), med)


def test_lines_of_split_files(spark, tmp_path):
    """Lines keep their numbers where a file is read in several splits; arrays are numbered by file."""
    (tmp_path / "t").mkdir()
    for name, n in (("a.txt", 4000), ("b.txt", 10)):
        (tmp_path / "t" / name).write_text("".join(f"{name} {k}\r\n" if k % 3 else f"{name} {k}\n" for k in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = tables.numbered_lines(spark, f"file://{tmp_path}/t").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 4010 and all(r["line"] == f"{r['file'].rsplit('/', 1)[1]} {r['line_no']}" for r in rows)
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "x.arr").write_text("1 2\n\n3\n")
    (tmp_path / "u" / "y.arr").write_text("4\n5 6\n")
    got = sorted((r["file"][-5], r["node"], r["value"]) for r in tables.layered_array(spark, f"file://{tmp_path}/u").collect())
    assert got == [("x", 1, 1.0), ("x", 2, 2.0), ("x", 3, 3.0), ("y", 1, 4.0), ("y", 2, 5.0), ("y", 3, 6.0)]


def test_geometric_block_mean(spark):
    params = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("b", 4.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "class string, kmin double, dk double, kd double, ss double, sy double, aniso double")
    f = spark.createDataFrame([(1, "a", 0.5, 0.0), (1, "b", 0.5, 0.0)], "cell int, class string, fraction double, depth double")
    assert texture.block_parameters(f, params, ["cell"], 0.0).first()["kh"] == pytest.approx(2.0)


def test_quantiles_by_passes(spark, monkeypatch):
    """Exact also where values must be counted in bins of bins: heavy ties, outliers, nulls."""
    import random

    import numpy as np

    from hydrostrata.operators import quantiles

    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [7.0] * 500 + [1e9, -1e9, 7.000001]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    shares = [0.0, 0.05, 0.4, 0.8, 0.95, 1.0]
    for most in (quantiles.MOST, 8):
        monkeypatch.setattr(quantiles, "MOST", most)
        assert quantiles.quantiles(df, "x", shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    assert quantiles.quantiles(df.limit(0), "x", [0.5]) == [None]


def test_density_clusters(spark):
    pts = [(k, 0.1 * k, 0.0) for k in range(1, 30)] + [(40, 3.0, 0.1), (50, 9.0, 9.0), (60, 20.0, 0.0), (61, 20.05, 0.0), (62, 20.1, 0.0)]
    got = {r["pid"]: (r["cluster"], r["core"]) for r in spatial.density_clusters(spark.createDataFrame(pts, "pid long, px double, py double"), 0.11, 3).collect()}
    assert {got[k][0] for k in range(1, 30)} == {0} and not got[1][1] and got[2][1]
    assert got[40] == (2, False) and got[50] == (2, False) and got[61] == (1, True) and got[60][0] == 1


def test_duration_curve_by_ranges(spark):
    """Ranks over many ranges: ties by the key, groups that are null, one large group, no rows."""
    rows = [(k, None if k % 50 == 0 else "a" if k % 3 else "b", float(k % 7) if k % 11 else None) for k in range(1, 600)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    got = {r["k"]: r["exceedance"] for r in series.duration_curve(df, ["g"], "v", ["k"]).collect()}
    for g in (None, "a", "b"):
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert all(got[r[0]] == pytest.approx((n + 1) / len(order)) for n, r in enumerate(order))
    assert len(got) == 599 and series.duration_curve(df.limit(0), ["g"], "v", ["k"]).count() == 0


def test_pchip_short_series(spark):
    """One known value fills nothing, two a straight line; ends stay null."""
    day = lambda k: dt.date(2020, 1, k)
    rows = [("one", day(1), None), ("one", day(2), 4.0), ("one", day(3), None), ("two", day(1), 1.0), ("two", day(2), None), ("two", day(3), 5.0), ("two", day(4), None), ("none", day(1), None)]
    got = {(r["s"], r["d"].day): r["v"] for r in series.pchip_gaps(spark.createDataFrame(rows, "s string, d date, v double"), ["s"], "d", "v").collect()}
    assert got == {("one", 1): None, ("one", 2): 4.0, ("one", 3): None, ("two", 1): 1.0, ("two", 2): 3.0, ("two", 3): 5.0, ("two", 4): None, ("none", 1): None}


def test_prototypes_until_none_moves(spark):
    from hydrostrata.operators import learning

    rows = [(k, float(k % 5) + (20.0 if k > 30 else 0.0), "u" if k % 4 else "w") for k in range(60)]
    got = {r["k"]: r["cluster"] for r in learning.k_prototypes(spark.createDataFrame(rows, "k long, x double, c string"), "k", ["x"], ["c"], [(0.0, "w"), (5.0, "w")], 0.5).collect()}
    assert all(got[k] == (1 if k > 30 else 0) for k in got) and len(got) == 60


def test_cached_and_observation_lists(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/kept"
    assert [tables.cached(spark, path, compute).count() for _ in range(2)] == [3, 3] and calls == [1]
    for name, text in (("a.obf", " h1  1.5\nh2 2e1\n"), ("b.obf", "h3\t-3\n")):
        (tmp_path / name).write_text(text)
    lists = tables.observation_lists(spark, [f"file://{tmp_path}/a.obf", f"file://{tmp_path}/b.obf"])
    assert sorted((r["name"], r["sim"]) for r in lists.collect()) == [("h1", 1.5), ("h2", 20.0), ("h3", -3.0)]


def test_density_clusters_of_dense_points(spark, monkeypatch):
    from hydrostrata.operators import graph

    rng = random.Random(5)
    spots = [(rng.gauss(c, 0.03), rng.gauss(0, 0.03)) for c in (0, 0.5) for _ in range(250)] + [(rng.uniform(-0.3, 0.9), rng.uniform(-0.3, 0.3)) for _ in range(100)] + [(round(rng.uniform(-1, -0.4), 1), 0.0) for _ in range(30)]
    spots += spots[:40] + [(float("nan"), 0.0), (float("inf"), 0.0), (None, 1.0)]
    pts = [(k, *s) for k, s in zip(rng.sample(range(5000), len(spots)), spots, strict=True)]
    sizes, kept = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (out := kept(df), sizes.append(out.count()))[0])
    for radius, least in ((0.05, 4), (0.1, 20)):
        good = {i: (x, y) for i, x, y in pts if x is not None and math.isfinite(x)}
        close = {i: sorted(j for j, q in good.items() if (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) <= radius * radius) for i, p in good.items()}
        core = {i for i in close if len(close[i]) >= least}
        of = {}
        for i in sorted(core):
            stack = [] if i in of else [i]
            while stack:
                if (j := stack.pop()) not in of:
                    of[j] = i
                    stack += [b for b in close[j] if b in core]
        rank = {c: k for k, c in enumerate(sorted(set(of.values())))}
        want = {i: (rank[of[b]] if (b := i if i in core else next((b for b in close.get(i, []) if b in core), None)) is not None else len(rank), i in core) for i, *_ in pts}
        got = spatial.density_clusters(spark.createDataFrame(pts, "pid long, px double, py double"), radius, least)
        assert {r["pid"]: (r["cluster"], r["core"]) for r in got.collect()} == want
        pairs = sum(map(len, close.values()))
        assert max(sizes) < 4 * len(pts) < pairs


def test_global_statistics_ship_no_distinct_values(spark, sf_dir):
    from hydrostrata.plans import series_queries

    plan = series_queries.global_statistics(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_logs_are_dealt_by_rows_once(spark, sf_dir, monkeypatch):
    from hydrostrata.plans.registry import QUERIES

    wells = spark.createDataFrame([(k // 7, float(k)) for k in range(700)], "well long, v double")
    monkeypatch.setattr(intervals, "ROWS", 50, raising=False)
    tasks = intervals.dealt(wells, ["well"]).select("well", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 100 and len({r["task"] for r in tasks}) > 8  # a key is in one task, and tasks are more than the cores
    assert intervals.dealt(wells, ["well"]).rdd.getNumPartitions() == 14
    monkeypatch.setattr(intervals, "ROWS", 500)
    plan = QUERIES["class_thickness"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan  # windows, join and groups need no further shuffle, whose partitions Spark would join by bytes
