"""Interval, geometry, interpolation and texture queries on the carrier tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydrostrata.functions import numeric
from hydrostrata.operators import interpolation, intervals, relational, simulation, spatial, texture
from hydrostrata.operators.graph import shared_path
from hydrostrata.sources import shapefiles
from hydrostrata.sources.tables import regular_grid, table

from .series_queries import rounded

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_POINTS = "pts AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS v, label FROM embeddings)"
_PAIRS = _POINTS + ", d AS (SELECT q.pid AS qid, q.px AS qx, q.py AS qy, p.pid, p.px, p.py, p.v, (q.px - p.px) * (q.px - p.px) + (q.py - p.py) * (q.py - p.py) AS d2 FROM pts q JOIN pts p ON q.pid % 2 = 1 AND p.pid % 2 = 0)"
_NEAR = _PAIRS + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS rank FROM d)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), e(0).alias("px"), e(1).alias("py"), e(2).alias("v"), "label")


def _near(spark: SparkSession, d: str, k: int) -> DataFrame:
    p = _points(spark, d)
    return spatial.knn(p.where("pid % 2 = 1").select(F.col("pid").alias("qid"), F.col("px").alias("qx"), F.col("py").alias("qy")), p.where("pid % 2 = 0").select("pid", "px", "py"), k, 0.05)


@query(f"WITH {_NEAR} SELECT qid, pid, round(sqrt(d2), 8) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 5).select("qid", "pid", F.round(F.sqrt("d2"), 8).alias("dist"), "rank")


@query(f"WITH {_NEAR} SELECT qid, pid, round(sqrt(d2), 8) AS dist FROM r WHERE rank = 1 AND sqrt(d2) <= 0.02")
def nearest_join(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 1).where(F.sqrt("d2") <= 0.02).select("qid", "pid", F.round(F.sqrt("d2"), 8).alias("dist"))


@query(f"WITH {_PAIRS} SELECT qid, count(*) AS n, round(sqrt(max(d2)), 8) AS farthest FROM d WHERE d2 <= 0.05 * 0.05 GROUP BY qid")
def radius_count(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    pairs = spatial.within_radius(p.where("pid % 2 = 1").select(F.col("pid").alias("qid"), F.col("px").alias("qx"), F.col("py").alias("qy")), p.where("pid % 2 = 0").select("pid", "px", "py"), 0.05)
    return pairs.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sqrt(F.max("d2")), 8).alias("farthest"))


@query(f"WITH {_NEAR}, w AS (SELECT qid, v, CASE WHEN min(d2) OVER (PARTITION BY qid) = 0 THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d2 END AS w FROM r WHERE rank <= 8) SELECT qid, round(sum(w * v) / sum(w), 8) AS estimate FROM w GROUP BY qid")
def idw_predict(spark: SparkSession, d: str) -> DataFrame:
    return rounded(interpolation.apply_weights(interpolation.idw_weights(_near(spark, d, 8)), _points(spark, d), "v"), 8, "estimate")


_GRID = "g AS (SELECT CAST((r - 1) * 20 + c AS BIGINT) AS qid, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, -0.5 + (c - 0.5) * 0.05 AS qx, 0.5 - (r - 0.5) * 0.05 AS qy FROM range(1, 21) a(r), range(1, 21) b(c))"


@query(f"""WITH {_POINTS}, {_GRID}, d AS (SELECT row, col, v, pid, qid, (qx - px) * (qx - px) + (qy - py) * (qy - py) AS d2 FROM g, pts),
 w AS (SELECT row, col, v, 1 / d2 AS w FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS rank FROM d) WHERE rank <= 12)
SELECT row, col, round(sum(w * v) / sum(w), 7) AS estimate FROM w GROUP BY row, col""")
def geo_idw_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = regular_grid(spark, 20, 20, -0.5, 0.5, 0.05, 0.05).withColumn("qid", ((F.col("row") - 1) * 20 + F.col("col")).cast("long"))
    p = _points(spark, d)
    near = spatial.knn(grid.select("qid", F.col("x").alias("qx"), F.col("y").alias("qy")), p.select("pid", "px", "py"), 12, 0.1)
    out = interpolation.apply_weights(interpolation.idw_weights(near), p, "v")
    return out.join(grid.select("qid", "row", "col"), "qid").select("row", "col", F.round("estimate", 7).alias("estimate"))


_SPH = "CASE WHEN {d} < 0.2 THEN 0.9 * (1 - 1.5 * {d} / 0.2 + 0.5 * pow({d} / 0.2, 3)) ELSE 0 END + CASE WHEN {d} < 1e-10 THEN 0.1 ELSE 0 END"


@query(f"""WITH {_NEAR}, b AS (SELECT a.qid, sqrt(a.d2) AS d1, sqrt(c.d2) AS d2, sqrt((a.px - c.px) * (a.px - c.px) + (a.py - c.py) * (a.py - c.py)) AS d12, a.v AS v1, c.v AS v2 FROM r a JOIN r c ON a.qid = c.qid AND a.rank = 1 AND c.rank = 2),
 w AS (SELECT *, 0.5 + (({_SPH.format(d='d1')}) - ({_SPH.format(d='d2')})) / (2 * (1.0 - ({_SPH.format(d='d12')}))) AS w1 FROM b)
SELECT qid, round(w1 * v1 + (1 - w1) * v2, 7) AS estimate FROM w""")
def ok_krige_k2(spark: SparkSession, d: str) -> DataFrame:
    w = interpolation.kriging_two(_near(spark, d, 2), "spherical", 0.1, 0.9, 0.2)
    return rounded(interpolation.apply_weights(w, _points(spark, d), "v"), 7, "estimate")


@query()
def ok_krige_k8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(interpolation.apply_weights(interpolation.kriging_weights(_near(spark, d, 8), "spherical", 0.1, 0.9, 0.2), _points(spark, d), "v"), 7, "estimate")


@query()
def sk_krige(spark: SparkSession, d: str) -> DataFrame:
    return rounded(interpolation.simple_estimate(interpolation.kriging_weights(_near(spark, d, 8), "exponential", 0.1, 0.9, 0.2, False), _points(spark, d).where("pid % 2 = 0"), "v"), 7, "estimate")


@query()
def sgsim_realisations(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select(F.col("label").cast("long").alias("zone"), F.col("pid").alias("id"), F.col("px").alias("x"), F.col("py").alias("y"), F.when(F.col("pid") % 2 == 0, F.least(F.greatest(F.col("v") + 0.5, F.lit(0.0)), F.lit(1.0))).alias("value"))
    return simulation.simulate(p, ("exponential", 0.0, 0.05, 0.2), 8, 0.05, 2, 7)


@query(f"""WITH {_POINTS}, d AS (SELECT a.v - b.v AS dv, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS h FROM pts a JOIN pts b ON a.pid < b.pid)
SELECT CAST(floor(h / 0.02) AS INTEGER) AS bin, round(avg(dv * dv) / 2, 8) AS gamma, count(*) AS pairs, round(avg(h), 8) AS distance FROM d WHERE h < 0.2 GROUP BY 1""")
def emp_variogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(interpolation.empirical_variogram(_points(spark, d), "v", 0.02, 10), 8, "gamma", "distance")


@query(f"""WITH {_POINTS}, c AS (SELECT pid, floor((px + 0.3) / 0.1) + 1 AS c, floor((0.3 - py) / 0.1) + 1 AS r FROM pts)
SELECT pid, CAST(CASE WHEN c BETWEEN 1 AND 6 AND r BETWEEN 1 AND 6 THEN r END AS INTEGER) AS row, CAST(CASE WHEN c BETWEEN 1 AND 6 AND r BETWEEN 1 AND 6 THEN c END AS INTEGER) AS col FROM c""")
def cell_lookup(spark: SparkSession, d: str) -> DataFrame:
    return spatial.cell_lookup(_points(spark, d).select("pid", "px", "py"), "px", "py", -0.3, 0.3, 0.1, 0.1, 6, 6).select("pid", "row", "col")


_EDGES = "e AS (SELECT n_nationkey AS i, -0.25 + 0.5 * (n_nationkey * n_nationkey) / 625.0::DOUBLE AS low, -0.25 + 0.5 * ((n_nationkey + 1) * (n_nationkey + 1)) / 625.0::DOUBLE AS high FROM nation)"


@query(f"""WITH {_POINTS}, {_EDGES}, c AS (SELECT a.i * 25 + b.i AS cell, a.low AS xmin, a.high AS xmax, b.low AS ymin, b.high AS ymax FROM e a, e b WHERE a.i * b.i % 7 <> 1),
 d AS (SELECT pid, cell, px >= xmin AND px < xmax AND py >= ymin AND py < ymax AS inside, sqrt(greatest(0, xmin - px, px - xmax) * greatest(0, xmin - px, px - xmax) + greatest(0, ymin - py, py - ymax) * greatest(0, ymin - py, py - ymax)) AS dist FROM pts, c),
 r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY inside DESC, dist, cell) AS k FROM d WHERE inside OR dist < 0.02)
SELECT pts.pid, CAST(cell AS BIGINT) AS cell, round(dist, 8) AS dist FROM pts LEFT JOIN r ON r.pid = pts.pid AND k = 1""")
def irregular_cells(spark: SparkSession, d: str) -> DataFrame:
    edge = lambda i: F.lit(-0.25) + F.lit(0.5) * (i * i) / F.lit(625.0)
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    cells = n.withColumnRenamed("i", "j").crossJoin(n).where("j * i % 7 <> 1")  # 25 by 25 stated edges
    cells = cells.select((F.col("j") * 25 + F.col("i")).alias("cell"), edge(F.col("j")).alias("xmin"), edge(F.col("j") + 1).alias("xmax"), edge(F.col("i")).alias("ymin"), edge(F.col("i") + 1).alias("ymax"))
    return rounded(spatial.cells_of_points(_points(spark, d), cells, 0.02), 8, "dist")


@query(f"WITH {_POINTS} SELECT pid, px, py, v FROM pts")
def shapefile_points(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "points")
    shapefiles.write_shapefile(_points(spark, d).select(F.array(F.array(F.struct(F.col("px").alias("x"), F.col("py").alias("y")))).alias("parts"), "pid", "v"), path, "point")
    place = F.col("parts")[0][0]
    return shapefiles.shapefile(spark, path).select("pid", place["x"].alias("px"), place["y"].alias("py"), "v")


def _centred_sql(simple: bool) -> str:
    shift, back = ("- m.m", " + max(m0)") if simple else ("+ m0 - m.m", "")
    return f"""WITH {_NEAR}, s AS (SELECT pid, pid % 4 // 2 AS dataset, CASE WHEN pid % 4 = 2 THEN 2 * v + 1 ELSE v END AS v FROM pts WHERE pid % 2 = 0),
 m AS (SELECT dataset, avg(v) AS m FROM s GROUP BY dataset), z AS (SELECT m AS m0 FROM m WHERE dataset = 0),
 w AS (SELECT qid, pid, CASE WHEN min(d2) OVER (PARTITION BY qid) = 0 THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d2 END AS w FROM r WHERE rank <= 8),
 a AS (SELECT qid, round(sum(w * (s.v {shift})) / sum(w){back}, 8) AS estimate FROM w JOIN s USING (pid) JOIN m USING (dataset), z WHERE qid % 6 <> 3 GROUP BY qid)
SELECT pts.pid AS qid, estimate FROM pts LEFT JOIN a ON a.qid = pts.pid WHERE pts.pid % 2 = 1"""


def _centred(spark: SparkSession, d: str, simple: bool) -> DataFrame:
    p = _points(spark, d)
    dataset = F.when(F.col("pid") % 4 == 2, 1).otherwise(0).alias("dataset")
    values = p.where("pid % 2 = 0").select("pid", dataset, F.when(F.col("pid") % 4 == 2, 2 * F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    weights = interpolation.idw_weights(_near(spark, d, 8)).select("qid", "pid", dataset, "weight")
    targets = p.where("pid % 2 = 1").select(F.col("pid").alias("qid"), (F.col("pid") % 6 != 3).alias("active"))
    return rounded(interpolation.apply_centred(weights, values, targets, "v", 2, simple), 8, "estimate")


@query(_centred_sql(False))
def covariate_apply(spark: SparkSession, d: str) -> DataFrame:
    return _centred(spark, d, False)


@query(_centred_sql(True))
def centred_apply(spark: SparkSession, d: str) -> DataFrame:
    return _centred(spark, d, True)


def _ray(ring: list[tuple[float, float]]) -> str:
    edges = zip(ring, [*ring[1:], ring[0]], strict=True)
    return " + ".join(f"CASE WHEN py >= {min(b, e)!r} AND py < {max(b, e)!r} AND px < {a!r} + (py - {b!r}) * (({c!r} - {a!r}) / ({e!r} - {b!r})) THEN 1 ELSE 0 END" for (a, b), (c, e) in edges if b != e)


_SHAPES = [("north", [(-0.2, 0.0), (0.2, 0.01), (0.15, 0.3), (-0.1, 0.25)]), ("south", [(-0.25, -0.3), (0.3, -0.25), (0.2, 0.05), (0.0, -0.1), (-0.2, 0.02)])]


@query(f"WITH {_POINTS} SELECT pid, CASE " + " ".join(f"WHEN ({_ray(r)}) % 2 = 1 THEN '{n}'" for n, r in _SHAPES) + " END AS area FROM pts")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return spatial.label_polygons(_points(spark, d).select("pid", "px", "py"), "px", "py", _SHAPES).select("pid", "area")


@query(f"""WITH {_POINTS} SELECT pid, round(px * {numeric.math.cos(numeric.math.radians(30))!r} - py * {numeric.math.sin(numeric.math.radians(30))!r} + 500, 7) AS gx, round(px * {numeric.math.sin(numeric.math.radians(30))!r} + py * {numeric.math.cos(numeric.math.radians(30))!r} - 20, 7) AS gy, round(px, 7) AS bx, round(py, 7) AS by_ FROM pts""")
def grid_coordinates(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    gx, gy = numeric.rotate(F.col("px"), F.col("py"), 500.0, -20.0, 30.0)
    bx, by = numeric.unrotate(F.col("gx"), F.col("gy"), 500.0, -20.0, 30.0)
    return rounded(p.withColumns({"gx": gx, "gy": gy}).withColumns({"bx": bx, "by_": by}).select("pid", "gx", "gy", "bx", "by_"), 7, "gx", "gy", "bx", "by_")


@query(f"""WITH {_POINTS}, h AS (SELECT pid, sqrt(px * px + py * py) AS h FROM pts)
SELECT pid, round({_SPH.format(d='h')}, 8) AS spherical, round(0.9 * exp(-3 * h / 0.2), 8) AS exponential, round(0.9 * exp(-49.0 / 16 * h / 0.2 * h / 0.2), 8) AS gaussian, round(0.9 * cos(pi() * h / 0.2), 8) AS hole, round(0.9 - h / 0.2, 8) AS linear,
 round(CASE WHEN h < 0.2 THEN 0.9 * (1 - 2 / pi() * (h / 0.2 * sqrt(1 - h / 0.2 * h / 0.2) + asin(h / 0.2))) ELSE 0 END, 8) AS circular FROM h""")
def covariance_models(spark: SparkSession, d: str) -> DataFrame:
    h = _points(spark, d).select("pid", F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")).alias("h"))
    return h.select("pid", *(F.round(numeric.covariance(k, F.col("h"), 0.1 if k == "spherical" else 0.0, 0.9, 0.2), 8).alias(k) for k in ("spherical", "exponential", "gaussian", "hole", "linear", "circular")))


@query("""WITH o AS (SELECT vec_id, label, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, first_value(embedding[1]) OVER w > last_value(embedding[1]) OVER w AS turned FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 s AS (SELECT *, CASE WHEN turned THEN -n ELSE n END AS k FROM o),
 l AS (SELECT *, sqrt(pow(lead(x) OVER (PARTITION BY label ORDER BY k) - x, 2) + pow(lead(y) OVER (PARTITION BY label ORDER BY k) - y, 2)) AS w FROM s),
 m AS (SELECT *, quantile_cont(w, 0.5) OVER (PARTITION BY label) AS m FROM l)
SELECT vec_id, round(coalesce(sum(w) OVER (PARTITION BY label ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 5) AS line_dist, round(CASE WHEN coalesce(w, m) > 150 THEN m ELSE coalesce(w, m) END, 6) AS line_width FROM m""")
def line_geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"))
    out = intervals.line_geometry(rows, "label", ["vec_id"], "x", "y", 150.0).select("vec_id", "line_dist", "line_width")
    return rounded(rounded(out, 5, "line_dist"), 6, "line_width")


_LOGS = """logs AS (SELECT l_orderkey AS well, n, coalesce(lag(bot) OVER (PARTITION BY l_orderkey ORDER BY n), 0) AS top, bot, q, flag, price FROM (
 SELECT l_orderkey, row_number() OVER o AS n, sum(l_quantity) OVER o AS bot, l_quantity AS q, l_returnflag AS flag, l_discount AS price FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


def _logs(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals.dealt(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "well"), ["well"])
    w = Window.partitionBy("well").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    rows = rows.select("well", F.row_number().over(w).alias("n"), F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("bot"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("price"))
    return intervals.implicit_tops(rows, ["well"], ["n"], "bot")


@query(f"""WITH {_LOGS}, px AS (SELECT well, unnest(range(0, 4)) AS point FROM (SELECT DISTINCT well FROM logs))
SELECT l.well, CAST(n AS INTEGER) AS n, CAST(point AS INTEGER) AS point, least(bot, point * 25.0 + 25) - greatest(top, point * 25.0) AS thickness FROM logs l JOIN px p ON l.well = p.well AND bot > point * 25.0 AND point * 25.0 + 25 >= top""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    logs = _logs(spark, d)
    pixels = logs.select("well").distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"top": F.col("point") * 25.0, "bot": F.col("point") * 25.0 + 25})
    return intervals.overlap_join(logs.select("well", "n", "top", "bot"), pixels, ["well"]).select("well", "n", "point", "thickness")


@query(f"""WITH {_LOGS}, lay AS (SELECT * FROM (VALUES (1, 0.0, 20.0), (2, 20.0, 60.0), (3, 60.0, 150.0)) t(layer, t, b))
SELECT well, layer, round(sum(CASE WHEN price >= 0 THEN price * (least(bot, b) - greatest(top, t)) END) / sum(CASE WHEN price >= 0 THEN least(bot, b) - greatest(top, t) END), 8) AS price, round(sum(least(bot, b) - greatest(top, t)), 6) AS thickness FROM logs JOIN lay ON bot > t AND top < b GROUP BY well, layer""")
def layer_upscale(spark: SparkSession, d: str) -> DataFrame:
    layers = spark.createDataFrame([(1, 0.0, 20.0), (2, 20.0, 60.0), (3, 60.0, 150.0)], "layer int, top double, bot double")
    return rounded(rounded(intervals.upscale(_logs(spark, d), layers, ["well"], ["price"]), 8, "price"), 6, "thickness")


@query(f"""WITH {_LOGS}, c AS (SELECT *, greatest(CAST(ceil((bot - top) / 7.0) AS INTEGER), 1) AS of_ FROM logs), p AS (SELECT *, unnest(range(1, of_ + 1)) AS part FROM c)
SELECT well, CAST(n AS INTEGER) AS n, CAST(part AS INTEGER) AS part, of_ AS of, round(top + (part - 0.5) * (bot - top) / of_, 6) AS mid FROM p""")
def interval_split(spark: SparkSession, d: str) -> DataFrame:
    return intervals.split(_logs(spark, d).select("well", "n", "top", "bot"), 7.0).select("well", "n", "part", "of", F.round("mid", 6).alias("mid"))


@query(f"WITH {_LOGS} SELECT well, coalesce(min(CASE WHEN flag = 'R' THEN bot END), max(bot)) AS bottom, max(bot) AS deepest FROM logs GROUP BY well")
def bottom_search(spark: SparkSession, d: str) -> DataFrame:
    return intervals.first_below(_logs(spark, d), ["well"], "bot", ["R"], "flag")


@query(f"""WITH {_LOGS}, px AS (SELECT well, n, flag, price, (top + bot) / 2 AS mid FROM logs), q AS (SELECT DISTINCT well FROM logs)
SELECT well, 30.0::DOUBLE AS elev, min_by(gap, (gap, n)) AS gap, min_by(CAST(n AS INTEGER), (gap, n)) AS n FROM (SELECT q.well, abs(30.0 - mid) AS gap, n FROM q JOIN px USING (well)) GROUP BY well""")
def nearest_depth(spark: SparkSession, d: str) -> DataFrame:
    logs = _logs(spark, d)
    wells = logs.select("well").distinct().withColumn("elev", F.lit(30.0))
    return relational.nearest_value(wells, logs.select("well", "n", ((F.col("top") + F.col("bot")) / 2).alias("mid")), ["well"], "elev", "mid", "n")


#: Stated class curves for the carrier.
_CURVES = [texture.ClassCurve("Fine", 0.35, 0.0, 32.0), texture.ClassCurve("Mixed_Fine", 0.45, 5.0, 60.0), texture.ClassCurve("Mixed_Coarse", 0.5, 5.0, 100.0), texture.ClassCurve("Coarse", 0.55, 10.0, 160.0), texture.ClassCurve("Very_Coarse", 0.6, 10.0, 240.0)]


def _cdf_sql(x: str) -> str:
    a, b = numeric._A, numeric._B
    near = f"0.5 - abs({x}) * ({a[0]} - {a[1]} * (0.5 * {x} * {x}) / ((0.5 * {x} * {x}) + {a[2]} - {a[3]} / ((0.5 * {x} * {x}) + {a[4]} + {a[5]} / ((0.5 * {x} * {x}) + {a[6]}))))"
    far = f"exp(-(0.5 * {x} * {x})) * {b[0]} / (abs({x}) - {b[1]} + {b[2]} / (abs({x}) + {b[3]} + {b[4]} / (abs({x}) - {b[5]} + {b[6]} / (abs({x}) + {b[7]} - {b[8]} / (abs({x}) + {b[9]} + {b[10]} / (abs({x}) + {b[11]}))))))"
    tail = f"(CASE WHEN abs({x}) <= 1.28 THEN {near} WHEN abs({x}) <= 12.7 THEN {far} ELSE 0 END)"
    return f"(CASE WHEN {x} < 0 THEN {tail} ELSE 1 - {tail} END)"


def _shares_sql() -> str:
    z = [f"(ln(rho - {c.location} {s} 1.0) - {c.mu!r}) / {c.shape} AS z{k}{n}" for k, c in enumerate(_CURVES) for s, n in (("+", "p"), ("-", "m"))]
    p = [f"CASE WHEN {_cdf_sql(f'z{k}p')} - {_cdf_sql(f'z{k}m')} < 1e-10 THEN 0 ELSE {_cdf_sql(f'z{k}p')} - {_cdf_sql(f'z{k}m')} END AS p{k}" for k in range(5)]
    lo, hi = min(c.peak for c in _CURVES), max(c.peak for c in _CURVES)
    out = [f"round(CASE WHEN rho < {lo} THEN {float(k == 0)} WHEN rho > {hi} THEN {float(k == 4)} ELSE p{k} / (p0 + p1 + p2 + p3 + p4) END, 7) AS {c.name.lower()}" for k, c in enumerate(_CURVES)]
    return f"rho AS (SELECT p_partkey, (p_retailprice - 890) * 3 AS rho FROM part), z AS (SELECT *, {', '.join(z)} FROM rho), p AS (SELECT *, {', '.join(p)} FROM z), shares AS (SELECT p_partkey, {', '.join(out)} FROM p)"


def _shares(spark: SparkSession, d: str) -> DataFrame:
    rho = (F.col("p_retailprice") - 890) * 3
    return table(spark, d, "part").select("p_partkey", texture.class_shares(rho, _CURVES).alias("s"))


@query(f"WITH {_shares_sql()} SELECT * FROM shares")
def texture_prob(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).select("p_partkey", *(F.round(F.col("s")[k], 7).alias(c.name.lower()) for k, c in enumerate(_CURVES)))


@query("""WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN (a = greatest(a, n, r))::INT + (n = greatest(a, n, r))::INT + (r = greatest(a, n, r))::INT > 1 THEN 'TIE' WHEN a = greatest(a, n, r) THEN 'A' WHEN n = greatest(a, n, r) THEN 'N' ELSE 'R' END AS class FROM c""")
def dominant_tie(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array(*(F.count_if(F.col("l_returnflag") == k).cast("double") for k in "ANR")).alias("s"))
    return c.select("l_suppkey", texture.dominant(F.col("s"), ["A", "N", "R"]).alias("class"))


_CLASSES = [("A", 0.01, 5.0, 0.02, 1e-5, 0.1, 10.0), ("N", 0.5, 50.0, 0.01, 2e-5, 0.2, 5.0), ("R", 5.0, 200.0, 0.005, 3e-5, 0.25, 2.0)]
_VALUES = ", ".join(map(repr, _CLASSES))


@query(f"""WITH c(class, kmin, dk, kd, ss, sy, aniso) AS (VALUES {_VALUES}), f AS (SELECT l_suppkey, l_returnflag AS class, sum(l_quantity) AS fraction, avg(l_quantity) AS depth FROM lineitem GROUP BY 1, 2),
 k AS (SELECT *, kmin + dk * exp(-kd * depth) AS kh FROM f JOIN c USING (class))
SELECT l_suppkey, round(pow(sum(fraction * pow(kh, 0.5)) / sum(fraction), 2), 5) AS kh, round(pow(sum(fraction * pow(kh / aniso, 0.5)) / sum(fraction), 2), 5) AS kv, round(pow(sum(fraction * pow(ss, 0.5)) / sum(fraction), 2) * 1e6, 6) AS ss, round(pow(sum(fraction * pow(sy, 0.5)) / sum(fraction), 2), 7) AS sy FROM k GROUP BY 1""")
def block_parameters(spark: SparkSession, d: str) -> DataFrame:
    params = spark.createDataFrame(_CLASSES, "class string, kmin double, dk double, kd double, ss double, sy double, aniso double")
    f = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("class")).agg(F.sum("l_quantity").alias("fraction"), F.avg("l_quantity").alias("depth"))
    out = texture.block_parameters(f, params, ["l_suppkey"], 0.5)
    return out.select("l_suppkey", F.round("kh", 5).alias("kh"), F.round("kv", 5).alias("kv"), F.round(F.col("ss") * 1e6, 6).alias("ss"), F.round("sy", 7).alias("sy"))


@query("""SELECT n_nationkey AS zone, c_custkey AS cell, round(coalesce(s.v, 0), 2) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = c_nationkey""")
def raster_zone_fill(spark: SparkSession, d: str) -> DataFrame:
    zones = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("zone")).agg(F.sum("s_acctbal").alias("v"))
    cells = table(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_custkey").alias("cell"))
    return cells.join(zones, "zone", "left").select("zone", "cell", F.round(F.coalesce("v", F.lit(0.0)), 2).alias("value"))
