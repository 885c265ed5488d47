"""Geostatistics, clustering, log scans, weights and parameter tables on the carrier tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.functions import numeric
from hydrostrata.operators import budget, global_kriging, interpolation, intervals, learning, linkage, metrics, relational, spatial, spectral, texture, weighting
from hydrostrata.sources import tables
from hydrostrata.sources.tables import table

from .series_queries import rounded
from .spatial_queries import _LOGS, _NEAR, _POINTS, _SPH, _logs, _near, _points, _ray, _SHAPES

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _targets(p: DataFrame, *more: str) -> DataFrame:
    return p.where("pid % 2 = 1").select(F.col("pid").alias("qid"), F.col("px").alias("qx"), F.col("py").alias("qy"), *more)


@query(f"""WITH {_POINTS}, d AS (SELECT q.pid AS qid, p.v, (q.px - p.px) * (q.px - p.px) + (q.py - p.py) * (q.py - p.py) AS d2 FROM pts q JOIN pts p ON q.label = p.label AND q.pid % 2 = 1 AND (p.pid % 2 = 0 OR p.pid % 9 = 0))
SELECT qid, round(CASE WHEN min(d2) = 0 THEN avg(v) FILTER (d2 = 0) ELSE sum(v / d2) FILTER (d2 > 0) / sum(1 / d2) FILTER (d2 > 0) END, 8) AS estimate FROM d GROUP BY qid""")
def category_idw(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return rounded(interpolation.category_idw(_targets(p, "label"), p.where("pid % 2 = 0 or pid % 9 = 0"), "label", "v"), 8, "estimate")


_TWO = f"""b AS (SELECT a.qid, a.d2 AS e1, c.d2 AS e2, sqrt(a.d2) AS d1, sqrt(c.d2) AS d2, sqrt((a.px - c.px) * (a.px - c.px) + (a.py - c.py) * (a.py - c.py)) AS d12, a.pid AS p1, c.pid AS p2, a.v AS v1, c.v AS v2 FROM r a JOIN r c ON a.qid = c.qid AND a.rank = 1 AND c.rank = 2)"""


@query(f"""WITH {_NEAR}, s AS (SELECT qid, pid, CASE rank WHEN 1 THEN -0.2 WHEN 2 THEN 0.9 ELSE 0.3 END + CASE WHEN qid % 3 = 0 THEN 0.3 ELSE 0 END AS w FROM r WHERE rank <= 3)
SELECT qid, pid, round(CASE WHEN min(w) OVER (PARTITION BY qid) < 0 THEN greatest(w, 0) / sum(greatest(w, 0)) OVER (PARTITION BY qid) ELSE w END, 9) AS weight FROM s""")
def weights_without_negatives(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("rank") == 1, -0.2).when(F.col("rank") == 2, 0.9).otherwise(0.3) + F.when(F.col("qid") % 3 == 0, 0.3).otherwise(0.0)
    return rounded(interpolation.without_negatives(_near(spark, d, 3).select("qid", "pid", w.alias("weight"))), 9, "weight")


@query(f"WITH {_NEAR} SELECT qid, pid, round(sqrt(d2), 8) AS dist FROM r WHERE rank <= 5 AND sqrt(d2) <= 3 * 0.02")
def secondary_distance_filter(spark: SparkSession, d: str) -> DataFrame:
    return interpolation.not_farther(_near(spark, d, 5), 0.02).select("qid", "pid", F.round(F.sqrt("d2"), 8).alias("dist"))


def _expo(d: str, sill: str, reach: str) -> str:
    return f"(({sill}) * exp(-3 * {d} / ({reach})) + CASE WHEN {d} < 1e-10 THEN 0.1 ELSE 0 END)"


@query(f"""WITH {_NEAR}, {_TWO}, z AS (SELECT *, CASE WHEN qid % 4 = 1 THEN 0.2 ELSE 0.5 END AS reach FROM b),
 w AS (SELECT *, 0.5 + ({_expo('d1', '0.9', 'reach')} - {_expo('d2', '0.9', 'reach')}) / (2 * (1.0 - {_expo('d12', '0.9', 'reach')})) AS w1 FROM z)
SELECT qid, round(w1 * v1 + (1 - w1) * v2, 6) AS estimate FROM w""")
def zonal_krige(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d, 2).withColumn("zone", (F.col("qid") % 4).cast("int"))
    w = interpolation.kriging_weights(near, "exponential", 0.1, 0.9, 0.5, zones={1: ("exponential", 0.1, 0.9, 0.2)})
    return rounded(interpolation.apply_weights(w, _points(spark, d), "v"), 6, "estimate")


@query(f"""WITH {_POINTS}, d AS (SELECT q.pid AS qid, p.pid, p.px, p.py, p.v, CASE WHEN p.pid % 4 = 0 THEN 0 ELSE 1 END AS dataset, (q.px - p.px) * (q.px - p.px) + (q.py - p.py) * (q.py - p.py) AS d2 FROM pts q JOIN pts p ON q.pid % 2 = 1 AND p.pid % 2 = 0),
 r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, dataset ORDER BY d2, pid) AS k FROM d) WHERE k = 1),
 b AS (SELECT a.qid, sqrt(a.d2) AS d1, sqrt(c.d2) AS d2, sqrt((a.px - c.px) * (a.px - c.px) + (a.py - c.py) * (a.py - c.py)) AS d12, a.v AS v1, c.v AS v2 FROM r a JOIN r c ON a.qid = c.qid AND a.dataset = 0 AND c.dataset = 1),
 w AS (SELECT *, ({_expo('d1', '0.9', '0.2')} - 0.5 * exp(-3 * d2 / 0.3) + 0.8 - 0.5 * exp(-3 * d12 / 0.3)) / (1.0 + 0.8 - 2 * 0.5 * exp(-3 * d12 / 0.3)) AS w1 FROM b)
SELECT qid, round(w1 * v1 + (1 - w1) * v2, 6) AS estimate FROM w""")
def co_krige(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    sets = [spatial.knn(_targets(p), p.where(c).select("pid", "px", "py"), 1, 0.05).withColumn("dataset", F.lit(k)) for k, c in enumerate(("pid % 4 = 0", "pid % 4 = 2"))]
    models = {(0, 0): ("exponential", 0.1, 0.9, 0.2), (0, 1): ("exponential", 0.0, 0.5, 0.3), (1, 1): ("exponential", 0.0, 0.8, 0.3)}
    w = interpolation.kriging_weights(sets[0].unionByName(sets[1]), "exponential", 0.1, 0.9, 0.2, cross=models)
    return rounded(interpolation.apply_weights(w, p, "v"), 6, "estimate")


@query(f"""WITH {_POINTS}, s AS (SELECT min(CASE WHEN pid = 2 THEN px END) AS ax, min(CASE WHEN pid = 2 THEN py END) AS ay, min(CASE WHEN pid = 2 THEN v END) AS av, min(CASE WHEN pid = 4 THEN px END) AS bx, min(CASE WHEN pid = 4 THEN py END) AS by_, min(CASE WHEN pid = 4 THEN v END) AS bv FROM pts),
 t AS (SELECT pid AS qid, sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay)) AS da, sqrt((px - bx) * (px - bx) + (py - by_) * (py - by_)) AS db, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) AS ab, av, bv, (av + bv) / 2 AS m FROM pts, s WHERE pid % 2 = 1),
 c AS (SELECT *, {_expo('da', '0.9', '0.2')} AS ca, {_expo('db', '0.9', '0.2')} AS cb, 0.9 * exp(-3 * ab / 0.2) AS c FROM t)
SELECT qid, round(m + ((ca - c * cb) * (av - m) + (cb - c * ca) * (bv - m)) / (1 - c * c), 7) AS estimate FROM c""")
def global_simple_krige(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return rounded(global_kriging.simple_kriging(_targets(p), p.where("pid in (2, 4)"), "v", "exponential", 0.1, 0.9, 0.2), 7, "estimate")


_BINS = f"""{_POINTS}, d AS (SELECT a.v - b.v AS dv, a.px - b.px AS dx, a.py - b.py AS dy, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS h FROM pts a JOIN pts b ON a.pid < b.pid)"""


@query(f"""WITH {_BINS} SELECT CAST(floor(h / 0.02) AS INTEGER) AS bin, round(avg(dv * dv) / 2, 8) AS gamma, count(*) AS pairs, round(avg(h), 8) AS distance FROM d
WHERE h < 0.2 AND h > 0 AND abs(dx * {numeric.math.sin(numeric.math.radians(45))!r} + dy * {numeric.math.cos(numeric.math.radians(45))!r}) >= h * {numeric.math.cos(numeric.math.radians(22.5))!r} GROUP BY 1""")
def directional_variogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(interpolation.directional_variogram(_points(spark, d), "v", 0.02, 10, 45.0, 22.5), 8, "gamma", "distance")


@query(f"""WITH {_POINTS}, l AS (SELECT pid, px, py, label FROM pts), d AS (SELECT a.pid, a.label, b.label AS other, sum((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS s, count(*) AS n FROM l a, l b GROUP BY 1, 2, 3),
 e AS (SELECT pid, label, max(CASE WHEN other = label THEN n END) AS m, max(CASE WHEN other = label THEN s / (n - 1) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM d GROUP BY 1, 2)
SELECT pid, label, round(CASE WHEN m = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM e""")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learning.silhouette(_points(spark, d), "pid", "label", ["px", "py"]), 6, "silhouette")


@query("""WITH v AS (SELECT p_size::DOUBLE AS v FROM part), u AS (SELECT DISTINCT v FROM v), t AS (SELECT v, count(*) AS n, sum(v) OVER () AS x FROM v GROUP BY v),
 k AS (SELECT a.v AS a, b.v AS b FROM u a JOIN u b ON a.v < b.v WHERE b.v < (SELECT max(v) FROM u)),
 c AS (SELECT a, b, CASE WHEN v <= a THEN 1 WHEN v <= b THEN 2 ELSE 3 END AS g, sum(n * v * v) - sum(n * v) * sum(n * v) / sum(n) AS s FROM k, t GROUP BY 1, 2, 3),
 best AS (SELECT a, b FROM (SELECT a, b, sum(s) AS s FROM c GROUP BY 1, 2) ORDER BY s, a, b LIMIT 1)
SELECT CAST(class AS INTEGER) AS class, upper FROM (SELECT 1 AS class, a AS upper FROM best UNION ALL SELECT 2, b FROM best UNION ALL SELECT 3, (SELECT max(v) FROM u))""")
def natural_breaks(spark: SparkSession, d: str) -> DataFrame:
    return learning.natural_breaks(table(spark, d, "part"), "p_size", 3)


@query(f"""WITH {_LOGS}, px AS (SELECT well, unnest(range(0, 4)) AS point FROM (SELECT DISTINCT well FROM logs))
SELECT l.well, CAST(point AS INTEGER) AS point, sum(CASE WHEN flag = 'A' THEN least(bot, point * 25.0 + 25) - greatest(top, point * 25.0) ELSE 0 END) AS "A", sum(CASE WHEN flag = 'R' THEN least(bot, point * 25.0 + 25) - greatest(top, point * 25.0) ELSE 0 END) AS "R"
FROM logs l JOIN px p ON l.well = p.well AND bot > point * 25.0 AND point * 25.0 + 25 >= top AND flag IN ('A', 'R') GROUP BY 1, 2""")
def class_thickness(spark: SparkSession, d: str) -> DataFrame:
    logs = _logs(spark, d)
    pixels = logs.select("well").distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"top": F.col("point") * 25.0, "bot": F.col("point") * 25.0 + 25})
    return intervals.class_thickness(logs.select("well", "n", "top", "bot", "flag"), pixels, ["well"], ["point"], "flag", ["A", "R"])


@query(f"""WITH {_LOGS}, p AS (SELECT well, n AS point, flag AS label, 200 - (top + bot) / 2 AS mid, 200 - bot AS bot, flag = 'R' AS rock FROM logs),
 s AS (SELECT well, 200.0 - (well % 90) AS start, 200.0 - 60 - (well % 90) AS doi FROM (SELECT DISTINCT well FROM p)),
 a AS (SELECT well, min_by(point, (abs(mid - start), point)) AS pt, min_by(mid, (abs(mid - start), point)) AS pm, min_by(rock, (abs(mid - start), point)) AS pr, min_by(point, (abs(p.bot - doi), point)) AS deep, min(point) AS lo, max(point) AS hi FROM p JOIN s USING (well) GROUP BY well),
 b AS (SELECT well, min_by(point, (abs(p.bot - (pm - 20)), point)) AS bed FROM p JOIN a USING (well) GROUP BY well),
 c AS (SELECT well, any_value(pt) AS pt, any_value(pr) AS pr, any_value(deep) AS deep, coalesce(bool_and(rock) FILTER (point BETWEEN pt AND bed), true) AS all_rock, coalesce(max(point) FILTER (point < pt AND NOT rock), any_value(lo)) AS up, coalesce(min(point) FILTER (point > pt AND rock), any_value(hi)) - 1 AS down FROM p JOIN a USING (well) JOIN b USING (well) GROUP BY well),
 e AS (SELECT well, deep, CASE WHEN pr THEN CASE WHEN all_rock THEN up ELSE pt - 1 END ELSE down END AS pid FROM c)
SELECT e.well, CAST(pid AS INTEGER) AS pid, CASE WHEN pid > 1 AND pid <= deep THEN p.bot END AS bottom FROM e LEFT JOIN p ON p.well = e.well AND p.point = e.pid""")
def bottom_scan(spark: SparkSession, d: str) -> DataFrame:
    logs = _logs(spark, d)
    pixels = logs.select("well", F.col("n").alias("point"), F.col("flag").alias("label"), (200 - (F.col("top") + F.col("bot")) / 2).alias("mid"), (200 - F.col("bot")).alias("bot"))
    starts = logs.select("well").distinct().withColumns({"start": 200.0 - F.col("well") % 90, "doi": 140.0 - F.col("well") % 90})
    return intervals.bottom_scan(pixels, starts, ["well"], ["R"], 20.0)


def _dist_sql(ring: list[tuple[float, float]]) -> str:
    edges = zip(ring, [*ring[1:], ring[0]], strict=True)
    one = lambda a, b, c, e: f"(pow(px - {a!r} - least(1, greatest(0, ((px - {a!r}) * ({c - a!r}) + (py - {b!r}) * ({e - b!r})) / {(c - a) ** 2 + (e - b) ** 2!r})) * ({c - a!r}), 2) + pow(py - {b!r} - least(1, greatest(0, ((px - {a!r}) * ({c - a!r}) + (py - {b!r}) * ({e - b!r})) / {(c - a) ** 2 + (e - b) ** 2!r})) * ({e - b!r}), 2))"
    return f"least({', '.join(one(a, b, c, e) for (a, b), (c, e) in edges)}) <= 0.0009"


@query(f"WITH {_POINTS} SELECT pid, CASE " + " ".join(f"WHEN ({_ray(r)}) % 2 = 1 OR {_dist_sql(r)} THEN '{n}'" for n, r in _SHAPES) + " END AS area FROM pts")
def polygon_table_buffer(spark: SparkSession, d: str) -> DataFrame:
    polygons = spark.createDataFrame([(n, k, [{"x": x, "y": y} for x, y in ring]) for k, (n, ring) in enumerate(_SHAPES)], "label string, priority int, ring array<struct<x:double,y:double>>")
    return spatial.label_by_polygon_table(_points(spark, d).select("pid", "px", "py"), polygons, 0.1, 0.03).select("pid", "area")


@query("""WITH m AS (SELECT p_size, avg(p_retailprice) AS a, avg(abs(p_retailprice - 950)) AS b FROM part GROUP BY 1)
SELECT 'price' AS metric, p_size AS parameter, round(a, 6) AS value FROM m WHERE (a, p_size) = (SELECT (a, p_size) FROM m ORDER BY a, p_size LIMIT 1) UNION ALL SELECT 'gap', p_size, round(b, 6) FROM m WHERE (b, p_size) = (SELECT (b, p_size) FROM m ORDER BY b, p_size LIMIT 1)""")
def best_parameter(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "part").select("p_size", F.col("p_retailprice").alias("price"), F.abs(F.col("p_retailprice") - 950).alias("gap"))
    return rounded(metrics.best_parameter(scores, "p_size", ["price", "gap"]), 6, "value")


@query("SELECT l_partkey, count(*) AS n, count(*) FILTER (l_quantity * 40 > p_retailprice) AS above FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def above_ground(spark: SparkSession, d: str) -> DataFrame:
    obs = table(spark, d, "lineitem").select("l_partkey", (F.col("l_quantity") * 40).alias("level"))
    return metrics.above_ground(obs, table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("surface")), ["l_partkey"], "level", "surface")


_RULES = "c(well, cutoff) AS (VALUES (1, DATE '2024-01-10'), (2, DATE '2024-01-20'), (3, DATE '2024-01-15')), m(well, width, threshold, low) AS (VALUES (1, 5, 20.0, 0.1), (4, 3, 10.0, 0.25))"


@query(f"""WITH {_RULES}, e AS (SELECT event_id, user_id % 7 AS well, ts, value, CAST(ts AS DATE) AS day FROM events),
 k AS (SELECT *, count(*) OVER (PARTITION BY well) AS n, row_number() OVER (PARTITION BY well ORDER BY ts, event_id) AS i FROM e),
 f AS (SELECT *, median(value) OVER (PARTITION BY well ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5, count(*) OVER (PARTITION BY well ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c5, median(value) OVER (PARTITION BY well ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m3, count(*) OVER (PARTITION BY well ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c3 FROM k)
SELECT event_id, CASE WHEN n < 3 THEN 0 WHEN day > cutoff THEN 0 WHEN CASE width WHEN 5 THEN CASE WHEN c5 = 5 THEN m5 END WHEN 3 THEN CASE WHEN c3 = 3 THEN m3 END END - value > threshold THEN low ELSE 1.0 / n END::DOUBLE AS weight FROM f LEFT JOIN c USING (well) LEFT JOIN m USING (well)""")
def well_rule_weights(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("well"), F.struct("ts", "event_id").alias("at"), F.to_date("ts").alias("day"), "value")
    cutoffs = spark.createDataFrame([(1, dt.date(2024, 1, 10)), (2, dt.date(2024, 1, 20)), (3, dt.date(2024, 1, 15))], "well long, cutoff date")
    medians = spark.createDataFrame([(1, 5, 20.0, 0.1), (4, 3, 10.0, 0.25)], "well long, width int, threshold double, low double")
    return weighting.well_weights(e, "well", "day", "value", cutoffs, medians, order="at").select("event_id", "weight")


@query("""WITH p AS (SELECT p_partkey AS name, p_retailprice AS v FROM part) SELECT a.name, CASE WHEN a.name % 10 = 3 THEN 'fixed' WHEN a.name % 4 = 1 AND a.name > 1 THEN 'tied' ELSE 'none' END AS kind, CASE WHEN a.name % 10 = 3 THEN 7.5 WHEN a.name % 4 = 1 AND a.name > 1 THEN b.v ELSE a.v END AS value, CASE WHEN a.name % 10 <> 3 AND a.name % 4 = 1 AND a.name > 1 THEN a.name - 1 END AS partner
FROM p a LEFT JOIN p b ON b.name = a.name - 1""")
def parameter_table(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("default"))
    tied = p.where("name % 4 = 1 and name > 1").select("name", (F.col("name") - 1).alias("partner"))
    return weighting.assemble_parameters(p, tied, p.where("name % 10 = 3").select("name", F.lit(7.5).alias("value")))


@query("SELECT a.p_partkey AS first, b.p_partkey AS second, 1.0::DOUBLE AS coef_first, -1.0::DOUBLE AS coef_second, round(ln(a.p_retailprice / b.p_retailprice), 9) AS rhs, 750.0::DOUBLE AS weight FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 3 = 0")
def coupled_priors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("default"))
    pairs = p.where("name % 3 = 0").select(F.col("name").alias("first"), (F.col("name") + 1).alias("second"))
    return rounded(weighting.coupled_priors(pairs, p), 9, "rhs")


@query("WITH c AS (SELECT l_suppkey, [count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_returnflag = 'N'), count(*) FILTER (l_returnflag = 'R')] AS s FROM lineitem GROUP BY 1) SELECT l_suppkey, list_sum(s)::DOUBLE AS total, list_sort(s, 'DESC')[1]::DOUBLE AS first, list_sort(s, 'DESC')[2]::DOUBLE AS second FROM c")
def ranked_shares(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array(*(F.count_if(F.col("l_returnflag") == k).cast("double") for k in "ANR")).alias("s"))
    total, first, second = texture.ranked_shares(F.col("s"))
    return c.select("l_suppkey", total.alias("total"), first.alias("first"), second.alias("second"))


@query('SELECT o_custkey, bool_and(coalesce(o_totalprice > 50000, false)) AS "all" FROM orders GROUP BY 1')
def grouped_all(spark: SparkSession, d: str) -> DataFrame:
    return relational.all_true(table(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice") > 50000)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN (SELECT l_partkey AS k, avg(l_quantity) AS m FROM lineitem GROUP BY 1) ON l_partkey = k WHERE l_quantity >= m + 20")
def correlated_threshold(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.join(li.groupBy("l_partkey").agg(F.avg("l_quantity").alias("m")), "l_partkey").where(F.col("l_quantity") >= F.col("m") + 20).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_shipmode AS k, n, total FROM (SELECT l_suppkey AS l_shipmode, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) ORDER BY total DESC LIMIT 5")
def tail_of_sums(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return relational.tail_of_sums(li.withColumnRenamed("l_suppkey", "k"), ["k", "n"], "v", 5)


@query("SELECT event_id, round(value * 0.028316846592 * 86400, 6) AS m3_day FROM events")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(F.col("value") * numeric.CFS_TO_M3_DAY, 6).alias("m3_day"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * l_quantity, 8) AS a, round(l_tax * l_quantity, 8) AS b FROM lineitem")
def depth_to_volume(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), "l_quantity")
    return rounded(budget.depth_to_volume(rows, ["a", "b"], "l_quantity"), 8, "a", "b").drop("l_quantity")


@query("""WITH e AS (SELECT user_id % 11 AS well, CAST(ts AS DATE) AS day, max_by(value, (ts, event_id)) AS last, sum(value) AS a FROM events GROUP BY 1, 2)
SELECT well, CAST(date_trunc('month', day) AS DATE) AS month, round(sum(last), 4) AS daily_sum, round(sum(a), 4) AS monthly, round(sum(a) / day(last_day(max(day))), 5) AS rate FROM e GROUP BY 1, 2""")
def pumping_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 11).alias("well"), F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("at"), "value")
    return rounded(rounded(budget.pumping(e, ["well"], "day", "at", "value"), 4, "daily_sum", "monthly"), 5, "rate")


@query("SELECT l_suppkey, round(sum(l_quantity) / 31, 8) AS rate FROM lineitem GROUP BY 1")
def segment_runoff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(budget.segment_runoff(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 31), 8, "rate")


@query("SELECT p_partkey, 'NNEAR 16 of ' || p_name || ' LAYER 2' AS line FROM part")
def template_tokens(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select("p_partkey", F.concat(F.lit("NNEAR ~ nnear ~ of "), "p_name", F.lit(" LAYER ~layer~")).alias("line"))
    return relational.replace_tokens(lines, "line", {"nnear": "16", "layer": "2"})


@query("SELECT o_custkey, unnest.k AS order_no, unnest.p AS price FROM (SELECT o_custkey, unnest(list({'k': o_orderkey, 'p': o_totalprice})) AS unnest FROM orders GROUP BY 1)")
def nested_to_rows(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))).alias("rows"))
    return nested.select("o_custkey", F.explode("rows").alias("r")).select("o_custkey", F.col("r.k").alias("order_no"), F.col("r.p").alias("price"))


@query(f"""WITH RECURSIVE {_POINTS}, n AS (SELECT a.pid AS a, b.pid AS b FROM pts a JOIN pts b ON (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 0.02 * 0.02), c AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 4),
 e AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)), r AS (SELECT id, id AS to_ FROM c UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_), f AS (SELECT id, min(to_) AS comp FROM r GROUP BY id),
 k AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS k FROM (SELECT DISTINCT comp FROM f)), o AS (SELECT id, comp, true AS core FROM f UNION ALL SELECT n.a, min_by(f.comp, n.b), false FROM n JOIN f ON f.id = n.b WHERE n.a NOT IN (SELECT id FROM c) GROUP BY n.a)
SELECT pid, CAST(coalesce(k, (SELECT count(*) FROM k)) AS INTEGER) AS cluster, coalesce(core, false) AS core FROM pts LEFT JOIN o ON o.id = pid LEFT JOIN k USING (comp)""")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spatial.density_clusters(_points(spark, d).select("pid", "px", "py"), 0.02, 4)


@query("""WITH b AS (SELECT CAST(l_linenumber AS INTEGER) AS layer, CAST(l_suppkey AS INTEGER) AS row, CAST(l_linenumber * 0 + 1 AS INTEGER) AS col, -max(l_quantity) - 60 * l_linenumber AS bottom FROM lineitem GROUP BY l_linenumber, l_suppkey), t AS (SELECT CAST(s_suppkey AS INTEGER) AS row, s_acctbal / 100 AS top FROM supplier)
SELECT b.layer, b.row, b.col, b.bottom, CASE WHEN b.layer = 1 THEN t.top ELSE a.bottom END - b.bottom AS thickness FROM b LEFT JOIN b a ON a.layer + 1 = b.layer AND a.row = b.row LEFT JOIN t ON t.row = b.row""")
def layer_thickness(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("layer"), F.col("l_suppkey").cast("int").alias("row")).agg(F.max("l_quantity").alias("q"))
    b = b.select("layer", "row", F.lit(1).alias("col"), (-F.col("q") - 60 * F.col("layer")).alias("bottom"))
    tops = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("row"), F.lit(1).alias("col"), (F.col("s_acctbal") / 100).alias("top"))
    return relational.layer_thickness(b.select("layer", "row", "col"), tops, b)


@query("SELECT p_partkey, CAST(pos AS INTEGER) AS pos, [p_brand, 'layer'][pos + 1] AS name FROM part, range(0, 2) t(pos)")
def template_names(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select("p_partkey", F.concat(F.lit("K ~ "), F.col("p_brand"), F.lit(" ~ L ~layer~ end")).alias("line"))
    return relational.template_names(lines, "line").select("p_partkey", "pos", "name")


@query("""WITH r AS (SELECT s_suppkey AS id, 1 AS run, s_nationkey AS label FROM supplier UNION ALL SELECT s_suppkey, 2, CAST(s_suppkey % 7 AS INTEGER) FROM supplier), n AS (SELECT id, count(*) OVER (PARTITION BY run, label) AS n FROM r)
SELECT id, round(sum(n) / (SELECT count(*) FROM r), 9) AS similarity FROM n GROUP BY 1""")
def mean_coassociation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    runs = s.select(F.col("s_suppkey").alias("id"), F.lit(1).alias("run"), F.col("s_nationkey").alias("label")).unionByName(s.select(F.col("s_suppkey").alias("id"), F.lit(2).alias("run"), (F.col("s_suppkey") % 7).cast("int").alias("label")))
    return rounded(learning.mean_coassociation(runs), 9, "similarity")


_STARTS = [(0.0, "Brand#11"), (1.0, "Brand#22"), (2.0, "Brand#33")]


def _prototype_rounds(n: int) -> str:
    """CTEs of the rounds: c0 are the starts, z<k> the rows' clusters, c<k + 1> the moved prototypes. Rounds after the last move change nothing."""
    steps = []
    for k in range(n):
        steps.append(f"z{k} AS (SELECT p_partkey, p.x, p.b, min((pow(p.x - c.x, 2) + CASE WHEN p.b = c.b THEN 0 ELSE 0.5 END, k)) AS best FROM p, c{k} c GROUP BY ALL)")
        steps.append(f"f{k} AS (SELECT best[2] AS k, b, count(*) AS n FROM z{k} GROUP BY ALL), m{k} AS (SELECT k, arg_min(b, (-n, b)) AS b FROM f{k} GROUP BY 1), g{k} AS (SELECT best[2] AS k, avg(x) AS x FROM z{k} GROUP BY 1)")
        steps.append(f"c{k + 1} AS (SELECT s.k, coalesce(g.x, s.x) AS x, coalesce(m.b, s.b) AS b FROM c{k} s LEFT JOIN g{k} g USING (k) LEFT JOIN m{k} m USING (k))")
    return ", ".join(steps)


@query(f"""WITH p AS (SELECT p_partkey, p_retailprice / 977 AS x, p_brand AS b FROM part), c0 AS (SELECT * FROM (VALUES {', '.join(f"({k}, {x}::DOUBLE, '{b}')" for k, (x, b) in enumerate(_STARTS))}) t(k, x, b)), {_prototype_rounds(25)}
SELECT p_partkey, CAST(best[2] AS INTEGER) AS cluster, round(best[1], 8) AS distance FROM z24""")
def prototype_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 977).alias("x"), F.col("p_brand").alias("b"))
    return rounded(learning.k_prototypes(rows, "p_partkey", ["x"], ["b"], _STARTS, 0.5, 24), 8, "distance")


def _density_picks(n: int) -> str:
    """CTEs s0, s1, ...: the starts one after the other."""
    out = []
    for k in range(n):
        scores = [f"t.dens * (CASE WHEN t.b = s{j}.b THEN 0 ELSE 1 END + CASE WHEN t.z = s{j}.z THEN 0 ELSE 1 END)" for j in range(k)]
        score = f"least({', '.join(scores)})" if scores else "t.dens"
        out.append(f"s{k} AS (SELECT t.* FROM t{''.join(f', s{j}' for j in range(k))} WHERE round({score}, 12) > 0 ORDER BY round({score}, 12) DESC, t.b, t.z LIMIT 1)")
    return ", ".join(out)


@query(f"""WITH p AS (SELECT p_brand AS b, p_size AS z, p_retailprice AS v FROM part), t AS (SELECT b, z, avg(v) AS v, any_value((nb + nz) / 2 / n) AS dens FROM (SELECT *, count(*) OVER (PARTITION BY b) AS nb, count(*) OVER (PARTITION BY z) AS nz, count(*) OVER () AS n FROM p) GROUP BY b, z),
 {_density_picks(4)} {' UNION ALL '.join(f"SELECT CAST({k} AS INTEGER) AS start, b AS brand, CAST(z AS BIGINT) AS size, round(v, 6) AS price FROM s{k}" for k in range(4))}""")
def prototype_starts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", "p_size", "p_retailprice")
    starts = learning.density_starts(rows, ["p_retailprice"], ["p_brand", "p_size"], 4)
    found = spark.createDataFrame([(k, s[1], int(s[2]), float(s[0])) for k, s in enumerate(starts)], "start int, brand string, size long, price double")
    return rounded(found, 6, "price")


def _location_rounds(steps: int, rounds: int, margin: float) -> str:
    """CTEs of the same bracket: t<k> the candidates of a round, o<k> the likeliest of each."""
    out = [f"a0 AS (SELECT p_brand, lo, n, ln({margin}) AS a, 0.0::DOUBLE AS b FROM (SELECT p_brand, min(v) AS lo, max(v) AS hi, count(*) AS n FROM p GROUP BY 1) WHERE hi > lo)"]
    for k in range(rounds):
        out.append(f"t{k} AS (SELECT p_brand, n, a, b, j, lo, exp(a + (b - a) * (j / {steps}::DOUBLE)) * lo AS gap FROM a{k}, range({steps + 1}) r(j))")
        out.append(f"l{k} AS (SELECT p_brand, j, any_value(n) AS n, any_value(a) AS a, any_value(b) AS b, any_value(lo) AS lo, avg(ln(v - lo + gap)) AS mu, stddev_pop(ln(v - lo + gap)) AS sigma FROM t{k} JOIN p USING (p_brand) GROUP BY 1, 2)")
        out.append(f"o{k} AS (SELECT * FROM l{k} QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY -ln(sigma) - mu DESC, j DESC) = 1)")
        out.append(f"a{k + 1} AS (SELECT p_brand, lo, n, a + (b - a) * greatest(j - 1, 0) / {steps} AS a, a + (b - a) * least(j + 1, {steps}) / {steps} AS b, a + (b - a) * j / {steps} AS t, mu, sigma FROM o{k})")
    return ", ".join(out)


@query(f"""WITH p AS (SELECT p_brand, p_retailprice AS v FROM part), {_location_rounds(16, 9, 0.001)}
SELECT p_brand, n, round(lo - exp(t) * lo, 1) AS loc, round(mu, 3) AS mu, round(sigma, 3) AS sigma, round(exp(mu)) AS scale FROM a9""")
def bounded_lognormal(spark: SparkSession, d: str) -> DataFrame:
    out = learning.bounded_lognormal_fit(table(spark, d, "part"), ["p_brand"], "p_retailprice")
    return rounded(rounded(rounded(out, 1, "loc"), 3, "mu", "sigma"), 0, "scale")


@query("""WITH r AS (SELECT s_suppkey AS id, 1 AS run, s_nationkey AS label FROM supplier UNION ALL SELECT s_suppkey, 2, CAST(s_suppkey % 7 AS INTEGER) FROM supplier UNION ALL SELECT s_suppkey, 3, CAST(s_suppkey % 2 AS INTEGER) FROM supplier)
SELECT id, round(median(k / 3), 9) AS similarity FROM (SELECT a.id, b.id AS other, sum(CASE WHEN a.label = b.label THEN 1 ELSE 0 END) AS k FROM r a JOIN r b USING (run) GROUP BY 1, 2) GROUP BY 1""")
def median_coassociation(spark: SparkSession, d: str) -> DataFrame:
    labels = {1: F.col("s_nationkey"), 2: (F.col("s_suppkey") % 7).cast("int"), 3: (F.col("s_suppkey") % 2).cast("int")}
    runs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.array(*(F.struct(F.lit(k).alias("run"), c.alias("label")) for k, c in labels.items()))).alias("r")).select("id", "r.run", "r.label")
    return rounded(learning.median_coassociation(runs), 9, "similarity")


@query()
def linkage_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Complete linkage of the points, cut where clusters would be wider than 0.05."""
    p = _points(spark, d).select("pid", "px", "py")
    nodes = p.select(F.col("pid").alias("id"))
    merges = linkage.point_linkage(p, 0.05)
    return linkage.cut_tree(nodes, merges, height=0.05)


@query()
def trade_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Nations by the leading eigenvectors of how often they trade with each other."""
    sold = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = sold.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").cast("double").alias("w"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    _, found = spectral.spectral_embedding(both, 2, 1e-7)
    return rounded(found.select(F.col("id").alias("nation"), F.col("vector")[0].alias("first"), F.col("vector")[1].alias("second")), 6, "first", "second")


@query(f"""WITH {_POINTS}, t AS (SELECT pid, px * sin(radians(30)) + py * cos(radians(30)) AS a, (px * cos(radians(30)) - py * sin(radians(30))) / 0.4 AS b FROM pts),
 d AS (SELECT q.pid AS qid, p.pid, pow(q.a - p.a, 2) + pow(q.b - p.b, 2) AS d2 FROM t q JOIN t p ON q.pid % 2 = 1 AND p.pid % 2 = 0)
SELECT qid, pid, CAST(rank AS INTEGER) AS rank, round(d2, 9) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS rank FROM d) WHERE rank <= 4""")
def knn_anisotropic(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    out = spatial.knn_anisotropic(_targets(p), p.where("pid % 2 = 0").select("pid", "px", "py"), 4, 0.05, 30.0, 0.4)
    return out.select("qid", "pid", "rank", F.round("d2", 9).alias("d2"))


_BOXES = [(k, -0.3 + 0.15 * (k % 4), -0.2 + 0.2 * (k // 4), 0.15, 0.2) for k in range(8)]
_BOX_SQL = f"box AS (SELECT * FROM (VALUES {', '.join(f'({k}, {x!r}::DOUBLE, {y!r}::DOUBLE, {w!r}::DOUBLE, {h!r}::DOUBLE)' for k, x, y, w, h in _BOXES)}) t(element, cx, cy, w, h))"


def _elements(spark: SparkSession) -> DataFrame:
    box = spark.createDataFrame(_BOXES, "element int, cx double, cy double, w double, h double")
    return box.select("element", numeric.rectangle(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")).alias("ring"))


@query(f"""WITH {_POINTS}, {_BOX_SQL}, i AS (SELECT pid, min(element) AS element FROM pts JOIN box ON px >= cx - w / 2 AND px < cx + w / 2 AND py >= cy - h / 2 AND py < cy + h / 2 GROUP BY 1),
 n AS (SELECT pid, arg_min(element, (pow(px - cx, 2) + pow(py - cy, 2), element)) AS element FROM pts, box GROUP BY 1)
SELECT pid, coalesce(i.element, n.element) AS element, i.element IS NOT NULL AS inside FROM n LEFT JOIN i USING (pid)""")
def find_element(spark: SparkSession, d: str) -> DataFrame:
    return spatial.find_element(_points(spark, d).select("pid", "px", "py"), _elements(spark), 0.1).select("pid", "element", "inside")


@query(f"""WITH {_POINTS}, {_BOX_SQL}, n AS (SELECT element, cx + a * w / 2 AS nx, cy + b * h / 2 AS ny, cx + a * w / 2 + 2 * (cy + b * h / 2) AS z FROM box, (VALUES (-1, -1), (1, -1), (1, 1), (-1, 1)) c(a, b)),
 d AS (SELECT pid, sqrt(pow(px - nx, 2) + pow(py - ny, 2)) AS d, z FROM pts JOIN n ON element = pid % 8)
SELECT pid, round(coalesce(avg(z) FILTER (d = 0), sum(z / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0)), 8) AS z FROM d GROUP BY 1""")
def element_elevation(spark: SparkSession, d: str) -> DataFrame:
    nodes = _elements(spark).select("element", F.explode("ring").alias("p")).select("element", F.col("p.x").alias("nx"), F.col("p.y").alias("ny"), (F.col("p.x") + 2 * F.col("p.y")).alias("z"))
    return rounded(interpolation.element_value(_points(spark, d).select("pid", (F.col("pid") % 8).cast("int").alias("element"), "px", "py"), nodes, ["z"]), 8, "z")


@query("SELECT p_partkey, CAST(p_partkey // 60 + 1 AS INTEGER) AS layer, CAST(p_partkey // 12 % 5 + 1 AS INTEGER) AS row, CAST(p_partkey % 12 + 1 AS INTEGER) AS col FROM part")
def node_cells(spark: SparkSession, d: str) -> DataFrame:
    layer, row, col = tables.cell_of_node(F.col("p_partkey") + 1, 5, 12)
    return table(spark, d, "part").select("p_partkey", layer.alias("layer"), row.alias("row"), col.alias("col"))


@query("""SELECT event_id, CAST(i AS INTEGER) AS i, round(CASE WHEN least(value - 20, user_id::DOUBLE) >= 0 THEN sqrt(CASE i WHEN 0 THEN value - 20 ELSE user_id END) ELSE CASE i WHEN 0 THEN value - 20 ELSE user_id END END, 8) AS v FROM events, range(0, 2) t(i)""")
def guarded_transform(spark: SparkSession, d: str) -> DataFrame:
    values = numeric.transform_shares("sqrt", F.array(F.col("value") - 20, F.col("user_id").cast("double")))
    return table(spark, d, "events").select("event_id", F.posexplode(values).alias("i", "v")).select("event_id", "i", F.round("v", 8).alias("v"))


@query("SELECT p_partkey, 3 AS line_no, 'OPTIONS' AS block, 'NNEAR' AS word, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 7, 'CLASSES', p_brand, NULL FROM part")
def block_items(spark: SparkSession, d: str) -> DataFrame:
    text = F.array(F.lit("* a heading"), F.lit("BEGIN OPTIONS"), F.concat(F.lit("  NNEAR  "), F.col("p_size").cast("string"), F.lit(" # neighbours")), F.lit("END OPTIONS"), F.lit(" loose"), F.lit("begin Classes"), F.concat(F.lit("\t"), "p_brand"), F.lit("   # none"), F.lit("END"))
    lines = table(spark, d, "part").select("p_partkey", F.posexplode(text).alias("n", "line")).select("p_partkey", (F.col("n") + 1).alias("line_no"), "line")
    return tables.block_items(lines, ["p_partkey"], "line_no", "line").select("p_partkey", "line_no", "block", F.get("words", F.lit(0)).alias("word"), F.get("words", F.lit(1)).alias("value"))
