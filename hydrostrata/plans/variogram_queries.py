"""Queries of fitted variograms and their model lines and blocks, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.operators import interpolation, variogram
from hydrostrata.sources import sinks
from hydrostrata.sources.tables import table

from .series_queries import rounded
from .spatial_queries import _points

QUERIES, ORACLE_SQL = {}, {}

#: Fields on the carrier points: one with structure, one without, and a constant one.
_FIELDS = {"wave": ("sin", "cos"), "plain": (), "level": ()}
_LAG, _BINS = 0.02, 10


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _fields(spark: SparkSession, d: str) -> DataFrame:
    value = {"wave": F.sin(14 * F.col("px")) + F.cos(9 * F.col("py")) + 0.2 * F.col("v"), "plain": F.col("v"), "level": F.lit(1.5)}
    return _points(spark, d).select("pid", "px", "py", *(value[name].alias(name) for name in _FIELDS))


_PTS = """pts AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS v FROM embeddings),
 val AS (SELECT pid, px, py, 'wave' AS field, sin(14 * px) + cos(9 * py) + 0.2 * v AS v FROM pts UNION ALL SELECT pid, px, py, 'plain', v FROM pts UNION ALL SELECT pid, px, py, 'level', 1.5 FROM pts),
 d AS (SELECT field, a.v - b.v AS dv, a.px - b.px AS dx, a.py - b.py AS dy, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS h FROM val a JOIN val b USING (field) WHERE a.pid < b.pid)"""
_RISE = {"spherical": "CASE WHEN h < exp(lr) THEN 1.5 * h / exp(lr) - 0.5 * pow(h / exp(lr), 3) ELSE 1 END", "exponential": "1 - exp(-3 * h / exp(lr))"}


def _fit_sql(kind: str, weight: str = "w") -> str:
    """CTEs from g (grp, h, g, w) to fit (grp, reach, scale, nugget, sill, r2, at_bound): the same bracket, pass by pass."""
    steps = [f"gg AS (SELECT grp, h, g, {weight} AS w FROM g WHERE h > 0)", "lim AS (SELECT grp, ln(min(h) / 2) AS lo, ln(max(h) * 10) AS hi, sum(w) AS n, sum(w * g) / sum(w) AS mg, count(*) AS bins FROM gg GROUP BY 1)"]
    steps.append("t AS (SELECT grp, sum(w * (g - mg) * (g - mg)) AS total FROM gg JOIN lim USING (grp) GROUP BY 1)")
    for k in range(variogram.ROUNDS + 1):
        n = variogram.STEPS if k else variogram.FIRST
        steps.append(f"c{k} AS (SELECT grp, a, b, a + (b - a) * k / {n} AS lr FROM (SELECT grp, {'lo AS a, hi AS b FROM lim' if not k else f'greatest(lr - (b - a) / {variogram.STEPS if k > 1 else variogram.FIRST}, a) AS a, least(lr + (b - a) / {variogram.STEPS if k > 1 else variogram.FIRST}, b) AS b FROM o{k - 1}'}), range({n + 1}) r(k))")
        steps.append(f"f{k} AS (SELECT grp, a, b, lr, g, w, n, mg, {_RISE[kind]} AS f FROM c{k} JOIN gg USING (grp) JOIN lim USING (grp))")
        steps.append(f"m{k} AS (SELECT grp, lr, sum(w * f) / max(n) AS mf FROM f{k} GROUP BY 1, 2)")
        steps.append(f"s{k} AS (SELECT grp, lr, any_value(a) AS a, any_value(b) AS b, any_value(mg) AS mg, any_value(mf) AS mf, any_value(n) AS n, sum(w * (f - mf) * (f - mf)) AS var, sum(w * (f - mf) * (g - mg)) AS cross_, sum(w * f * g) / sum(w * f * f) AS through FROM f{k} JOIN m{k} USING (grp, lr) GROUP BY 1, 2)")
        steps.append(f"p{k} AS (SELECT *, CASE WHEN mg - c1 * mf < 0 THEN through ELSE c1 END AS sill, greatest(mg - c1 * mf, 0) AS nugget FROM (SELECT *, CASE WHEN var > 1e-12 * n THEN greatest(cross_ / var, 0) ELSE 0 END AS c1 FROM s{k}))")
        steps.append(f"q{k} AS (SELECT grp, lr, any_value(p.a) AS a, any_value(p.b) AS b, any_value(nugget) AS nugget, any_value(sill) AS sill, CASE WHEN any_value(total) > 0 THEN 1 - sum(w * pow(g - nugget - sill * f, 2)) / any_value(total) ELSE 0 END AS r2 FROM f{k} JOIN p{k} p USING (grp, lr) JOIN t USING (grp) GROUP BY 1, 2)")
        steps.append(f"o{k} AS (SELECT * FROM q{k} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY r2 DESC, lr) = 1)")
    steps.append(f"z AS (SELECT *, bins < 2 OR r2 < {variogram.FLAT} OR sill <= 0 AS flat FROM o{variogram.ROUNDS} JOIN lim USING (grp))")
    steps.append(f"fit AS (SELECT grp, CASE WHEN NOT flat THEN exp(lr) END AS reach, CASE WHEN NOT flat THEN exp(lr) * {variogram.SCALES[kind]!r} END AS scale, CASE WHEN flat THEN mg ELSE nugget END AS nugget, CASE WHEN flat THEN 0 ELSE sill END AS sill, CASE WHEN flat THEN 0 ELSE r2 END AS r2, NOT flat AND least(lr - lo, hi - lr) < 1e-6 AS at_bound FROM z)")
    return ",\n ".join(steps)


_ALL_BINS = f"g AS (SELECT field AS grp, avg(dv * dv) / 2 AS g, count(*)::DOUBLE AS w, avg(h) AS h FROM d WHERE h < {_LAG * _BINS} GROUP BY field, floor(h / {_LAG}))"


def _fits(spark: SparkSession, d: str, kind: str, weights: str = "pairs") -> DataFrame:
    bins = interpolation.empirical_variograms(_fields(spark, d), list(_FIELDS), _LAG, _BINS).withColumnRenamed("value", "field")
    return variogram.fit_variogram(bins, kind, ["field"], weights)


@query(f"WITH {_PTS}, {_ALL_BINS},\n {_fit_sql('spherical')}\nSELECT grp AS field, round(reach, 4) AS reach, round(scale, 4) AS scale, round(nugget, 6) AS nugget, round(sill, 6) AS sill, round(r2, 6) AS r2, at_bound FROM fit")
def variogram_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(_fits(spark, d, "spherical"), 4, "reach", "scale"), 6, "nugget", "sill", "r2")


@query(f"WITH {_PTS}, {_ALL_BINS},\n {_fit_sql('exponential', 'w / (h * h)')}\nSELECT grp AS field, CAST(k AS INTEGER) AS step, round(k * 0.01::DOUBLE, 6) AS distance, round(nugget + coalesce(sill * (1 - exp(-3 * k * 0.01 / reach)), 0), 5) AS gamma FROM fit, range(1, 21) r(k)")
def variogram_model_line(spark: SparkSession, d: str) -> DataFrame:
    line = variogram.variogram_line(_fits(spark, d, "exponential", "pairs_by_distance"), "exponential", _LAG * _BINS, 20)
    return rounded(rounded(line.select("field", "step", "distance", "gamma"), 6, "distance"), 5, "gamma")


_COS = repr(math.cos(math.radians(30)))
_DIRECTIONS = {"north": 0.0, "east": 90.0}
_DIRECTED = ", ".join(["e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS grp, dv, h FROM d WHERE field = 'wave' AND h > 0 AND h < {_LAG * _BINS} AND abs(dx * {math.sin(math.radians(a))!r} + dy * {math.cos(math.radians(a))!r}) >= h * {_COS}" for n, a in _DIRECTIONS.items()) + ")", f"g AS (SELECT grp, avg(dv * dv) / 2 AS g, count(*)::DOUBLE AS w, avg(h) AS h FROM e GROUP BY grp, floor(h / {_LAG}))"])


@query(f"WITH {_PTS}, {_DIRECTED},\n {_fit_sql('spherical')}\nSELECT f.grp AS direction, round(f.reach / m.reach, 4) AS ratio FROM fit f, fit m WHERE m.grp = 'north'")
def variogram_anisotropy(spark: SparkSession, d: str) -> DataFrame:
    bins = interpolation.directional_variograms(_fields(spark, d), "wave", _LAG, _BINS, _DIRECTIONS, 30.0)
    fits = variogram.fit_variogram(bins, "spherical", ["direction"])
    return rounded(variogram.anisotropy(fits, [], "direction", "north"), 4, "ratio")


@query("""WITH m AS (SELECT p_brand AS class, CAST(p_size AS INTEGER) AS structure, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS n, 1000.0 * p_size AS reach FROM (SELECT DISTINCT p_brand, p_size FROM part))
SELECT 0 AS part, NULL AS class, 0 AS structure, 'BEGIN VARIOGRAMS' AS value UNION ALL SELECT 0, NULL, 1, '  # Structure Vtype  Nugget  Sill  Range_min Range_max ang1  nnear'
UNION ALL SELECT DISTINCT 1, class, 0, '  CLASS ' || class FROM m UNION ALL SELECT 1, class, structure, '           ' || structure || '    Exp    0.013   0.250    ' || printf('%.2E', reach) || '       ' || printf('%.2E', reach * 2) || '  45.0    16' FROM m
UNION ALL SELECT 2, NULL, 0, 'END VARIOGRAMS'""")
def variogram_block(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select(F.col("p_brand").alias("class"), F.col("p_size").cast("int").alias("structure")).distinct()
    numbers = {"nugget": F.lit(0.0125), "sill": F.lit(0.25), "range_min": 1000.0 * F.col("structure"), "range_max": 2000.0 * F.col("structure"), "angle": F.lit(45.0)}
    return sinks.variogram_lines(m.withColumns({"kind": F.lit("Exp"), "nnear": F.lit(16), **numbers}))
