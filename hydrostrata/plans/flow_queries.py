"""Flow-input queries on the carrier tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.functions.strings import composite_id, glob
from hydrostrata.operators import flow
from hydrostrata.sources.tables import table

from .series_queries import rounded

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH o AS (SELECT CAST(user_id % 5 AS INTEGER) AS season, user_id AS field, min(CAST(ts AS DATE)) AS own FROM events WHERE value > 120 GROUP BY 1, 2),
 r AS (SELECT season, CAST(own + 1 AS DATE) AS a FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY own, field) AS n FROM o) WHERE n = 4)
SELECT season, field, own, least(own, coalesce(a, own)) AS start FROM o LEFT JOIN r USING (season)""")
def irrigation_starts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("value > 120").select((F.col("user_id") % 5).cast("int").alias("season"), F.col("user_id").alias("field"), F.to_date("ts").alias("day"))
    return flow.irrigation_starts(rows, 4)


@query("""WITH i AS (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, s_suppkey AS seg, s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey) AS p FROM supplier)
SELECT seg, round(v * p, 4) AS flow FROM i JOIN s USING (k)""")
def inflow_shares(spark: SparkSession, d: str) -> DataFrame:
    inflow = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("v"))
    seg = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("seg"), "s_acctbal")
    return rounded(flow.shares(inflow, seg, ["k"], "v", "s_acctbal").select("seg", "flow"), 4, "flow")


@query("""WITH m AS (SELECT n_nationkey AS ditch, CAST(unnest(range(1, 13)) AS INTEGER) AS month, n_regionkey FROM nation), l AS (SELECT ditch, month, (month - 6) * n_regionkey * 1.0 AS leakage FROM m)
SELECT ditch, month, s_suppkey AS cell, round(leakage / count(*) OVER (PARTITION BY ditch, month), 8)::DOUBLE AS rate FROM l JOIN supplier ON s_nationkey = ditch WHERE leakage > 0""")
def ditch_wells(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "supplier").select(F.col("s_nationkey").alias("ditch"), F.col("s_suppkey").alias("cell"))
    monthly = table(spark, d, "nation").select(F.col("n_nationkey").alias("ditch"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), "n_regionkey")
    monthly = monthly.select("ditch", "month", ((F.col("month") - 6) * F.col("n_regionkey") * F.lit(1.0)).alias("leakage"))
    return rounded(flow.ditch_wells(cells, monthly), 8, "rate")


@query("SELECT user_id, round(avg(value) * (1 - count(*) FILTER (event_type = 'click') / count(*)), 6) AS et, count(*) AS days FROM events GROUP BY 1")
def unused_et(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.col("event_type") == "click").alias("active"), "value")
    return rounded(flow.unused_et(rows, ["user_id"], "active", "value"), 6, "et")


@query("SELECT l_suppkey, min(l_linenumber) AS layer FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30 GROUP BY 1")
def top_active_layer(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("layer"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30), 1).otherwise(0).alias("active"))
    return flow.top_active(cells, ["l_suppkey"], "layer", "active")


@query("SELECT event_id, round(CASE WHEN value / 300 <= 0 THEN 1 WHEN value / 300 < 0.3 THEN 1 + value / 300 * ((0.5 - 1) / 0.3) WHEN value / 300 < 0.7 THEN 0.5 + (value / 300 - 0.3) * ((0.1 - 0.5) / (0.7 - 0.3)) WHEN value / 300 < 1 THEN 0.1 + (value / 300 - 0.7) * ((0 - 0.1) / (1 - 0.7)) ELSE 0 END, 8)::DOUBLE AS share FROM events")
def et_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(flow.et_by_depth(F.col("value"), 300.0, [(0.3, 0.5), (0.7, 0.1)]), 8).alias("share"))


@query("""WITH c AS (SELECT p_partkey, p_brand, p_size * 1.0::DOUBLE AS k, p_retailprice AS w FROM part), l AS (SELECT *, lead(k) OVER o AS k2, lead(w) OVER o AS w2 FROM c WINDOW o AS (PARTITION BY p_brand ORDER BY p_partkey))
SELECT p_partkey, round(2 * CASE WHEN abs(k2 / k - 1) < 0.005 THEN (k + k2) / 2 ELSE (k2 - k) / ln(k2 / k) END / (w + w2), 9) AS conductance FROM l""")
def cell_conductance(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") * F.lit(1.0)).alias("k"), F.col("p_retailprice").alias("w"))
    return rounded(flow.conductance(cells, "p_partkey", ["p_brand"], "k", "w").select("p_partkey", "conductance"), 9, "conductance")


_GRID_SQL = "g AS (SELECT CAST(p_partkey // 20 AS INTEGER) AS row, CAST(p_partkey % 20 AS INTEGER) AS col, p_retailprice AS v FROM part)"


@query(f"""WITH {_GRID_SQL}, p AS (SELECT s_suppkey AS id, CAST(s_suppkey % 9 AS INTEGER) AS row, CAST(s_nationkey % 20 AS INTEGER) AS col, (s_suppkey % 5) / 10 - 0.2 AS roff, (s_suppkey % 7) / 14 - 0.25 AS coff FROM supplier),
 c AS (SELECT id, row, col, (1 - abs(roff)) * (1 - abs(coff)) AS w FROM p UNION ALL SELECT id, row + CASE WHEN roff >= 0 THEN 1 ELSE -1 END, col, abs(roff) * (1 - abs(coff)) FROM p
  UNION ALL SELECT id, row, col + CASE WHEN coff >= 0 THEN 1 ELSE -1 END, (1 - abs(roff)) * abs(coff) FROM p UNION ALL SELECT id, row + CASE WHEN roff >= 0 THEN 1 ELSE -1 END, col + CASE WHEN coff >= 0 THEN 1 ELSE -1 END, abs(roff) * abs(coff) FROM p)
SELECT id, round(sum(w * v) / sum(w), 6) AS v FROM c JOIN g USING (row, col) WHERE w > 0 GROUP BY id""")
def bilinear_heads(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).cast("int").alias("row"), (F.col("p_partkey") % 20).cast("int").alias("col"), F.col("p_retailprice").alias("v"))
    s = F.col("s_suppkey")
    points = table(spark, d, "supplier").select(s.alias("id"), (s % 9).cast("int").alias("row"), (F.col("s_nationkey") % 20).cast("int").alias("col"), ((s % 5) / 10 - 0.2).alias("roff"), ((s % 7) / 14 - 0.25).alias("coff"))
    return rounded(flow.at_point(cells, points, "v"), 6, "v")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b, max(o_totalprice) AS m FROM orders)
SELECT CAST(k AS INTEGER) AS class, round(CASE WHEN k < 5 THEN a + k * (b - a) / 5 ELSE m END, 5) AS break FROM q, range(0, 6) r(k)""")
def class_breaks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(flow.class_breaks(table(spark, d, "orders"), "o_totalprice"), 5, "break")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_quantity * (1 + l_tax), 8) AS f1, round(l_quantity * (1 + l_tax) * (1 - l_discount), 8) AS f2 FROM lineitem WHERE l_quantity > 48")
def parameter_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_quantity > 48").withColumns({"f1": 1 + F.col("l_tax"), "f2": 1 - F.col("l_discount")})
    return rounded(flow.chained(rows, ["f1", "f2"], "l_quantity").select("l_orderkey", "l_linenumber", "l_extendedprice", "f1", "f2"), 8, "f1", "f2")


@query("SELECT p_partkey, p_name GLOB 's*r?ng' AS matches, upper(p_brand) GLOB 'BRAND#[1-3]*' AS low_brand, p_brand || '_' || p_size AS id FROM part")
def glob_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", glob(F.col("p_name"), "s*r?ng").alias("matches"), glob(F.col("p_brand"), "brand#[1-3]*", True).alias("low_brand"), composite_id("p_brand", "p_size").alias("id"))
