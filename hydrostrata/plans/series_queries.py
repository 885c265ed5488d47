"""Series, weighting and skill queries on the carrier tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.operators import metrics, quantiles, relational, series, weighting
from hydrostrata.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum(l_extendedprice), 2) AS volume, count(*) AS n FROM lineitem GROUP BY 1")
def gage_volume_month(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.calendar_sums(table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice", "month"), 2, "volume")


@query("SELECT CAST(year(l_shipdate + INTERVAL 3 MONTH) AS INTEGER) AS water_year, round(sum(l_extendedprice), 2) AS volume, count(*) AS n FROM lineitem GROUP BY 1")
def gage_volume_water_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.calendar_sums(table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice", "water_year"), 2, "volume")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.4) AS a, quantile_cont(o_totalprice, 0.8) AS b FROM orders)
SELECT o_orderkey, CAST((o_totalprice > a)::INT + (o_totalprice > b)::INT AS INTEGER) AS flow_group,
 round(1e10 / pow(o_totalprice * CASE WHEN o_totalprice > b THEN 0.5 WHEN o_totalprice > a THEN 0.2 ELSE 0.1 END, 2), 6) AS weight FROM orders, q""")
def flow_groups_cv_weights(spark: SparkSession, d: str) -> DataFrame:
    out = weighting.flow_cv(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", [0.4, 0.8], [0.1, 0.2, 0.5])
    return out.select("o_orderkey", "flow_group", F.round(F.col("weight") * 1e10, 6).alias("weight"))


@query("""SELECT o_orderkey, round(CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice * 800.0 / t WHEN '5-LOW' THEN o_totalprice * 50.0 / t ELSE o_totalprice END, 6) AS balanced
FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS t FROM orders)""")
def metagroup_balance(spark: SparkSession, d: str) -> DataFrame:
    out = weighting.balance(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", {"1-URGENT": 800, "5-LOW": 50})
    return out.select("o_orderkey", F.round("balanced", 6).alias("balanced"))


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-06-30' OR CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-31' THEN 0.0::DOUBLE ELSE o_totalprice END AS weight FROM orders")
def zero_weight_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return weighting.zero_ranges(rows, "day", "o_totalprice", [("1996-03-01", "1996-06-30"), ("1998-01-01", "1998-01-31")]).select("o_orderkey", "weight")


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS diff FROM events")
def head_diffs(spark: SparkSession, d: str) -> DataFrame:
    out = series.differences(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")
    return rounded(out.select("event_id", "diff"), 6, "diff")


_DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, event_type, sum(value) AS value FROM events GROUP BY ALL"


def _daily(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), *more).agg(F.sum("value").alias("value"))


@query(f"WITH x AS ({_DAILY}) SELECT a.user_id, a.day, round(a.value - b.value, 6) AS diff FROM x a JOIN x b USING (user_id, day) WHERE a.event_type = 'click' AND b.event_type = 'view'")
def paired_series_diff(spark: SparkSession, d: str) -> DataFrame:
    daily = _daily(spark, d, "event_type")
    return rounded(series.paired_difference(daily.where("event_type = 'click'"), daily.where("event_type = 'view'"), ["user_id", "day"], "value"), 6, "diff")


@query("SELECT event_id, round(CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_mean_centered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.rolling(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 5, 3, "mean", "mean").select("event_id", "mean"), 6, "mean")


@query("""SELECT event_id, round(m, 6) AS median, CASE WHEN m - value > 20 THEN 0.25 ELSE 1.0 END::DOUBLE AS weight FROM (
 SELECT event_id, value, CASE WHEN count(value) OVER w >= 5 THEN quantile_cont(value, 0.5) OVER w END AS m FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))""")
def rolling_median_outliers(spark: SparkSession, d: str) -> DataFrame:
    out = weighting.outlier_rule(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 9, 5, 20.0, 0.25)
    return rounded(out.select("event_id", "median", "weight"), 6, "median")


@query("SELECT event_id, round(CASE WHEN n < 50 THEN 0.0 ELSE 1.0 / n END, 9) AS weight FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def by_well_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weighting.by_count(table(spark, d, "events").select("event_id", "user_id"), "user_id", 1.0, 50).select("event_id", "weight"), 9, "weight")


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 AND CAST(ts AS DATE) > DATE '2024-01-15' THEN 0.0 ELSE value END::DOUBLE AS weight FROM events""")
def after_date_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "value")
    rules = rows.where("user_id % 3 = 0").select(F.col("user_id").alias("well")).distinct().withColumn("cutoff", F.lit("2024-01-15").cast("date"))
    return weighting.after_date(rows, "user_id", "day", "value", rules).select("event_id", "weight")


_DENSE = f"""x AS (SELECT user_id, day, sum(value) AS value FROM ({_DAILY}) GROUP BY ALL),
 days AS (SELECT user_id, CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM x GROUP BY user_id),
 dense AS (SELECT user_id, day, value FROM days LEFT JOIN x USING (user_id, day))"""


@query(f"WITH {_DENSE} SELECT user_id, day, round(value, 6) AS value FROM dense")
def densify_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.densify(_daily(spark, d), ["user_id"], "day", "value"), 6, "value")


@query(f"""WITH {_DENSE}, k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER b AS pd, last_value(value IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER a AS nd, first_value(value IGNORE NULLS) OVER a AS nv FROM dense
  WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, day, round(CASE WHEN value IS NOT NULL THEN value ELSE pv + (nv - pv) * (day - pd) / (nd - pd) END, 5) AS value FROM k""")
def gap_linear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.interpolate_gaps(series.densify(_daily(spark, d), ["user_id"], "day", "value"), ["user_id"], "day", "value"), 5, "value")


@query(f"""WITH {_DENSE}, p AS (SELECT user_id, day - DATE '1970-01-01' AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM dense WHERE value IS NOT NULL),
 i AS (SELECT a.user_id, a.n, a.c, (b.t - a.t)::DOUBLE AS h, (b.v - a.v) / (b.t - a.t) AS g FROM p a JOIN p b ON a.user_id = b.user_id AND b.n = a.n + 1),
 e AS (SELECT a.user_id, 1 AS n, a.g AS f, b.g AS s, ((2 * a.h + b.h) * a.g - a.h * b.g) / (a.h + b.h) AS e FROM i a LEFT JOIN i b ON a.user_id = b.user_id AND b.n = 2 WHERE a.n = 1
  UNION ALL SELECT a.user_id, a.c, a.g, b.g, ((2 * a.h + b.h) * a.g - a.h * b.g) / (a.h + b.h) FROM i a LEFT JOIN i b ON a.user_id = b.user_id AND b.n = a.n - 1 WHERE a.n = a.c - 1),
 m AS (SELECT user_id, n, CASE WHEN s IS NULL THEN f WHEN e * f <= 0 THEN 0 WHEN f * s < 0 AND abs(e) > 3 * abs(f) THEN 3 * f ELSE e END AS m FROM e
  UNION ALL SELECT a.user_id, b.n, CASE WHEN a.g * b.g > 0 THEN 3 * (a.h + b.h) / ((2 * b.h + a.h) / a.g + (b.h + 2 * a.h) / b.g) ELSE 0 END FROM i a JOIN i b ON a.user_id = b.user_id AND b.n = a.n + 1),
 s AS (SELECT x.user_id, x.t AS t0, i.h, x.v AS v0, y.v AS v1, mx.m AS m0, my.m AS m1 FROM p x JOIN i USING (user_id, n) JOIN p y ON y.user_id = x.user_id AND y.n = x.n + 1 JOIN m mx ON mx.user_id = x.user_id AND mx.n = x.n JOIN m my ON my.user_id = x.user_id AND my.n = y.n),
 r AS (SELECT d.user_id, day, value, s.*, (day - DATE '1970-01-01' - t0) / h AS u FROM dense d LEFT JOIN s ON s.user_id = d.user_id AND value IS NULL AND day - DATE '1970-01-01' > t0 AND day - DATE '1970-01-01' < t0 + h)
SELECT user_id, day, round(coalesce(value, (1 + 2 * u) * pow(1 - u, 2) * v0 + u * pow(1 - u, 2) * h * m0 + u * u * (3 - 2 * u) * v1 + u * u * (u - 1) * h * m1), 5) AS value FROM r""")
def gap_pchip(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.pchip_gaps(series.densify(_daily(spark, d), ["user_id"], "day", "value"), ["user_id"], "day", "value"), 5, "value")


@query("SELECT o_orderkey, round(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) / count(*) OVER (PARTITION BY o_orderstatus), 9) AS exceedance FROM orders")
def flow_duration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.duration_curve(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice", ["o_orderkey"]).select("o_orderkey", "exceedance"), 9, "exceedance")


@query("SELECT user_id, day, CAST(day - lag(day) OVER (PARTITION BY user_id ORDER BY day) - 1 AS INTEGER) AS skip_lines FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)")
def instruction_skips(spark: SparkSession, d: str) -> DataFrame:
    return series.skips(_daily(spark, d).select("user_id", "day"), ["user_id"], "day")


_OBS = "obs AS (SELECT l_returnflag AS grp, l_linestatus AS sub, l_orderkey, l_extendedprice AS obs, l_quantity * p_retailprice * 1.6 AS sim, l_discount * 10 AS wt FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _obs(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("sub"), "l_orderkey", F.col("l_extendedprice").alias("obs"), "l_quantity", (F.col("l_discount") * 10).alias("wt"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return items.join(part, "l_partkey").select("grp", "sub", "l_orderkey", "obs", (F.col("l_quantity") * F.col("p_retailprice") * 1.6).alias("sim"), "wt")


@query(f"""WITH {_OBS}, m AS (SELECT grp, sub, count(*) AS n, avg(obs - sim) AS me, avg(abs(obs - sim)) AS mae, sqrt(avg((obs - sim) * (obs - sim))) AS rmse,
  1 - sum((obs - sim) * (obs - sim)) / (var_pop(obs) * count(*)) AS nse, 100 * sum(obs - sim) / sum(obs) AS pbias,
  corr(obs, sim) AS r, stddev_pop(sim) / stddev_pop(obs) AS a, avg(sim) / avg(obs) AS b FROM obs GROUP BY grp, sub)
SELECT grp, sub, n, round(me, 4) AS me, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(nse, 6) AS nse, round(pbias, 6) AS pbias,
 round(1 - sqrt((r - 1) * (r - 1) + (a - 1) * (a - 1) + (b - 1) * (b - 1)), 6) AS kge, round(1 - sqrt((r - 1) * (r - 1) + (a / b - 1) * (a / b - 1) + (b - 1) * (b - 1)), 6) AS kge_prime FROM m""")
def skill_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(metrics.skill(_obs(spark, d), ["grp", "sub"]), 4, "me", "mae", "rmse"), 6, "nse", "pbias", "kge", "kge_prime")


@query(f"""WITH {_OBS}, z AS (SELECT grp || sub AS grp, CASE WHEN sub = 'O' AND l_orderkey % 7 = 0 THEN 0 ELSE obs END AS obs, sim FROM obs),
 g AS (SELECT grp, min(obs) AS lo, min(obs) FILTER (obs > 0) / 2 AS half FROM z GROUP BY grp),
 l AS (SELECT grp, ln(obs + CASE WHEN lo <= 0 THEN half ELSE 0 END) AS o, ln(sim + CASE WHEN lo <= 0 THEN half ELSE 0 END) AS s FROM z JOIN g USING (grp) WHERE lo > 0 OR obs > 0)
SELECT grp, round(1 - sum((o - s) * (o - s)) / (var_pop(o) * count(*)), 6) AS lnse FROM l GROUP BY grp""")
def log_skill_by_group(spark: SparkSession, d: str) -> DataFrame:
    zeros = F.when((F.col("sub") == "O") & (F.col("l_orderkey") % 7 == 0), 0.0).otherwise(F.col("obs"))
    return rounded(metrics.log_skill(_obs(spark, d).select(F.concat("grp", "sub").alias("grp"), zeros.alias("obs"), "sim"), ["grp"]), 6, "lnse")


@query(f"""WITH {_OBS}, w AS (SELECT l_orderkey % 400 AS well, CASE WHEN l_orderkey % 401 <> 0 THEN obs END AS obs, sim * CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE wt END AS sim, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE wt END AS wt FROM obs)
SELECT well, count(*) AS n, CASE WHEN count(*) >= 5 AND count(*) = count(obs) AND max(wt) <> 0 THEN round(sqrt(avg((obs - sim) * (obs - sim))), 3) END AS rmse, CASE WHEN count(*) >= 5 AND count(*) = count(obs) AND max(wt) <> 0 THEN round(1 - sum((obs - sim) * (obs - sim)) / (var_pop(obs) * count(*)), 6) END AS nse FROM w GROUP BY well""")
def weighted_skill_by_well(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("l_orderkey")
    rows = _obs(spark, d).select((key % 400).alias("well"), F.when(key % 401 != 0, F.col("obs")).alias("obs"), "sim", F.when(key % 5 == 0, 0.0).otherwise(F.col("wt")).alias("wt"))
    return rounded(rounded(metrics.skill(rows, ["well"], weight="wt").select("well", "n", "rmse", "nse"), 3, "rmse"), 6, "nse")


@query(f"""WITH {_OBS}, p AS (SELECT grp, sub, sum(pow(wt * (obs - sim) / 1000, 2)) AS phi, count(*) FILTER (wt <> 0) AS n_weighted FROM obs GROUP BY grp, sub)
SELECT grp, sub, round(phi, 3) AS phi, n_weighted, round(phi / sum(phi) OVER (), 8) AS share FROM p""")
def phi_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = _obs(spark, d).withColumns({"obs": F.col("obs") / 1000, "sim": F.col("sim") / 1000})
    return rounded(rounded(metrics.objective(rows, ["grp", "sub"]), 3, "phi"), 8, "share")


@query("SELECT o_orderpriority, round(stddev_samp(o_totalprice) / avg(o_totalprice), 8) AS cv, count(*) AS n FROM orders GROUP BY 1")
def cv_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.variation(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), 8, "cv")


@query("""WITH c AS (SELECT user_id, CAST(event_id % 2 AS INTEGER) AS half, count(*) AS t, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY 1, 2),
 p AS (SELECT a.user_id, CAST(a.user_id % 5 AS INTEGER) AS fold, a.c / a.t AS a1, a.v / a.t AS a2, 1 - a.c / a.t - a.v / a.t AS a3, 1.3 * b.c / b.t AS b1, b.v / b.t - 0.1 AS b2, 1.1 - 1.3 * b.c / b.t - b.v / b.t AS b3 FROM c a JOIN c b ON a.user_id = b.user_id AND a.half = 0 AND b.half = 1)
SELECT fold, round(avg((a1 - b1) * (a1 - b1) + (a2 - b2) * (a2 - b2) + (a3 - b3) * (a3 - b3)), 8) AS brier, round(avg((abs(a1 - b1) + abs(a2 - b2) + abs(a3 - b3)) / 3), 8) AS mae,
 round(avg(CASE WHEN (CASE WHEN a1 >= a2 AND a1 >= a3 THEN 1 WHEN a2 >= a3 THEN 2 ELSE 3 END) <> (CASE WHEN b1 >= b2 AND b1 >= b3 THEN 1 WHEN b2 >= b3 THEN 2 ELSE 3 END) THEN 1.0 ELSE 0.0 END), 8) AS misclassified,
 round(sum((b1 < 0 OR b1 > 1)::INT + (b2 < 0 OR b2 > 1)::INT + (b3 < 0 OR b3 > 1)::INT) / (3 * count(*)), 8) AS out_of_bounds, count(*) AS n FROM p GROUP BY fold""")
def cv_scores(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 2).alias("half")).agg(F.count("*").alias("t"), F.count_if(F.col("event_type") == "click").alias("c"), F.count_if(F.col("event_type") == "view").alias("v"))
    c = c.select("user_id", "half", F.array(F.col("c") / F.col("t"), F.col("v") / F.col("t"), 1 - F.col("c") / F.col("t") - F.col("v") / F.col("t")).alias("p"))
    guess = F.array(1.3 * F.col("p")[0], F.col("p")[1] - 0.1, 1.1 - 1.3 * F.col("p")[0] - F.col("p")[1])  # some out of bounds
    pairs = c.where("half = 0").select("user_id", F.col("p").alias("truth")).join(c.where("half = 1").select("user_id", guess.alias("guess")), "user_id")
    return rounded(metrics.class_scores(pairs.withColumn("fold", (F.col("user_id") % 5).cast("int")), ["fold"], "truth", "guess"), 8, "brier", "mae", "misclassified", "out_of_bounds")


@query("SELECT l_suppkey, l_returnflag, round(css / sum(css) OVER (PARTITION BY l_suppkey) * sqrt(css), 6) AS scaled FROM (SELECT l_suppkey, l_returnflag, avg(l_discount) AS css FROM lineitem GROUP BY 1, 2)")
def scaled_sensitivities(spark: SparkSession, d: str) -> DataFrame:
    css = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_discount").alias("css"))
    return metrics.scaled_sensitivity(css, ["l_suppkey"], "css").select("l_suppkey", "l_returnflag", F.round("scaled", 6).alias("scaled"))


@query("""WITH c AS (SELECT l_shipdate < TIMESTAMP '1998-07-01' AS early, CAST(l_quantity AS INTEGER) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
 p AS (SELECT q, sum(CASE WHEN early THEN n ELSE 0 END) / (SELECT sum(n) FROM c WHERE early) AS p, sum(CASE WHEN early THEN 0 ELSE n END) / (SELECT sum(n) FROM c WHERE NOT early) AS q2 FROM c GROUP BY q)
SELECT q % 2 AS half, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q2) / 2)) ELSE 0 END + CASE WHEN q2 > 0 THEN q2 * ln(q2 / ((p + q2) / 2)) ELSE 0 END) / 2, 9) AS divergence FROM p GROUP BY 1""")
def distribution_divergence(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    early = F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp")
    c = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"))
    w = Window.partitionBy()  # one row a quantity
    p = c.select("q", (F.col("a") / F.sum("a").over(w)).alias("p"), (F.col("b") / F.sum("b").over(w)).alias("r"))
    return rounded(metrics.jensen_shannon(p.withColumn("half", F.col("q") % 2), ["half"], "p", "r"), 9, "divergence")


@query("SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, median(o_totalprice) AS median, round(quantile_cont(o_totalprice, 0.05), 6) AS p05, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, round(stddev_pop(o_totalprice), 4) AS sd_pop FROM orders")
def global_statistics(spark: SparkSession, d: str) -> DataFrame:
    v, orders = "o_totalprice", table(spark, d, "orders")
    median, p05, p95 = (F.lit(q).cast("double") for q in quantiles.quantiles(orders, v, [0.5, 0.05, 0.95]))
    return orders.agg(F.round(F.sum(v), 2).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("sd_pop")).select("total", "mean", median.alias("median"), F.round(p05, 6).alias("p05"), F.round(p95, 6).alias("p95"), "sd_pop")


@query(f"WITH {_OBS} SELECT l_orderkey, obs, round(pow(wt * (obs - sim) / 1000, 2), 5) AS phi FROM obs WHERE wt <> 0 ORDER BY pow(wt * (obs - sim) / 1000, 2) DESC, l_orderkey, obs LIMIT 10")
def topk_residuals(spark: SparkSession, d: str) -> DataFrame:
    r = F.pow(F.col("wt") * (F.col("obs") - F.col("sim")) / 1000, F.lit(2.0))
    return relational.top(_obs(spark, d).where("wt <> 0").withColumn("phi", r), [F.desc("phi"), F.col("l_orderkey"), F.col("obs")], 10).select("l_orderkey", "obs", F.round("phi", 5).alias("phi"))
