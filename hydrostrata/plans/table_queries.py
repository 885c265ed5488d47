"""Relational, budget and learning queries on the carrier tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydrostrata.functions.numeric import transform
from hydrostrata.operators import budget, learning, relational, texture, weighting
from hydrostrata.sources import sinks
from hydrostrata.sources.tables import sections, table

from .series_queries import rounded

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_acctbal")


@query("SELECT n_name, r_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def lookup_joins(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    r = table(spark, d, "region").where("r_regionkey < 3").withColumnRenamed("r_regionkey", "n_regionkey")
    return s.join(table(spark, d, "nation"), "n_nationkey").join(r, "n_regionkey", "left").select("n_name", "r_name", "s_suppkey")


@query("SELECT 'customer' AS kind, c_nationkey AS nation, round(c_acctbal, 2) AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, round(s_acctbal, 2) FROM supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, p: table(spark, d, t).select(F.lit(t).alias("kind"), F.col(f"{p}_nationkey").alias("nation"), F.round(f"{p}_acctbal", 2).alias("balance"))
    return part("customer", "c").unionByName(part("supplier", "s"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 5), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 5)
SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    few = table(spark, d, "lineitem").where("l_quantity < 5").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return relational.differences_both_ways(few.where("l_returnflag = 'A'"), few.where("l_returnflag = 'R'"), ["k"])


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_type").dropDuplicates()


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT k, max_by(v, p) AS v FROM (SELECT c_nationkey AS k, max(c_custkey) AS v, 1 AS p FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, max(s_suppkey), 2 FROM supplier GROUP BY 1) GROUP BY k")
def right_wins_merge(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t, p, c: table(spark, d, t).groupBy(F.col(f"{p}_nationkey").alias("k")).agg(F.max(c).alias("v"))
    return relational.right_wins(side("customer", "c", "c_custkey"), side("supplier", "s", "s_suppkey"), ["k"])


@query("""WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT o_custkey AS k FROM orders)
SELECT k, 'repeated_right' AS problem FROM b GROUP BY k HAVING count(*) > 1 UNION ALL SELECT k, 'missing' FROM a WHERE k NOT IN (SELECT k FROM b)""")
def one_to_one_check(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    return relational.one_to_one(a, b, ["k"])[1]


@query("""WITH a AS (SELECT event_id AS ea, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS eb, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view')
SELECT user_id, ea, eb FROM a JOIN b USING (user_id, n)""")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    e = lambda kind, name: table(spark, d, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("ts").alias(f"ts_{name}"), "user_id")
    return relational.positional_join(e("click", "ea"), ["ts_ea", "ea"], e("view", "eb"), ["ts_eb", "eb"], ["user_id"]).select("user_id", "ea", "eb")


_WIDE = "wide AS (SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS q_1, sum(l_quantity) FILTER (l_returnflag = 'N') AS q_2, sum(l_quantity) FILTER (l_returnflag = 'R') AS q_3, round(sum(l_discount) FILTER (l_returnflag = 'A'), 6) AS d_1, round(sum(l_discount) FILTER (l_returnflag = 'N'), 6) AS d_2 FROM lineitem GROUP BY 1)"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    q = relational.long_to_wide(items, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "l_quantity")
    c = relational.long_to_wide(items, ["l_suppkey"], "l_returnflag", ["A", "N"], "l_discount")
    q = q.withColumnsRenamed({"A": "q_1", "N": "q_2", "R": "q_3"})
    return q.join(c.select("l_suppkey", F.round("A", 6).alias("d_1"), F.round("N", 6).alias("d_2")), "l_suppkey")


@query(f"WITH {_WIDE} SELECT * FROM wide")
def long_to_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d)


@query(f"WITH {_WIDE} SELECT l_suppkey, 1::INTEGER AS point, q_1 AS q, d_1 AS d FROM wide UNION ALL SELECT l_suppkey, 2, q_2, d_2 FROM wide UNION ALL SELECT l_suppkey, 3, q_3, NULL FROM wide")
def wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    return relational.wide_to_long(_wide(spark, d), ["l_suppkey"], ["q", "d"], [1, 2, 3])


@query("SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END END::DOUBLE AS is_ECONOMY, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN CASE WHEN p_type = 'STANDARD' THEN 1.0 ELSE 0.0 END END::DOUBLE AS is_STANDARD FROM part")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return relational.one_hot(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["ECONOMY", "STANDARD"]).drop("p_type")


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, upper(split_part(p_name, ' ', 2)) AS second_word, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand_no, CAST(p_partkey AS VARCHAR) || '_' || CAST(p_size AS VARCHAR) AS id, regexp_extract(p_name, '^(\\w)', 1) AS initial, length(p_name) AS n, p_name LIKE '%ring%' AS ring FROM part")
def string_columns(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(
        "p_partkey", words[0].alias("first_word"), F.upper(F.coalesce(F.get(words, F.lit(1)), F.lit(""))).alias("second_word"), F.split("p_brand", "#")[1].cast("int").alias("brand_no"), F.concat_ws("_", "p_partkey", "p_size").alias("id"),
        F.regexp_extract("p_name", r"^(\w)", 1).alias("initial"), F.length("p_name").cast("long").alias("n"), F.col("p_name").contains("ring").alias("ring"),
    )


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(date_diff('day', DATE '1990-09-30', CAST(o_orderdate AS DATE)) AS INTEGER) AS reltime, CAST(year(o_orderdate + INTERVAL 3 MONTH) AS INTEGER) AS water_year, CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 'dry' ELSE 'wet' END AS season FROM orders")
def date_columns(spark: SparkSession, d: str) -> DataFrame:
    from hydrostrata.functions import calendar

    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", calendar.month_start(day).alias("month"), F.last_day(day).alias("month_end"), F.datediff(day, F.lit("1990-09-30").cast("date")).alias("reltime"), calendar.water_year(day).alias("water_year"), calendar.season(day).alias("season"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN log10(c_acctbal + 0.1) END, 9) AS l10, round(CASE WHEN c_acctbal >= 0 THEN ln(c_acctbal + 0.1) END, 9) AS ln, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 9) AS root, round(greatest(0.0, least(1.0, c_acctbal / 5000)), 9) AS clamped FROM customer")
def transforms(spark: SparkSession, d: str) -> DataFrame:
    from hydrostrata.functions.numeric import clamp

    v = F.col("c_acctbal")
    nonneg = lambda name, c: F.when(v >= 0, transform(name, c))
    return table(spark, d, "customer").select("c_custkey", F.round(nonneg("log10", v + 0.1), 9).alias("l10"), F.round(nonneg("ln", v + 0.1), 9).alias("ln"), F.round(nonneg("sqrt", v), 9).alias("root"), F.round(clamp(v / 5000), 9).alias("clamped"))


_WORDS = "['shale', 'claystone', 'clay', 'silt', 'loam', 'top soil', 'sand', 'gravel', 'cobbles', 'boulders', 'sandstone', 'lava', 'lime', 'rock', 'unknown', 'Sand']"


@query(f"""SELECT p_partkey, CASE w WHEN 'shale' THEN 'Fine' WHEN 'claystone' THEN 'Fine' WHEN 'clay' THEN 'Mixed_Fine' WHEN 'silt' THEN 'Mixed_Fine' WHEN 'loam' THEN 'Mixed_Fine' WHEN 'top soil' THEN 'Mixed_Fine'
 WHEN 'sand' THEN 'Sand' WHEN 'gravel' THEN 'Mixed_Coarse' WHEN 'cobbles' THEN 'Mixed_Coarse' WHEN 'boulders' THEN 'Very_Coarse' WHEN 'sandstone' THEN 'Very_Coarse' WHEN 'lava' THEN 'Very_Coarse' WHEN 'lime' THEN 'Very_Coarse' WHEN 'rock' THEN 'Very_Coarse' ELSE w END AS class
FROM (SELECT p_partkey, ({_WORDS})[p_partkey % 16 + 1] AS w FROM part)""")
def reclassify(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*(F.lit(w.strip(" '")) for w in _WORDS.strip("[]").split(",")))
    return table(spark, d, "part").select("p_partkey", texture.reclassify(words[(F.col("p_partkey") % 16).cast("int")]).alias("class"))


@query("SELECT l_orderkey, l_linenumber, rule FROM (SELECT *, unnest(list_filter([CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_quantity < 2 THEN 'quantity' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem)")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {"discount": F.col("l_discount") > 0.09, "quantity": F.col("l_quantity") < 2}
    return relational.violations(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity"), rules).select("l_orderkey", "l_linenumber", "rule")


@query("""WITH b AS (SELECT least(CAST(floor((log10(o_totalprice) - 3) / ((log10(500000) - 3) / 40)) AS INTEGER), 39) AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 500000 GROUP BY 1)
SELECT bin, n, round(n / sum(n) OVER () / (pow(10, 3 + (bin + 1) * (log10(500000) - 3) / 40) - pow(10, 3 + bin * (log10(500000) - 3) / 40)) * 1e6, 6) AS density FROM b""")
def log_histogram(spark: SparkSession, d: str) -> DataFrame:
    out = relational.log_histogram(table(spark, d, "orders").select("o_totalprice"), "o_totalprice", 1000, 500000, 40)
    return out.select("bin", "n", F.round(F.col("density") * 1e6, 6).alias("density"))


@query("""WITH l AS (SELECT conv_id, turn, role, text FROM conversations), m AS (SELECT *, last_value(CASE WHEN role = 'user' THEN 'user ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l)
SELECT conv_id, section, count(*) AS n FROM m WHERE role <> 'user' AND section IS NOT NULL GROUP BY ALL""")
def text_sections(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.format_string("## user %d", "turn")).otherwise(F.col("role")).alias("line"))
    return sections(lines, ["conv_id"], "turn", "line", r"^## (.*)$").groupBy("conv_id", "section").agg(F.count("*").alias("n"))


@query("SELECT format('{:>10d}{:>14.2f}', o_orderkey, o_totalprice) AS value FROM orders")
def fixed_width_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.fixed_width(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "%10d%14.2f", ["o_orderkey"])


@query("SELECT l_suppkey, " + ", ".join(f"coalesce(max(CASE WHEN layer = {k} THEN q END), -999.0)::DOUBLE AS Layer{k}" for k in (1, 2, 7)) + " FROM (SELECT l_suppkey, l_linenumber AS layer, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2) GROUP BY 1")
def layer_wide(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_suppkey", F.col("l_linenumber").alias("layer")).agg(F.sum("l_quantity").alias("q"))
    return sinks.layer_wide(q, ["l_suppkey"], [1, 2, 7], "q")


# --- budget


@query("""WITH x AS (SELECT o_orderkey, c_nationkey AS subws, CAST(o_orderdate AS DATE) AS day, o_totalprice AS demand FROM orders JOIN customer ON o_custkey = c_custkey),
 c AS (SELECT *, coalesce(sum(demand) OVER (PARTITION BY subws, day ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT o_orderkey, round(greatest(0, least(demand, 300000 - before)), 2) AS surface_water, round(CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN 0 WHEN 1 THEN demand ELSE demand - greatest(0, least(demand, 300000 - before)) END, 2) AS groundwater FROM c""")
def sw_allocation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("subws"))
    x = table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "subws", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("demand"), F.lit(300000.0).alias("available"))
    out = budget.allocate(x, ["subws", "day"], ["o_orderkey"], "demand", "available")
    source = F.col("o_orderkey") % 3 + 1
    return out.select("o_orderkey", F.round("surface_water", 2).alias("surface_water"), F.round(budget.sources(source, F.col("surface_water"), F.col("short")), 2).alias("groundwater"))


_DRIVERS = """dr AS (SELECT user_id AS field, CAST(ts AS DATE) AS day, sum(value) / 1000 AS precip, count(*) * 0.01::DOUBLE AS irr, 0.15::DOUBLE + (user_id % 7) * 0.02::DOUBLE AS pet FROM events GROUP BY 1, 2),
 num AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY day) AS n FROM dr),
 bud AS (WITH RECURSIVE b AS (SELECT field, day, n, precip, irr, pet, least(pet, 0.1 + precip + irr) AS aet, greatest(0, 0.1 + precip + irr - least(pet, 0.1 + precip + irr) - 0.25) AS recharge, least(0.25, 0.1 + precip + irr - least(pet, 0.1 + precip + irr)) AS swc FROM num WHERE n = 1
  UNION ALL SELECT x.field, x.day, x.n, x.precip, x.irr, x.pet, least(x.pet, b.swc + x.precip + x.irr), greatest(0, b.swc + x.precip + x.irr - least(x.pet, b.swc + x.precip + x.irr) - 0.25), least(0.25, b.swc + x.precip + x.irr - least(x.pet, b.swc + x.precip + x.irr)) FROM b JOIN num x ON x.field = b.field AND x.n = b.n + 1) SELECT * FROM b)"""


def _drivers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("field"), F.to_date("ts").alias("day")).agg((F.sum("value") / 1000).alias("precip"), (F.count("*") * 0.01).alias("irr"))
    return e.withColumn("pet", 0.15 + (F.col("field") % 7) * 0.02)


@query(f"WITH {_DRIVERS} SELECT field, day, round(aet, 7) AS aet, round(recharge, 7) AS recharge, round(swc, 7) AS swc FROM bud")
def soil_water_budget(spark: SparkSession, d: str) -> DataFrame:
    return rounded(budget.soil_water(_drivers(spark, d), "field", "day", 0.25, 0.1).select("field", "day", "aet", "recharge", "swc"), 7, "aet", "recharge", "swc")


@query(f"WITH {_DRIVERS} SELECT field, day, round(aet, 7) AS aet, round(recharge, 7) AS recharge, round(swc, 7) AS swc FROM bud")
def soil_water_budget_grouped(spark: SparkSession, d: str) -> DataFrame:
    return rounded(budget.soil_water_groups(_drivers(spark, d), "field", "day", 0.25, 0.1).select("field", "day", "aet", "recharge", "swc"), 7, "aet", "recharge", "swc")


@query(f"WITH {_DRIVERS} SELECT field % 6 AS landcover, CAST(date_trunc('month', day) AS DATE) AS month, round(sum(aet), 6) AS aet, round(sum(recharge), 6) AS recharge, round(sum(irr), 6) AS irr, count(*) AS days FROM bud GROUP BY 1, 2")
def landcover_rollup(spark: SparkSession, d: str) -> DataFrame:
    b = budget.soil_water(_drivers(spark, d), "field", "day", 0.25, 0.1).withColumn("landcover", F.col("field") % 6)
    return rounded(budget.rollup(b, ["landcover"], "day", "month", ["aet", "recharge", "irr"]), 6, "aet", "recharge", "irr")


@query(f"WITH {_DRIVERS} SELECT field % 6 AS landcover, round(sum(precip) + sum(irr) - sum(aet) - sum(recharge), 6) AS net FROM bud GROUP BY 1")
def budget_closure(spark: SparkSession, d: str) -> DataFrame:
    b = budget.soil_water(_drivers(spark, d), "field", "day", 0.25, 0.1).withColumn("landcover", F.col("field") % 6)
    return rounded(budget.closure(b, ["landcover"]), 6, "net")


@query("SELECT event_id, round(CASE WHEN value * 1.1 < 0.2 * 60 THEN 0 ELSE value * 1.1 END, 6) AS eff, round(greatest(0, (50 - CASE WHEN value * 1.1 < 0.2 * 60 THEN 0 ELSE value * 1.1 END) / 0.7) * 0.9, 6) AS demand FROM events")
def irrigation_demand(spark: SparkSession, d: str) -> DataFrame:
    eff = budget.effective_precip(F.col("value"), F.lit(60.0), 1.1)
    return table(spark, d, "events").select("event_id", F.round(eff, 6).alias("eff"), F.round(budget.irrigation_demand(F.lit(50.0), eff, F.lit(0.7), F.lit(0.1)), 6).alias("demand"))


@query("""SELECT s_nationkey AS reach, round(sum(CASE WHEN c_acctbal > s_acctbal THEN 0.5 * (c_acctbal - s_acctbal) ELSE 0 END), 2) AS flow, count(*) FILTER (c_acctbal > s_acctbal) AS active
FROM supplier JOIN (SELECT c_custkey, c_acctbal FROM customer) ON c_custkey = s_suppkey GROUP BY 1""")
def drain_flow(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("reach"), F.col("s_acctbal").alias("elevation"), F.lit(0.5).alias("conductance"))
    heads = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("head"))
    return rounded(budget.drain_flow(cells, heads, ["cell"], ["reach"]), 2, "flow")


@query("""WITH mv AS (SELECT s_suppkey AS move, CAST(s_suppkey % 8 + 1 AS INTEGER) AS a, CAST(s_suppkey % 8 + 1 + s_nationkey % 5 AS INTEGER) AS b FROM supplier), mo AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month)
SELECT month, move, a AS start_month, b AS end_month FROM mo JOIN mv ON a <= month AND month < b""")
def water_moves(spark: SparkSession, d: str) -> DataFrame:
    a = (F.col("s_suppkey") % 8 + 1).cast("int")
    moves = table(spark, d, "supplier").select(F.col("s_suppkey").alias("move"), a.alias("start_month"), (a + F.col("s_nationkey") % 5).cast("int").alias("end_month"))
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return budget.effective_moves(moves, months)


# --- learning


@query("SELECT p_type, round(avg(ln(p_retailprice)), 9) AS mu, round(stddev_pop(ln(p_retailprice)), 9) AS sigma, round(exp(avg(ln(p_retailprice))), 6) AS scale, count(*) AS n FROM part GROUP BY 1")
def lognormal_mle(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(learning.lognormal_fit(table(spark, d, "part"), ["p_type"], "p_retailprice"), 9, "mu", "sigma"), 6, "scale")


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER w) / stddev_pop(p_retailprice) OVER w, 8) AS z FROM part WINDOW w AS (PARTITION BY p_type)")
def standardise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learning.standardise(table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice"), ["p_type"], "p_retailprice").select("p_partkey", "z"), 8, "z")


@query("SELECT p_partkey, r - 1 AS cluster FROM part JOIN (SELECT p_brand, dense_rank() OVER (ORDER BY avg(p_retailprice)) AS r FROM part GROUP BY 1) USING (p_brand)")
def relabel_clusters(spark: SparkSession, d: str) -> DataFrame:
    return learning.relabel(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice").select("p_partkey", F.col("cluster").cast("long").alias("cluster"))


@query("""WITH r AS (SELECT s_suppkey AS id, 1 AS run, s_nationkey AS label FROM supplier UNION ALL SELECT s_suppkey, 2, CAST(s_suppkey % 7 AS INTEGER) FROM supplier UNION ALL SELECT s_suppkey, 3, CAST(floor(s_acctbal / 1000) AS INTEGER) FROM supplier)
SELECT a.id, b.id AS id2, round(count(*) / 3, 9) AS similarity FROM r a JOIN r b ON a.run = b.run AND a.label = b.label AND a.id < b.id GROUP BY 1, 2""")
def coassociation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    label = {1: F.col("s_nationkey"), 2: (F.col("s_suppkey") % 7).cast("int"), 3: F.floor(F.col("s_acctbal") / 1000).cast("int")}
    runs = s.select("s_suppkey", F.explode(F.array(*(F.struct(F.lit(k).alias("run"), c.alias("label")) for k, c in label.items()))).alias("r")).select(F.col("s_suppkey").alias("id"), "r.run", "r.label")
    return learning.coassociation(runs, 9)


#: Poisson(1) counts of a uniform u.
_COUNTS = "CASE WHEN u > 0.36787944117144233 THEN 1 ELSE 0 END + CASE WHEN u > 0.7357588823428847 THEN 1 ELSE 0 END + CASE WHEN u > 0.9196986029286058 THEN 1 ELSE 0 END + CASE WHEN u > 0.9810118431238462 THEN 1 ELSE 0 END + CASE WHEN u > 0.9963401531726563 THEN 1 ELSE 0 END + CASE WHEN u > 0.9994058151824183 THEN 1 ELSE 0 END + CASE WHEN u > 0.9999167588507119 THEN 1 ELSE 0 END + CASE WHEN u > 0.9999897508033253 THEN 1 ELSE 0 END + CASE WHEN u > 0.999998874797402 THEN 1 ELSE 0 END + CASE WHEN u > 0.9999998885745217 THEN 1 ELSE 0 END"


@query(f"""WITH d AS (SELECT p_type, p_retailprice AS v, r, ('0x' || substr(md5(p_partkey || '-' || r || '-1'), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM part, range(1, 201) t(r)),
 m AS (SELECT p_type, r, sum(({_COUNTS}) * v) / sum({_COUNTS}) AS m FROM d GROUP BY 1, 2)
SELECT p_type, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high, round(avg(m), 5) AS mean FROM m GROUP BY 1""")
def bootstrap_mean_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learning.bootstrap_means(table(spark, d, "part"), ["p_type"], ["p_partkey"], "p_retailprice", 200), 5, "low", "high", "mean")


@query(f"""WITH d AS (SELECT p_partkey % 3 AS grp, p_size AS x, 1.0 AS o, p_retailprice AS y, r, ({_COUNTS}) * w AS k FROM (SELECT *, 1.0 / p_size AS w, ('0x' || substr(md5(p_partkey || '-' || r || '-3'), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM part, range(1, 41) t(r))),
 s AS (SELECT grp, r, sum(k * x * x) AS a, sum(k * x) AS b, sum(k) AS c, sum(k * x * y) AS p, sum(k * y) AS q FROM d GROUP BY 1, 2),
 c AS (SELECT grp, CAST(r AS INTEGER) AS replicate, (p * c - b * q) / (a * c - b * b) AS coef_x, (a * q - b * p) / (a * c - b * b) AS coef_one FROM s)
SELECT grp, replicate, round(coef_x, 5) AS coef_x, round(1 / coef_one, 9) AS inverse_one FROM c WHERE coef_x >= 0 AND coef_one >= 0""")
def bootstrap_regression_signs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select((F.col("p_partkey") % 3).alias("grp"), "p_partkey", F.col("p_size").cast("double").alias("x"), F.lit(1.0).alias("one"), F.col("p_retailprice").alias("y"), (1.0 / F.col("p_size")).alias("w"))
    out = learning.bootstrap_regression(rows, ["grp"], ["p_partkey"], ["x", "one"], "y", "w", 40, 3)
    return out.select("grp", "replicate", F.round("coef_x", 5).alias("coef_x"), F.round("inverse_one", 9).alias("inverse_one"))


@query("""WITH s AS (SELECT l_returnflag, sum(l_quantity * l_quantity) AS a, sum(l_quantity) AS b, count(*) AS c, sum(l_quantity * l_extendedprice) AS p, sum(l_extendedprice) AS q FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((p * c - b * q) / (a * c - b * b), 4) AS coef_x, round((a * q - b * p) / (a * c - b * b), 2) AS coef_one FROM s""")
def weighted_regression(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.lit(1.0).alias("one"), F.col("l_extendedprice").alias("y"), F.lit(1.0).alias("w"))
    out = learning.weighted_regression(rows, ["l_returnflag"], ["x", "one"], "y", "w")
    return out.select("l_returnflag", F.round("coef_x", 4).alias("coef_x"), F.round("coef_one", 2).alias("coef_one"))


@query("SELECT p_partkey, CAST(('0x' || substr(md5(p_partkey || '-5'), 1, 7))::BIGINT % 10 AS INTEGER) AS fold FROM part")
def cv_folds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", learning.fold("p_partkey", 10, 5).alias("fold"))


@query("SELECT p_partkey, least(lo, hi) AS low, greatest(lo, hi) AS high FROM (SELECT p_partkey, p_retailprice AS lo, p_size * 40.0 + 3 AS hi FROM part)")
def parameter_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("low"), (F.col("p_size") * 40.0 + 3).alias("high"))
    return weighting.bounds(rows)


@query("SELECT o_orderpriority, m, cum FROM (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, sum(count(*)) OVER (PARTITION BY o_orderpriority ORDER BY CAST(date_trunc('month', o_orderdate) AS DATE))::BIGINT AS cum FROM orders GROUP BY 1, 2)")
def cumulative_counts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy("o_orderpriority", F.to_date(F.trunc("o_orderdate", "month")).alias("m")).agg(F.count("*").alias("n"))
    return m.select("o_orderpriority", "m", F.sum("n").over(Window.partitionBy("o_orderpriority").orderBy("m")).alias("cum"))
