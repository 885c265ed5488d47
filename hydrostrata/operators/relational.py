"""Table operations with the semantics of a data-frame workflow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide_to_long(df: DataFrame, ids: list[str], prefixes: list[str], points: list[int]) -> DataFrame:
    """Columns prefix_1, prefix_2, ... of each prefix become rows (ids, point, one column a prefix); missing ones are null."""
    have = set(df.columns)
    one = lambda n: F.struct(F.lit(n).alias("point"), *((F.col(f"{p}_{n}") if f"{p}_{n}" in have else F.lit(None).cast("double")).alias(p) for p in prefixes))
    return df.select(*ids, F.explode(F.array(*map(one, points))).alias("_r")).select(*ids, "_r.*")


def long_to_wide(df: DataFrame, by: list[str], key: str, values: list, value: str, how: str = "sum") -> DataFrame:
    """One column for each stated key value."""
    return df.groupBy(*by).pivot(key, values).agg(getattr(F, how)(value))


def one_hot(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """A 0/1 column for each class; null where the value is none of them."""
    known = F.col(column).isin(classes)
    return df.withColumns({f"is_{c}": F.when(known, F.when(F.col(column) == c, 1.0).otherwise(0.0)) for c in classes})


def one_to_one(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The left join, and the keys that break its promise (repeated on either side or without a partner)."""
    repeated = [d.groupBy(*on).count().where("count > 1").select(*on, F.lit(f"repeated_{s}").alias("problem")) for d, s in ((a, "left"), (b, "right"))]
    missing = a.select(*on).distinct().join(b.select(*on), on, "left_anti").withColumn("problem", F.lit("missing"))
    return a.join(b, on, "left"), reduce(DataFrame.unionByName, [*repeated, missing])


def positional_join(a: DataFrame, order_a: list[str], b: DataFrame, order_b: list[str], by: list[str]) -> DataFrame:
    """Rows side by side by their place in each group; a group is numbered on its own."""
    at = lambda d, o: d.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*o)))
    return at(a, order_a).join(at(b, order_b), [*by, "_n"]).drop("_n")


def right_wins(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Union in which a key of b replaces that of a."""
    return a.join(b, on, "left_anti").unionByName(b)


def differences_both_ways(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys on one side only, and on which."""
    left = a.select(*on).distinct().join(b.select(*on), on, "left_anti").withColumn("side", F.lit("left"))
    right = b.select(*on).distinct().join(a.select(*on), on, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def nearest_value(a: DataFrame, b: DataFrame, on: list[str], x: str, y: str, tie: str) -> DataFrame:
    """For each row of a, the row of b of its key whose y is nearest to x; the least tie-breaker wins."""
    gap = F.abs(F.col(x) - F.col(y))
    ids = a.columns
    return a.join(b, on).groupBy(*ids).agg(F.min(F.struct(gap.alias("gap"), F.col(tie))).alias("_m")).select(*ids, F.col("_m.gap").alias("gap"), F.col(f"_m.{tie}").alias(tie))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; a report, so the limit is the feature."""
    return df.orderBy(*order).limit(n)


def log_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and densities in bins of equal width in log10 between low and high."""
    import math

    a, b = math.log10(low), math.log10(high)
    width = (b - a) / bins
    at = F.floor((F.log10(value) - a) / width).cast("int")
    out = df.where(F.col(value).between(low, high)).select(F.least(at, F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    edge = lambda k: F.pow(F.lit(10.0), F.lit(a) + k * width)
    return out.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy()) / (edge(F.col("bin") + 1) - edge(F.col("bin"))))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, one row a broken rule, with its name."""
    names = F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items())))
    return df.withColumn("rule", F.explode(names))


def all_true(df: DataFrame, by: list[str], condition: Column) -> DataFrame:
    """By key, whether the condition holds in every row (a null one does not)."""
    return df.groupBy(*by).agg(F.every(F.coalesce(condition, F.lit(False))).alias("all"))


def replace_tokens(lines: DataFrame, line: str, tokens: dict[str, str]) -> DataFrame:
    """Each token ~name~ of template lines, white space inside it included, replaced by its value."""
    out = F.col(line)
    for name, text in tokens.items():
        out = F.regexp_replace(out, rf"~\s*{name}\s*~", text)
    return lines.withColumn(line, out)


def tail_of_sums(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """The n groups of greatest sums, ascending as a sorted table's tail."""
    top = df.groupBy(*by).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), *(F.desc(c) for c in by)).limit(n)
    return top.orderBy("total", *by)


def layer_thickness(cells: DataFrame, tops: DataFrame, bottoms: DataFrame) -> DataFrame:
    """(cells' columns, bottom, thickness) by (layer, row, col): below the surface for layer 1, below the layer above otherwise. tops: row, col, top; bottoms: layer, row, col, bottom."""
    above = bottoms.select((F.col("layer") + 1).alias("layer"), "row", "col", F.col("bottom").alias("_above"))
    out = cells.join(bottoms, ["layer", "row", "col"], "left").join(above, ["layer", "row", "col"], "left").join(tops, ["row", "col"], "left")
    ceiling = F.when(F.col("layer") == 1, F.col("top")).otherwise(F.col("_above"))
    return out.select(*cells.columns, "bottom", (ceiling - F.col("bottom")).alias("thickness"))


def template_names(lines: DataFrame, line: str) -> DataFrame:
    """Every name that stands between tildes in template lines, one row each, with its place in the line."""
    return lines.select("*", F.posexplode(F.regexp_extract_all(line, F.lit(r"~\s*([^~\s]+)\s*~"), F.lit(1))).alias("pos", "name"))
