"""Observation weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import flow_groups, rolling


def balance(df: DataFrame, group: str, weight: str, targets: dict[str, float]) -> DataFrame:
    """Weights scaled so that each group adds up to its target, ratios kept; groups of sum 0 and without a target stay."""
    sums = df.groupBy(F.col(group).alias("_g")).agg(F.sum(weight).alias("_total"))  # a row a group; groups are few and large
    total = F.col("_total")
    target = F.create_map(*(x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))))[F.col(group)] if targets else F.lit(None).cast("double")
    out = df.join(sums, F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.withColumn("balanced", F.when(target.isNotNull() & (total != 0), F.col(weight) * target / total).otherwise(F.col(weight))).drop("_g", "_total")


def zero_ranges(df: DataFrame, date: str, weight: str, ranges: list[tuple[str, str]]) -> DataFrame:
    """Weight 0 inside any of the date ranges, both ends included."""
    inside: Column = F.lit(False)
    for a, b in ranges:
        inside = inside | F.col(date).between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return df.withColumn("weight", F.when(inside, 0.0).otherwise(F.col(weight)))


def by_count(df: DataFrame, well: str, default: float = 1.0, least: int = 3) -> DataFrame:
    """Each well's default weight shared by its observations; wells with fewer than `least` get 0."""
    n = F.count("*").over(Window.partitionBy(well))
    return df.withColumn("weight", F.when(n < least, 0.0).otherwise(default / n))


def outlier_rule(df: DataFrame, by: list[str], order: list[str], value: str, width: int, least: int, threshold: float, low: float) -> DataFrame:
    """Weight `low` where the centred rolling median exceeds the value by more than the threshold (one-sided), else 1."""
    out = rolling(df, by, order, value, width, least, "median", "median")
    return out.withColumn("weight", F.when(F.col("median") - F.col(value) > threshold, low).otherwise(1.0))


def flow_cv(df: DataFrame, value: str, shares: list[float], cvs: list[float]) -> DataFrame:
    """Weight 1 / (value * cv)^2 with the cv of the value's flow group; null for a value of 0."""
    out = flow_groups(df, value, shares)
    cv = F.array(*map(F.lit, cvs))[F.col("flow_group")]
    return out.withColumn("weight", 1.0 / F.nullif(F.pow(F.col(value) * cv, F.lit(2.0)), F.lit(0.0)))


def after_date(df: DataFrame, well: str, date: str, weight: str, rules: DataFrame) -> DataFrame:
    """Weight 0 for a well's observations after its cutoff; rules (well, cutoff) come one row a well."""
    return df.join(rules.withColumnRenamed("well", well), well, "left").withColumn("weight", F.when(F.col(date) > F.col("cutoff"), 0.0).otherwise(F.col(weight))).drop("cutoff")


def bounds(params: DataFrame) -> DataFrame:
    """Parameter bounds in order: swapped where a negative default has turned them."""
    return params.withColumns({"low": F.least("low", "high"), "high": F.greatest("low", "high")})


def coupled_priors(pairs: DataFrame, params: DataFrame, weight: float = 750.0) -> DataFrame:
    """Prior information that holds two parameters in their ratio: ln(first) - ln(second) = rhs, the log ratio of their defaults. pairs: first, second; params: name, default."""
    of = lambda side: params.select(F.col("name").alias(side), F.col("default").alias(f"_{side}"))
    out = pairs.join(of("first"), "first").join(of("second"), "second")
    return out.select("first", "second", F.lit(1.0).alias("coef_first"), F.lit(-1.0).alias("coef_second"), F.ln(F.col("_first") / F.col("_second")).alias("rhs"), F.lit(weight).alias("weight"))


def assemble_parameters(params: DataFrame, tied: DataFrame, fixed: DataFrame) -> DataFrame:
    """(name, kind, value, partner): adjustable ones as they are, tied ones with their parent's default, fixed ones at their value. params: name, default; tied: name, partner; fixed: name, value."""
    base = params.join(tied, "name", "left").join(fixed, "name", "left")
    parent = params.select(F.col("name").alias("partner"), F.col("default").alias("_parent"))
    kind = F.when(F.col("value").isNotNull(), "fixed").when(F.col("partner").isNotNull(), "tied").otherwise("none")
    out = base.join(parent, "partner", "left").withColumn("kind", kind)
    return out.select("name", "kind", F.coalesce("value", "_parent", "default").alias("value"), F.when(F.col("kind") == "tied", F.col("partner")).alias("partner"))


#: Widths that rules of rolling medians may have between them.
MOST_WIDTHS = 100


def well_weights(df: DataFrame, well: str, date: str, value: str, cutoffs: DataFrame, medians: DataFrame, default: float = 1.0, least: int = 3, order: str | None = None) -> DataFrame:
    """All rules together: default / count by well, 0 for wells with fewer than `least` rows, 0 after a well's cutoff (well, cutoff), and the new weight where a rolling median of a width of its own exceeds the value by more than the threshold (well, width, threshold, low).

    Raises if a rule names a well without observations, or if rules have more than MOST_WIDTHS widths.
    """
    named = cutoffs.select("well").unionByName(medians.select("well")).distinct()
    if missing := named.join(df.select(F.col(well).alias("well")).distinct(), "well", "left_anti").limit(5).collect():
        raise ValueError(f"rules for wells without observations: {[r['well'] for r in missing]}")
    out = by_count(df, well, default, least)
    out = out.join(cutoffs.withColumnRenamed("well", well), well, "left").join(medians.withColumnRenamed("well", well), well, "left")
    median = F.lit(None).cast("double")
    widths = sorted(r[0] for r in medians.select("width").distinct().limit(MOST_WIDTHS + 1).collect())
    if len(widths) > MOST_WIDTHS:
        raise ValueError(f"rules with more than {MOST_WIDTHS} widths: each width is a window of its own")
    for width in widths:
        out = rolling(out, [well], [order or date], value, width, width, "median", f"_m{width}")
        median = F.when(F.col("width") == width, F.col(f"_m{width}")).otherwise(median)
    out = out.withColumn("_median", median)
    weight = F.when(F.col("weight") == 0, 0.0).when(F.col(date) > F.col("cutoff"), 0.0).when(F.col("_median") - F.col(value) > F.col("threshold"), F.col("low")).otherwise(F.col("weight"))
    return out.withColumn("weight", weight).select(*df.columns, "weight")
