"""Model skill and objective functions as aggregates over (obs, sim[, weight])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_metrics(obs: str = "obs", sim: str = "sim") -> list[Column]:
    """n, me, mae, rmse, r2 (1 - SSE/SST), nse, pbias (100 * sum(obs - sim) / sum(obs)), kge (2009) and kge_prime (2012)."""
    o, s = F.col(obs), F.col(sim)
    e = o - s
    sst = F.var_pop(o) * F.count(o)
    skill = F.when(sst > 0, 1 - F.sum(e * e) / F.when(sst > 0, sst))
    r, alpha, beta = F.corr(o, s), F.stddev_pop(s) / F.nullif(F.stddev_pop(o), F.lit(0.0)), F.avg(s) / F.nullif(F.avg(o), F.lit(0.0))
    gamma = alpha / F.nullif(beta, F.lit(0.0))
    return [
        F.count("*").alias("n"), F.avg(e).alias("me"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), skill.alias("nse"),
        (100 * F.sum(e) / F.nullif(F.sum(o), F.lit(0.0))).alias("pbias"),
        (1 - F.sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1))).alias("kge"),
        (1 - F.sqrt((r - 1) * (r - 1) + (gamma - 1) * (gamma - 1) + (beta - 1) * (beta - 1))).alias("kge_prime"),
    ]


def skill(df: DataFrame, by: list[str], obs: str = "obs", sim: str = "sim", least: int = 5, weight: str | None = None) -> DataFrame:
    """Metrics by group; null for groups with fewer than `least` rows, with a missing value on either side, or with a greatest weight of 0. Simulations are multiplied by the weight."""
    rows = df if weight is None else df.withColumn(sim, F.col(sim) * F.col(weight))
    usable = (F.count("*") >= least) & (F.count_if(F.col(obs).isNull() | F.col(sim).isNull()) == 0)
    if weight is not None:
        usable = usable & (F.max(weight) != 0)
    out = rows.groupBy(*by).agg(*error_metrics(obs, sim), usable.alias("_usable"))
    names = [c for c in out.columns if c not in (*by, "n", "_usable")]
    return out.select(*by, "n", *(F.when(F.col("_usable"), F.col(c)).alias(c) for c in names))


def log_skill(df: DataFrame, by: list[str], obs: str = "obs", sim: str = "sim") -> DataFrame:
    """NSE of logarithms. In a group with an observation that is not positive, rows with such observations go and half the least positive observation is added to both sides; null where a simulation has no logarithm."""
    low = df.groupBy(*by).agg(F.min(obs).alias("_lo"), F.min(F.when(F.col(obs) > 0, F.col(obs))).alias("_least"))
    eps = F.when(F.col("_lo") <= 0, F.col("_least") / 2).otherwise(0.0)
    shifted = F.col(sim) + eps
    logs = df.join(low, by).where(F.col(obs) > 0).select(*by, F.ln(F.col(obs) + eps).alias("o"), F.when(shifted > 0, F.ln(shifted)).alias("s"))
    sst = F.var_pop("o") * F.count("o")
    nse = 1 - F.sum((F.col("o") - F.col("s")) * (F.col("o") - F.col("s"))) / F.nullif(sst, F.lit(0.0))
    return logs.groupBy(*by).agg(F.when(F.count("s") == F.count("o"), nse).alias("lnse"))


def objective(df: DataFrame, by: list[str], obs: str = "obs", sim: str = "sim", weight: str = "wt") -> DataFrame:
    """phi = sum((weight * residual)^2) by group, with its share of the total."""
    r = F.col(weight) * (F.col(obs) - F.col(sim))
    out = df.groupBy(*by).agg(F.sum(r * r).alias("phi"), F.count_if(F.col(weight) != 0).alias("n_weighted"))
    return out.withColumn("share", F.col("phi") / F.sum("phi").over(Window.partitionBy()))


def variation(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Coefficient of variation (sample standard deviation over mean) by group."""
    return df.groupBy(*by).agg((F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"), F.count("*").alias("n"))


def class_scores(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """Brier score, mean absolute error, share of wrong classes and share of guessed values out of [0, 1], from arrays of class shares; rows with a missing share go."""
    df = df.where(~F.exists(truth, F.isnull) & ~F.exists(guess, F.isnull))
    sq = F.aggregate(F.zip_with(truth, guess, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
    ab = F.aggregate(F.zip_with(truth, guess, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda x, y: x + y) / F.size(truth)
    best = lambda c: F.array_position(c, F.array_max(c))
    out = F.size(F.filter(guess, lambda x: (x < 0) | (x > 1)))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(F.avg(sq).alias("brier"), F.avg(ab).alias("mae"), share(best(F.col(truth)) != best(F.col(guess))).alias("misclassified"), (F.sum(out) / F.sum(F.size(guess))).alias("out_of_bounds"), F.count("*").alias("n"))


def scaled_sensitivity(df: DataFrame, row: list[str], css: str) -> DataFrame:
    """A group's sensitivities as shares of their sum, times the root of each."""
    return df.withColumn("scaled", F.col(css) / F.nullif(F.sum(css).over(Window.partitionBy(*row)), F.lit(0.0)) * F.sqrt(css))


def jensen_shannon(df: DataFrame, by: list[str], p: str, q: str) -> DataFrame:
    """Divergence of two distributions given by rows of shares."""
    m = (F.col(p) + F.col(q)) / 2
    term = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return df.groupBy(*by).agg((F.sum(term(F.col(p)) + term(F.col(q))) / 2).alias("divergence"))


def best_parameter(scores: DataFrame, parameter: str, metrics: list[str]) -> DataFrame:
    """(metric, parameter, value): the parameter with the least mean score over its runs, ties by the parameter."""
    means = scores.groupBy(parameter).agg(*(F.avg(m).alias(m) for m in metrics))
    best = means.agg(*(F.min(F.struct(F.col(m).alias("value"), F.col(parameter).alias("parameter"))).alias(m) for m in metrics))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}.parameter").alias("parameter"), F.col(f"{m}.value").alias("value")) for m in metrics)))
    return best.select(rows.alias("r")).select("r.metric", "r.parameter", "r.value")


def above_ground(obs: DataFrame, ground: DataFrame, on: list[str], level: str, surface: str) -> DataFrame:
    """By key, observations and those above the land surface."""
    return obs.join(ground, on).groupBy(*on).agg(F.count("*").alias("n"), F.count_if(F.col(level) > F.col(surface)).alias("above"))
