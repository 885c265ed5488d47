"""Resampling, distribution fits, folds and clustering summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lognormal_fit(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Maximum likelihood of a lognormal without location: mean and population deviation of the logarithms."""
    ln = F.ln(value)
    return df.where(F.col(value) > 0).groupBy(*by).agg(F.avg(ln).alias("mu"), F.stddev_pop(ln).alias("sigma"), F.exp(F.avg(ln)).alias("scale"), F.count("*").alias("n"))


def bounded_lognormal_fit(df: DataFrame, by: list[str], value: str, low: float = 0.0, margin: float = 1e-3, steps: int = 16, rounds: int = 9) -> DataFrame:
    """(by, n, loc, mu, sigma, scale): lognormal with a location from `low` up to just under the group's least value, at the greatest likelihood over that range.

    For a location the best mean and deviation of the logarithms are in closed form, so that the likelihood is a function
    of the location alone. It is bracketed for all groups at once: a round takes `steps` candidates a group, summed in the
    tasks, and goes on between the neighbours of the best; ties go to the lower location. The first round's
    candidates are nearer to each other towards the least value, where the likelihood has its other rise; `margin` is the
    share of the range that the location stays away from it. Groups of equal values have no fit and are left out.
    """
    names = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    from .graph import checkpointed

    rows = df.where(F.col(value) > low).select(*by, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*names).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count("*").alias("n")).where("_max > _min")
    # The location is _min - exp(t) * (_min - low), t from ln(margin) up to 0: even steps of t crowd towards the least value.
    state = checkpointed(ends.withColumns({"_a": F.lit(math.log(margin)), "_b": F.lit(0.0)}))
    gap = lambda k: F.exp(F.col("_a") + (F.col("_b") - F.col("_a")) * (k / steps)) * (F.col("_min") - low)
    for _ in range(rounds):
        logs = rows.join(state, same).withColumns({f"_l{k}": F.ln(F.col("_v") - F.col("_min") + gap(k)) for k in range(steps + 1)})
        sums = logs.groupBy(*(f"_g{i}" for i in range(len(by)))).agg(*(f(f"_l{k}").alias(f"_{m}{k}") for k in range(steps + 1) for m, f in (("m", F.avg), ("s", F.stddev_pop))))
        tries = F.array(*(F.struct((-F.ln(F.nullif(F.col(f"_s{k}"), F.lit(0.0))) - F.col(f"_m{k}")).alias("likely"), F.lit(k).alias("k"), F.col(f"_m{k}").alias("mu"), F.col(f"_s{k}").alias("sigma")) for k in range(steps + 1)))
        own = [F.col(f"_g{i}").alias(f"_h{i}") for i in range(len(by))]
        best = sums.select(*own, F.array_max(tries).alias("_best"))
        met = state.join(best, [F.col(f"_g{i}").eqNullSafe(F.col(f"_h{i}")) for i in range(len(by))])
        t = lambda k: F.col("_a") + (F.col("_b") - F.col("_a")) * F.least(F.greatest(k, F.lit(0)), F.lit(steps)) / steps
        at = F.col("_best.k")
        state = checkpointed(met.select(*(f"_g{i}" for i in range(len(by))), "_min", "n", t(at - 1).alias("_a"), t(at + 1).alias("_b"), t(at).alias("_t"), F.col("_best.mu").alias("mu"), F.col("_best.sigma").alias("sigma")))
    loc = F.col("_min") - F.exp("_t") * (F.col("_min") - low)
    return state.select(*(F.col(f"_g{i}").alias(c) for i, c in enumerate(by)), "n", loc.alias("loc"), "mu", "sigma", F.exp("mu").alias("scale"))


def standardise(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """z = (value - mean) / population deviation by group, from one row of moments a group."""
    moments = df.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by))).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    out = df.join(moments, same, "left") if by else df.crossJoin(F.broadcast(moments))  # without groups: one row
    return out.withColumn("z", (F.col(value) - F.col("_mean")) / F.nullif(F.col("_dev"), F.lit(0.0))).drop(*moments.columns)


def _digits(*keys: Column | str) -> Column:
    """The first seven hexadecimal digits of the md5 of the keys, joined by '-'."""
    text = F.concat_ws("-", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.substring(F.md5(text.cast("binary")), 1, 7)


def draw(*keys: Column | str) -> Column:
    """A whole number from 0 to 2**28 - 1 that depends on the keys alone: the first seven hexadecimal digits of the md5 of the keys, joined by '-'."""
    return F.conv(_digits(*keys), 16, 10).cast("long")


def fold(column: str, folds: int, seed: int) -> Column:
    """A fold number that depends on the id and the seed only."""
    return (draw(column, F.lit(seed)) % folds).cast("int")


def _poisson(digits: Column) -> Column:
    """Poisson(1) counts by inverting a uniform number: seven hexadecimal digits after the point. Digits in text order are numbers in order, so that none is converted."""
    steps, total = [], 0.0
    for k in range(10):
        total += math.exp(-1) / math.factorial(k)
        steps.append(math.floor(total * (1 << 28)))
    out = F.lit(10)
    for k in range(9, -1, -1):
        out = F.when(digits <= f"{steps[k]:07x}", k).otherwise(out)
    return out


def _replicates(df: DataFrame, key: list[str], replicates: int, seed: int, name: str) -> DataFrame:
    """df's rows once a replicate with their counts _k, dealt to the tasks first: a small file is one task's input, but its rows times replicates are not.

    A count is that of the digits of (key, replicate, seed). The text of a row's key is made once, and that of replicate and seed is a constant, so that a draw puts two texts together.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    rows = df.repartition(max(2 * tasks, df.rdd.getNumPartitions())).withColumn("_own", F.concat_ws("-", *(F.col(k).cast("string") for k in key), F.lit("")))
    draws = F.inline(F.array(*(F.struct(F.lit(k), F.lit(f"{k}-{seed}")) for k in range(1, replicates + 1))))
    digits = F.substring(F.md5(F.concat("_own", "_end").cast("binary")), 1, 7)
    return rows.select("*", draws.alias(name, "_end")).withColumn("_u", digits).withColumn("_k", _poisson(F.col("_u"))).drop("_own", "_end", "_u")


def bootstrap_means(df: DataFrame, by: list[str], key: list[str], value: str, replicates: int, seed: int = 1) -> DataFrame:
    """2.5 and 97.5 percent limits of the mean, by Poisson bootstrap: each row draws its count in each replicate from a hash of its key."""
    rows = _replicates(df.select(*dict.fromkeys([*by, *key, value])), key, replicates, seed, "_r")
    means = rows.groupBy(*by, "_r").agg((F.sum(F.col("_k") * F.col(value)) / F.nullif(F.sum("_k"), F.lit(0))).alias("_m"))
    return means.groupBy(*by).agg(F.expr("percentile(_m, 0.025)").alias("low"), F.expr("percentile(_m, 0.975)").alias("high"), F.avg("_m").alias("mean"))


def weighted_regression(df: DataFrame, by: list[str], xs: list[str], y: str, weight: str, positive: bool = False) -> DataFrame:
    """Weighted least squares through the origin by group: the normal equations are sums, solved one small system a group. positive: only rows with a weight over 0 count, and only groups that have some."""
    import numpy as np
    import pandas as pd

    d = len(xs)
    if positive:  # in the sums, since a filter would work out what the weight is made of anew
        df = df.withColumn(weight, F.when(F.col(weight) > 0, F.col(weight)))
    sums = [F.sum(F.col(weight) * F.col(xs[i]) * F.col(xs[j])).alias(f"a{i}_{j}") for i in range(d) for j in range(d)] + [F.sum(F.col(weight) * F.col(x) * F.col(y)).alias(f"b{i}") for i, x in enumerate(xs)]

    def solve(frames):
        for pdf in frames:
            a = pdf[[f"a{i}_{j}" for i in range(d) for j in range(d)]].to_numpy(float).reshape(-1, d, d)
            b = pdf[[f"b{i}" for i in range(d)]].to_numpy(float)
            coef = np.array([np.linalg.lstsq(m, v, rcond=None)[0] for m, v in zip(a, b, strict=True)]).reshape(-1, d)
            yield pd.concat([pdf[by].reset_index(drop=True), pd.DataFrame(coef, columns=[f"coef_{x}" for x in xs])], axis=1)

    grouped = df.groupBy(*by).agg(*sums, F.count(weight).alias("_rows"))
    grouped = grouped.where("_rows > 0") if positive else grouped
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + "".join(f", `coef_{x}` double" for x in xs)
    return grouped.mapInPandas(solve, schema)


def bootstrap_regression(df: DataFrame, by: list[str], key: list[str], xs: list[str], y: str, weight: str, replicates: int, seed: int = 1) -> DataFrame:
    """(by, replicate, coef_x, inverse_x): weighted least squares in each Poisson replicate; replicates with a negative coefficient are left out."""
    rows = _replicates(df.select(*dict.fromkeys([*by, *key, *xs, y, weight])), key, replicates, seed, "replicate").withColumn("_w", F.col("_k") * F.col(weight))
    out = weighted_regression(rows, [*by, "replicate"], xs, y, "_w", positive=True)
    good = out.where(~F.greatest(*((F.col(f"coef_{x}") < 0) for x in xs)) if len(xs) > 1 else F.col(f"coef_{xs[0]}") >= 0)
    return good.withColumns({f"inverse_{x}": 1 / F.nullif(F.col(f"coef_{x}"), F.lit(0.0)) for x in xs})


def silhouette(df: DataFrame, key: str, label: str, xs: list[str], most_clusters: int = 10_000) -> DataFrame:
    """(key, label, silhouette) by mean squared distances, from sums by cluster instead of pairs; 0 in a cluster of one. Clusters are counted before they are sent to every task."""
    square = sum((F.col(x) * F.col(x) for x in xs), F.lit(0.0))
    sums = df.groupBy(F.col(label).alias("_c")).agg(F.count("*").alias("_n"), F.sum(square).alias("_q"), *(F.sum(x).alias(f"_s{k}") for k, x in enumerate(xs)))
    if (n := sums.count()) > most_clusters:
        raise ValueError(f"{n} clusters: silhouettes compare each row with every cluster")
    total = F.col("_n") * square + F.col("_q") - 2 * sum((F.col(x) * F.col(f"_s{k}") for k, x in enumerate(xs)), F.lit(0.0))
    rows = df.select(key, label, *xs).join(F.broadcast(sums)).withColumn("_d", F.greatest(total, F.lit(0.0)))
    own = F.col("_c") == F.col(label)
    both = rows.groupBy(key, label).agg(F.max(F.when(own, F.col("_n"))).alias("_m"), F.max(F.when(own & (F.col("_n") > 1), F.col("_d") / (F.col("_n") - 1))).alias("_a"), F.min(F.when(~own, F.col("_d") / F.col("_n"))).alias("_b"))
    return both.select(key, label, F.when(F.col("_m") == 1, 0.0).otherwise((F.col("_b") - F.col("_a")) / F.nullif(F.greatest("_a", "_b"), F.lit(0.0))).alias("silhouette"))


def natural_breaks(df: DataFrame, value: str, classes: int, most_values: int = 5_000) -> DataFrame:
    """(class from 1, upper): the upper ends of the classes of least summed squared deviation (Jenks), from the distinct values and their counts, which are counted before they come to the driver."""
    import numpy as np

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    rows = counts.orderBy("v").limit(most_values + 1).collect()
    if len(rows) > most_values:
        raise ValueError(f"more than {most_values} distinct values: round them first")
    v, n = np.array([r["v"] for r in rows]), np.array([r["n"] for r in rows], float)
    w, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, n * v, n * v * v))
    size = len(v)
    i, j = np.meshgrid(np.arange(size + 1), np.arange(size + 1), indexing="ij")
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = np.where(j > i, (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (w[j] - w[i]), np.inf)
    best, back = cost[0], []
    for _ in range(min(classes, size) - 1):
        total = best[:, None] + cost
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    cuts, at = [size], size
    for b in reversed(back):
        at = int(b[at])
        cuts.append(at)
    uppers = [float(v[c - 1]) for c in sorted(c for c in cuts if c > 0)] if size else []
    return df.sparkSession.createDataFrame(list(enumerate(uppers, 1)), "class int, upper double")


#: Ids in one block, ids of a label in one part, and pairs of ids that one task makes.
BLOCK, PART, PAIRS = 256, 4096, 20_000_000


def coassociation(runs: DataFrame, digits: int | None = None) -> DataFrame:
    """Share of runs in which two ids have one label, rounded to `digits` if given; runs: id, run, label. Ids are the rows of one survey, compared within (run, label).

    The result has all such pairs, so nothing is kept or shuffled by pair: ids with the same labels in all runs are dealt
    to blocks, the blocks of a label to parts, and pairs of parts meet in tasks. A pair of blocks counts where the first label that they
    share meets, and has its share of runs from their labels; only then its pairs of ids are made.
    """
    from .graph import checkpointed

    n = runs.select("run").distinct().count()
    # Rows without a value in id, run or label are equal to none.
    rows = runs.select("id", "run", "label").where("id is not null and run is not null and label is not null").groupBy("id", "run", "label").agg(F.count("*").alias("c"))
    keys = checkpointed(rows.groupBy("run", "label").agg(F.count("*").alias("_ids")).withColumn("k", F.monotonically_increasing_id()))
    marks = rows.join(keys.select("run", "label", "k"), ["run", "label"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("t"))
    marks = checkpointed(marks)
    sizes = marks.groupBy("t").agg(F.count("*").alias("_n"))
    blocks = marks.join(sizes, "t").withColumn("_slot", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / BLOCK)))
    blocks = checkpointed(blocks.groupBy("t", "_slot").agg(F.collect_list("id").alias("ids")).select(F.monotonically_increasing_id().alias("block"), F.col("t.k").alias("ks"), F.col("t.c").alias("cs"), "ids"))
    parts = F.ceil(F.col("_ids") / PART)
    total = keys.agg(F.sum(F.col("_ids") * F.col("_ids") / 2)).first()[0] or 0
    tasks = int(min(max(total // PAIRS, runs.sparkSession.sparkContext.defaultParallelism), 20_000))
    dealt = blocks.withColumn("k", F.explode("ks")).join(keys.select("k", parts.alias("_parts")), "k").withColumn("_at", F.pmod(F.xxhash64("block"), F.col("_parts")))
    # A pair of parts (low, high) gets the blocks of both; they meet once, the first from the low one.
    low = dealt.withColumn("_high", F.explode(F.sequence("_at", F.col("_parts") - 1))).withColumnRenamed("_at", "_low").drop("_parts")
    high = dealt.withColumn("_low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_at")))).withColumnRenamed("_at", "_high").drop("_parts")
    high = high.withColumnsRenamed({c: f"{c}2" for c in ("block", "ks", "cs", "ids")})
    on = ["k", "_low", "_high"]
    met = low.repartition(tasks, *on).join(high.repartition(tasks, *on).hint("merge"), on).where((F.col("_low") < F.col("_high")) | (F.col("block") <= F.col("block2")))
    both = F.array_intersect("ks", "ks2")
    times = lambda x: F.element_at("cs", F.array_position("ks", x).cast("int")) * F.element_at("cs2", F.array_position("ks2", x).cast("int"))
    share = F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + times(x)) / n
    share = share if digits is None else F.round(share, digits)  # once a pair of blocks
    met = met.where(F.array_min(both) == F.col("k")).select("block", "block2", "ids", "ids2", share.alias("similarity"))
    pairs = met.withColumn("_a", F.explode("ids")).withColumn("_b", F.explode("ids2")).where((F.col("block") != F.col("block2")) | (F.col("_a") < F.col("_b")))
    return pairs.select(F.least("_a", "_b").alias("id"), F.greatest("_a", "_b").alias("id2"), "similarity")


def mean_coassociation(runs: DataFrame) -> DataFrame:
    """(id, similarity): each id's mean share of runs with one label over all ids, itself included, from the sizes of the labels instead of pairs."""
    sizes = runs.groupBy("run", "label").agg(F.count("*").alias("_n"))
    total = runs.agg(F.count("*").alias("_rows"))  # runs times ids
    means = runs.join(sizes, ["run", "label"]).groupBy("id").agg(F.sum("_n").alias("_s"))
    return means.crossJoin(F.broadcast(total)).select("id", (F.col("_s") / F.col("_rows")).alias("similarity"))


def median_coassociation(runs: DataFrame) -> DataFrame:
    """(id, similarity): each id's median share of runs with one label over all ids, itself included, as `coassociation` has them, without pairs of ids.

    Ids with the same labels in all runs are one row with their number; pairs of such rows that share a label are counted
    by their shared runs, and the others share none. runs: id, run, label, one label an id and run. Pairs
    grow with the different label tuples that meet, not with ids.
    """
    from .graph import checkpointed

    labels = F.array_sort(F.collect_list(F.struct("run", "label")))
    ids = checkpointed(runs.groupBy("id").agg(labels.alias("t")))
    tuples = checkpointed(ids.groupBy("t").agg(F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()))
    total, width = ids.count(), runs.select("run").distinct().count()
    marks = tuples.select("key", "n", F.explode("t").alias("m"))
    other = marks.select(F.col("key").alias("key2"), F.col("n").alias("n2"), "m")
    shared = marks.join(other, "m").groupBy("key", "key2").agg(F.count("*").alias("k"), F.max("n2").alias("n2"))
    bins = shared.groupBy("key", "k").agg(F.sum("n2").alias("c"))
    none = bins.groupBy("key").agg((F.lit(total) - F.sum("c")).alias("c")).select("key", F.lit(0).cast("long").alias("k"), "c")
    up = Window.partitionBy("key").orderBy("k")  # at most one row a number of runs
    ranked = bins.unionByName(none).where("c > 0").withColumn("upto", F.sum("c").over(up))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("k")))  # noqa: E731  the value of rank r from 0
    medians = ranked.groupBy("key").agg(((at((total - 1) // 2) + at(total // 2)) / 2 / width).alias("similarity"))
    return ids.join(tuples.select("key", "t"), "t").join(medians, "key").select("id", "similarity")


def k_prototypes(df: DataFrame, key: str, numbers: list[str], categories: list[str], starts: list[tuple], gamma: float, rounds: int = 20) -> DataFrame:
    """(key, cluster from 0, distance) by k-prototypes: squared distance of the numbers plus gamma for each category that differs. starts: the first prototypes, numbers then categories; a round moves each prototype to its rows' means and most frequent categories (ties: the least).

    A prototype without rows stays. Rounds end when no row changes its cluster; only the k prototypes come to the driver.
    Raises if rows still move after `rounds`.
    """
    width = len(numbers)

    def nearest(centres: list[tuple]) -> Column:
        def far(c: tuple) -> Column:
            apart = sum(((F.col(x) - float(m)) * (F.col(x) - float(m)) for x, m in zip(numbers, c, strict=False)), F.lit(0.0))
            return apart + gamma * sum((F.when(F.col(x).eqNullSafe(F.lit(m)), 0).otherwise(1) for x, m in zip(categories, c[width:], strict=True)), F.lit(0))

        return F.array_min(F.array(*(F.struct(far(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centres))))

    centres, before = [tuple(c) for c in starts], None
    for _ in range(rounds + 1):
        was = nearest(before)["cluster"] if before else F.lit(-1)
        rows = df.select(key, *numbers, *categories, nearest(centres).alias("_b"), was.alias("_was")).withColumn("cluster", F.col("_b.cluster"))
        moved = rows.groupBy("cluster").agg(F.sum((F.col("cluster") != F.col("_was")).cast("long")).alias("_n"), *(F.avg(x).alias(x) for x in numbers), *(F.mode(x, True).alias(x) for x in categories))
        found = {r["cluster"]: r for r in moved.collect()}
        if not sum(r["_n"] for r in found.values()):
            return rows.select(key, "cluster", F.col("_b.distance").alias("distance"))
        before, centres = centres, [tuple(found[k][x] for x in (*numbers, *categories)) if k in found else c for k, c in enumerate(centres)]
    raise ValueError(f"rows still move after {rounds} rounds")


def _tuples(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """One row for each tuple of categories that occurs: its rows, the means of its numbers, and _density: the mean share of rows that have each of its categories."""
    from .graph import checkpointed

    out = df.groupBy(*categories).agg(F.count("*").alias("_n"), *(F.avg(x).alias(x) for x in numbers))
    total = df.count()
    for i, c in enumerate(categories):
        share = df.groupBy(F.col(c).alias("_value")).agg((F.count("*") / total).alias(f"_share{i}"))
        out = out.join(share, F.col(c).eqNullSafe(F.col("_value"))).drop("_value")
    density = sum((F.col(f"_share{i}") for i in range(len(categories))), F.lit(0.0)) / len(categories)
    return checkpointed(out.withColumn("_density", density).drop(*(f"_share{i}" for i in range(len(categories)))))


def _mismatches(categories: list[str], start: tuple) -> Column:
    return sum((F.when(F.col(c).eqNullSafe(F.lit(v)), 0).otherwise(1) for c, v in zip(categories, start, strict=True)), F.lit(0))


def density_starts(df: DataFrame, numbers: list[str], categories: list[str], k: int) -> list[tuple]:
    """Starts for k_prototypes from dense tuples of categories that differ: first the densest, then each time the one with the greatest least product of density and mismatches to those before (ties: the least tuple), with the means of its rows' numbers. Fewer where fewer tuples occur; one row a start comes to the driver."""
    tuples, starts = _tuples(df, numbers, categories), []
    for _ in range(k):
        score = F.least(*(F.col("_density") * _mismatches(categories, s[len(numbers) :]) for s in starts)) if len(starts) > 1 else F.col("_density") * (_mismatches(categories, starts[0][len(numbers) :]) if starts else 1)
        best = tuples.withColumn("_score", F.round(score, 12)).where("_score > 0").orderBy(F.col("_score").desc(), *categories).limit(1).collect()
        if not best:
            break
        starts.append(tuple(best[0][c] for c in (*numbers, *categories)))
    return starts


def frequency_starts(df: DataFrame, numbers: list[str], categories: list[str], k: int, seed: int) -> list[tuple]:
    """Starts for k_prototypes drawn by frequency: each category's value with the probability of its share of rows, then the tuple not yet taken that differs least from the draw (ties: the one with most rows, then the least); numbers are drawn about their mean with their deviation. Fewer where fewer tuples occur. Draws depend on the seed only."""
    from .simulation import standard_normal

    tuples, starts = _tuples(df, numbers, categories), []
    spark = df.sparkSession
    stats = df.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(numbers)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(numbers)), F.count("*").alias("n")).first()
    upto = [df.groupBy(c).agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))) for c in categories]  # one row a value
    for j in range(k):
        rolls = spark.range(1).select(*(draw(F.lit(j), F.lit(i), F.lit(seed)).alias(f"u{i}") for i in range(len(categories))), *(standard_normal(F.lit(j), F.lit(i), F.lit(seed)).alias(f"z{i}") for i in range(len(numbers)))).first()
        drawn = tuple((r[0][c] if (r := own.where(F.col("_upto") > rolls[f"u{i}"] / float(1 << 28) * stats["n"]).orderBy("_upto").limit(1).collect()) else None) for i, (c, own) in enumerate(zip(categories, upto, strict=True)))
        left = tuples
        for s in starts:
            left = left.where(_mismatches(categories, s[len(numbers) :]) > 0)
        best = left.orderBy(_mismatches(categories, drawn), F.col("_n").desc(), *categories).limit(1).collect()
        if not best:
            break
        starts.append((*(stats[f"m{i}"] + stats[f"s{i}"] * rolls[f"z{i}"] for i in range(len(numbers))), *(best[0][c] for c in categories)))
    return starts


def relabel(df: DataFrame, label: str, value: str) -> DataFrame:
    """Clusters numbered from 0 by ascending mean."""
    means = df.groupBy(label).agg(F.avg(value).alias("_m"))
    ranked = means.withColumn("cluster", F.dense_rank().over(Window.orderBy("_m")) - 1)  # one row a cluster
    return df.join(ranked.select(label, "cluster"), label)
