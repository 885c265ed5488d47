"""The located lognormal, prototypes and co-association medians against independent computations."""

import hashlib
import math
import random
import statistics

import numpy as np
import pytest

from hydrostrata.operators import learning, weighting


def profile(v, loc):
    logs = np.log(v - loc)
    return -math.log(logs.std()) - logs.mean()


def test_location_is_the_optimum(spark):
    rng = np.random.default_rng(2)
    own = {name: loc + rng.lognormal(mu, sigma, n) for name, loc, mu, sigma, n in (("a", 5.0, 1.0, 0.6, 300), ("b", 0.5, 2.0, 0.9, 150), ("c", 20.0, 0.0, 0.4, 400))}
    own["d"] = np.exp(rng.normal(3, 0.2, 200) - 0.0)  # whose best location may be an end
    rows = [(k, float(x)) for k, v in own.items() for x in v] + [("e", 3.0), ("e", 3.0), ("a", None), ("b", -1.0), (None, 2.0), (None, 5.0), (None, 9.0)]
    got = {r["g"]: r for r in learning.bounded_lognormal_fit(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v").collect()}
    own[None] = np.array([2.0, 5.0, 9.0])
    assert set(got) == set(own)  # equal values have no fit
    for k, v in own.items():
        low = v.min()
        t = np.linspace(math.log(1e-3), 0, 4001)
        best = int(np.argmax([profile(v, low - math.exp(x) * low) for x in t]))
        a, b, s = t[max(best - 1, 0)], t[min(best + 1, 4000)], (5**0.5 - 1) / 2
        while b - a > 1e-11:
            x, y = b - s * (b - a), a + s * (b - a)
            a, b = (a, y) if profile(v, low - math.exp(x) * low) > profile(v, low - math.exp(y) * low) else (x, b)
        loc = low - math.exp((a + b) / 2) * low
        assert got[k]["loc"] == pytest.approx(loc, rel=1e-6, abs=1e-6 * low) and got[k]["n"] == len(v)
        logs = np.log(v - got[k]["loc"])
        assert got[k]["mu"] == pytest.approx(logs.mean()) and got[k]["sigma"] == pytest.approx(logs.std()) and got[k]["scale"] == pytest.approx(math.exp(logs.mean()))


def test_median_equals_that_of_all_pairs(spark):
    rng = random.Random(6)
    labels = {i: [rng.randrange(3), rng.randrange(2), rng.randrange(4), rng.choice([0, 0, 0, 1])] for i in range(41)}
    labels |= {i: labels[3] for i in range(100, 130)}  # many ids of one tuple
    runs = spark.createDataFrame([(i, r, x) for i, own in labels.items() for r, x in enumerate(own)], "id long, run int, label int")
    got = {r["id"]: r["similarity"] for r in learning.median_coassociation(runs).collect()}
    want = {i: statistics.median(sum(x == y for x, y in zip(a, b)) / 4 for b in labels.values()) for i, a in labels.items()}
    assert got == pytest.approx(want)
    pairs = {(r["id"], r["id2"]): r["similarity"] for r in learning.coassociation(runs).collect()}
    assert got[5] == pytest.approx(statistics.median([1.0] + [pairs.get((min(5, j), max(5, j)), 0.0) for j in labels if j != 5]))
    two = spark.createDataFrame([(1, 1, 1), (2, 1, 9)], "id long, run int, label int")
    assert {tuple(r) for r in learning.median_coassociation(two).collect()} == {(1, 0.5), (2, 0.5)}


def test_prototypes_say_when_rows_still_move(spark):
    rows = spark.createDataFrame([(k, float(k % 7), "w" if k % 3 else "z") for k in range(40)], "k long, x double, c string")
    starts = [(0.0, "w"), (0.1, "w"), (0.2, "z")]
    with pytest.raises(ValueError, match="still move after 1"):
        learning.k_prototypes(rows, "k", ["x"], ["c"], starts, 0.5, 1)
    settled = learning.k_prototypes(rows, "k", ["x"], ["c"], starts, 0.5, 30)
    again = learning.k_prototypes(rows, "k", ["x"], ["c"], starts, 0.5, 60)
    assert sorted(map(tuple, settled.collect())) == sorted(map(tuple, again.collect()))


def test_rules_of_too_many_widths_are_refused(spark, monkeypatch):
    monkeypatch.setattr(weighting, "MOST_WIDTHS", 2)
    obs = spark.createDataFrame([("w", k, 1.0) for k in range(5)], "well string, day int, value double")
    none = spark.createDataFrame([], "well string, cutoff int")
    rules = spark.createDataFrame([("w", k, 0.5, 0.1) for k in (3, 5, 7)], "well string, width int, threshold double, low double")
    with pytest.raises(ValueError, match="more than 2 widths"):
        weighting.well_weights(obs, "well", "day", "value", none, rules)


def mixed(n, seed):
    rng = random.Random(seed)
    return [(k, rng.gauss(0, 2), rng.choice("aaabbc"), rng.choice(["x", "y", "y", None])) for k in range(n)]


def test_density_starts(spark):
    rows = mixed(200, 3)
    df = spark.createDataFrame(rows, "k long, v double, c string, e string")
    share = [{x: sum(r[i] == x for r in rows) / 200 for x in {r[i] for r in rows}} for i in (2, 3)]
    dens = {t: (share[0][t[0]] + share[1][t[1]]) / 2 for t in {r[2:] for r in rows}}
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    first = lambda score: min(dens, key=lambda t: (-round(score(t), 12), t[0], t[1] is not None, t[1] or ""))
    want = [first(dens.get)]
    while len(want) < 5:
        want.append(first(lambda t: min(dens[t] * far(t, s) for s in want)))
    got = learning.density_starts(df, ["v"], ["c", "e"], 5)
    assert [s[1:] for s in got] == want
    assert all(s[0] == pytest.approx(statistics.mean(r[1] for r in rows if r[2:] == s[1:])) for s in got)
    assert len(learning.density_starts(df, ["v"], ["c", "e"], 50)) == len(dens) and learning.density_starts(df.where("false"), ["v"], ["c", "e"], 3) == []
    settled = learning.k_prototypes(df, "k", ["v"], ["c", "e"], got, 0.5, 40)
    assert settled.count() == 200


def test_frequency_starts(spark):
    df = spark.createDataFrame(mixed(200, 4), "k long, v double, c string, e string")
    runs = [learning.frequency_starts(df.repartition(3), ["v"], ["c", "e"], 3, seed) for seed in range(6)]
    assert [s[1:] for s in runs[2]] == [s[1:] for s in learning.frequency_starts(df, ["v"], ["c", "e"], 3, 2)]
    assert all(len({s[1:] for s in run}) == 3 for run in runs) and len({tuple(s[1:] for s in run) for run in runs}) > 2
    firsts = [run[0][1] for run in runs]
    assert firsts.count("a") >= firsts.count("c")  # frequent values are drawn more often
    assert learning.frequency_starts(df.where("false"), ["v"], ["c", "e"], 2, 1) == []


def test_coassociation_without_a_shuffle_of_pairs(spark, monkeypatch):
    from hydrostrata.operators import learning

    for name, v in (("BLOCK", 3), ("PART", 7), ("PAIRS", 40)):
        monkeypatch.setattr(learning, name, v, raising=False)
    rng = np.random.default_rng(4)
    rows = [(int(i), r, int(x)) for i in range(90) for r in range(4) for x in (rng.integers(0, 3),) if (i + r) % 9] + [(5, 0, 1), (5, 0, 1), (6, 0, 1), (7, 1, None), (None, 1, 1), (8, None, 1), (9, None, 1), (10, 2, 0), (10, 2, 1), (10, 2, 2)]
    runs = spark.createDataFrame(rows, "id long, run int, label int")
    seen = {}
    for i, r, x in rows:
        for j, q, y in rows:
            if None not in (i, j, r, q, x, y) and (r, x) == (q, y) and i < j:
                seen[i, j] = seen.get((i, j), 0) + 1
    out = learning.coassociation(runs)
    got = {(r["id"], r["id2"]): r["similarity"] for r in out.collect()}
    assert len(got) == out.count() and got == {p: k / 5 for p, k in seen.items()}  # a run without a number is a run
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # pairs are neither counted nor shuffled


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_regression_draws_once(spark):
    rows = [(k, k % 2, float(k % 7 + 1), 1.0, 3.0 * (k % 7) + 10, [0.5, 0.0, -1.0, None][k % 4]) for k in range(60)] + [(99, 5, 1.0, 1.0, 2.0, -1.0)]
    df = spark.createDataFrame(rows, "id long, g int, x double, one double, y double, w double").coalesce(1)
    out = learning.bootstrap_regression(df, ["g"], ["id"], ["x", "one"], "y", "w", 6, 3)
    assert _plan(out).count("md5(") == 1  # not once more for each count and for a filter
    assert "Repartition" in _plan(out)  # one file's rows are one task's, their replicates are not
    got = {(r["g"], r["replicate"]): (r["coef_x"], r["coef_one"]) for r in out.collect()}
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])
    for g in (0, 1, 5):
        for r in range(1, 7):
            own = [(x, y, w * int((int(hashlib.md5(f"{i}-{r}-3".encode()).hexdigest()[:7], 16) / 2**28 > limits).sum())) for i, h, x, _, y, w in rows if h == g and (w or 0) > 0]
            own = [(x, y, k) for x, y, k in own if k > 0]
            if not own:
                assert (g, r) not in got
                continue
            a = np.array([[x, 1.0] for x, *_ in own]) * np.sqrt([[k] for *_, k in own])
            want = np.linalg.lstsq(a, np.array([y for _, y, _ in own]) * np.sqrt([k for *_, k in own]), rcond=None)[0]
            if min(want) > 1e-6:
                assert np.allclose(got[g, r], want)


def test_bootstrap_means_of_one_file(spark):
    df = spark.createDataFrame([(k, k % 2, float(k)) for k in range(50)], "id long, g int, v double").coalesce(1)
    out = learning.bootstrap_means(df, ["g"], ["id"], "v", 8)
    assert "Repartition" in _plan(out) and "conv(" not in _plan(out) and _plan(out).count("md5(") == 1
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])
    for row in out.collect():
        means = []
        for r in range(1, 9):
            k = {i: int((int(hashlib.md5(f"{i}-{r}-1".encode()).hexdigest()[:7], 16) / 2**28 > limits).sum()) for i in range(50) if i % 2 == row["g"]}
            means.append(sum(i * n for i, n in k.items()) / sum(k.values()))
        assert np.isclose(row["mean"], np.mean(means)) and np.isclose(row["low"], np.quantile(means, 0.025)) and np.isclose(row["high"], np.quantile(means, 0.975))


def test_bootstrap_makes_a_key_text_once_a_row(spark):
    rows = [(k, None if k % 5 == 0 else f"s{k % 3}", None if k % 7 == 0 else k, float(k)) for k in range(40)]
    out = learning.bootstrap_means(spark.createDataFrame(rows, "id long, a string, b int, v double"), [], ["a", "b"], "v", 5, 9)
    plan = _plan(out)
    assert plan.index("Generate") < plan.index("concat_ws")  # below the step that replicates the rows
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])
    means = []
    for r in range(1, 6):
        k = [int((int(hashlib.md5("-".join(str(x) for x in (a, b, r, 9) if x is not None).encode()).hexdigest()[:7], 16) / 2**28 > limits).sum()) for _, a, b, _ in rows]
        means.append(sum(n * v for n, (*_, v) in zip(k, rows)) / sum(k))
    row = out.first()
    assert np.isclose(row["mean"], np.mean(means)) and np.isclose(row["low"], np.quantile(means, 0.025)) and np.isclose(row["high"], np.quantile(means, 0.975))
