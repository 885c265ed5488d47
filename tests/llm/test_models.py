"""Classifiers, language models and line labelling: held-out accuracy, brute force and odd inputs."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from hydrostrata.llm import lm_score, quality_crf, quality_qda, toxicity
from hydrostrata.llm.stats import base_counts, words_of

from .helpers import frame, odd_rows

BIG = "/root/testdata/sf0.01"


def labels_of(spark):
    return spark.read.parquet(f"{BIG}/labels.parquet")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def accuracy(spark, out, column):
    rows = out.join(labels_of(spark), "doc_id").where("held_out").collect()
    assert len(rows) > 40 and all(0 <= r["score"] <= 1 for r in rows)
    return sum(r["predicted"] == r[column] for r in rows) / len(rows)


def test_quality(spark):
    docs = quality_qda.documents(spark, BIG)
    out = quality_qda.score_quality(docs, labels_of(spark)).cache()
    assert out.count() == docs.count() and accuracy(spark, out, "quality") >= 0.95


def test_quality_odd(spark):
    docs = frame(spark, odd_rows())
    odd = [(i, i % 2, 0) for i in range(1, 14)] * 2 + [(1, None, None), (2, 1 - 2 % 2, 0), (None, 1, 1)]
    for labels in (no_labels(spark), spark.createDataFrame(odd, "doc_id long, quality int, toxic int")):
        rows = quality_qda.score_quality(docs, labels).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], set()).add(r["score"])
        assert len(by[13]) == 1
    assert quality_qda.score_quality(frame(spark, []), labels_of(spark)).count() == 0


def test_qda_matches_density():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (200, 3)), 1: rng.normal(1, 2, (300, 3))}
    model = quality_qda.fit({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}, pool=0.0, ridge=0.0)
    at = rng.normal(0, 1, (20, 3))

    def logpdf(v, p):
        c = np.cov(v.T, bias=True)
        d = p - v.mean(axis=0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]

    odds = logpdf(x[1], at) - logpdf(x[0], at) + math.log(301 / 502) - math.log(201 / 502)
    assert np.allclose(model.score(at), 1 / (1 + np.exp(-odds)), atol=1e-8)


def test_quality_equal_texts(spark):
    """Classes whose labelled texts are all equal have no spread; the fit still gives the right side."""
    rows = [(i, "good words in a row here." if i % 2 else "BAD ### BAD ### 1 2 3") for i in range(1, 200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    out = quality_qda.score_quality(frame(spark, rows), labels).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == r["doc_id"] % 2 for r in out)


def brute_vector(text):
    """The sixteen statistics by their names."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip()]
    _, chars, symbols, dup, repeat = brute_base(text)
    n, k, m = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    latin = [c for c in text if ord(c) < 256 and c not in "ªµº"]
    upper, lower = sum(c.isupper() for c in latin), sum(c.islower() or c == "÷" for c in latin)
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    share = lambda x: math.asin(math.sqrt(min(max(x, 0), 1)))
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(chars / k), math.log1p(max((len(w.encode()) for w in words), default=0)),
        share(symbols / n), share(upper / max(upper + lower, 1)), share(sum(c in "0123456789" for c in text) / n), share(marks / n), share(len(set(words)) / k), share(sum(a == b for a, b in zip(words, words[1:])) / k),
        share(max(Counter(words).values(), default=0) / k), share(dup / m), share(repeat / k), math.log1p(len(text) / m), share(sum(x[-1] not in ".!?:;\"'" for x in lines) / m), share(sum(w[-1] in "!#*$%&|<>" for w in words) / k),
    ]


def test_quality_features_and_scores(spark):
    """Vectors, class moments and scores against loops."""
    docs = quality_qda.documents(spark, BIG)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    vectors = {i: brute_vector(t) for i, t in texts.items()}
    assert all(np.allclose(r["x"], vectors[r["doc_id"]], atol=1e-9) for r in quality_qda.features(docs).collect())
    import zlib

    learn = [(r["doc_id"], r["quality"]) for r in labels_of(spark).collect() if r["quality"] is not None and r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    x = {y: np.array([vectors[i] for i, q in learn if q == y]) for y in (0, 1)}
    both = np.concatenate([x[0], x[1]])
    cov = {y: np.cov(v.T, bias=True) for y, v in x.items()}
    pooled = sum(len(x[y]) * cov[y] for y in x) / len(both)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    dens = {}
    for y in x:
        s = (0.8 * cov[y] + 0.2 * pooled) / np.outer(scale, scale)
        s = 0.98 * s + 0.02 * np.trace(s) / len(s) * np.eye(len(s))
        d = (np.array([vectors[i] for i in texts]) - x[y].mean(axis=0)) / scale
        dens[y] = math.log((len(x[y]) + 1) / (len(both) + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)
    want = dict(zip(texts, 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -50, 50)))))
    assert all(math.isclose(r["score"], want[r["doc_id"]], abs_tol=1e-6) for r in quality_qda.score_quality(docs, labels_of(spark)).collect())


def test_toxicity_model(spark):
    """Gram counts against sets of substrings; the fitted weights are a stationary point of the penalised loss."""
    rows = [(1, "You are BAD bad"), (2, "fine text"), (3, "bad"), (4, None), (5, "fine  fine")]
    y = {1: 1, 2: 0, 3: 1, 4: 0, 5: 0}
    docs = spark.createDataFrame([(t, y[i]) for i, t in rows], "text string, y int")
    want = np.zeros((2, 1 << toxicity.BITS), int)
    for i, t in rows:
        s = f" {' '.join((t or '').lower().split())} ".encode() if t else b""
        own = {g for n in toxicity.SIZES for p in range(len(s) - n + 1) for g in [s[p : p + n]]}
        slots = {int(toxicity.mix64(np.array([(sum((b + 1) * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k, b in enumerate(g)) + len(g)) % (1 << 64)], np.uint64))[0] >> np.uint64(64 - toxicity.BITS)) for g in own}
        want[y[i], sorted(slots)] += 1
    assert (toxicity.gram_counts(docs) == want).all()
    rng = np.random.default_rng(3)
    feats = [np.unique(rng.integers(0, 40, 8)) for _ in range(60)]
    gold = np.array([int(3 in f or 7 in f) for f in feats])
    ratios = np.zeros(1 << toxicity.BITS)
    ratios[:40] = rng.normal(size=40)
    coef, bias = toxicity.fit_linear(feats, gold, ratios, steps=4000)
    x = np.zeros((60, 40))
    for k, f in enumerate(feats):
        x[k, f] = 1
    s = x @ coef[:40] + bias
    weight = np.where(gold == 1, 0.5 / gold.sum(), 0.5 / (1 - gold).sum())
    e = weight * (1 / (1 + np.exp(-s)) - gold)
    r = ratios[:40]
    assert abs(e.sum()) < 2e-3 and abs(e @ (x @ r)) < 2e-3
    assert ((s > 0) == gold).mean() > 0.95


def test_toxicity(spark):
    docs = toxicity.documents(spark, BIG)
    out = toxicity.score_toxicity(docs, labels_of(spark)).cache()
    assert out.count() == docs.count() and accuracy(spark, out, "toxic") >= 0.9


def test_toxicity_odd(spark):
    docs = frame(spark, odd_rows())
    odd = [(i, 0, i % 2) for i in range(1, 14)] * 2 + [(1, None, None), (None, 1, 1)]
    for labels in (no_labels(spark), spark.createDataFrame(odd, "doc_id long, quality int, toxic int")):
        rows = toxicity.score_toxicity(docs, labels).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(frame(spark, []), labels_of(spark)).count() == 0


def test_log_ratios():
    counts = np.array([[100, 0, 50, 2], [1, 40, 6, 0]])
    r = toxicity.log_ratios(counts, (1000, 100))
    assert r[1] > 2 and r[0] < -1 and r[3] == 0  # rare features are neutral


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_line_labels(spark):
    docs = quality_crf.documents(spark, BIG)
    crf = quality_crf.train(docs, labels_of(spark), 300)
    rows = quality_crf.judge(docs, crf).join(labels_of(spark).select("doc_id", "quality"), "doc_id", "left").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        base = brute_base(texts[r["doc_id"]])
        assert tuple(r)[1:6] == base
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r["base_failed"] and r["kept"])
    judged = [r for r in rows if r["quality"] is not None and not r["base_failed"]]
    assert sum(r["kept"] == (r["quality"] == 1) for r in judged) >= 0.95 * len(judged)


def test_line_labels_odd(spark):
    docs = frame(spark, odd_rows())
    assert quality_crf.train(docs, no_labels(spark)) is None
    field = quality_crf.Crf(np.random.default_rng(2).normal(size=(2, quality_crf.D)), np.array([[0.5, -0.2], [0.1, 0.3]]), np.array([0.1, -0.1]))
    for r in quality_crf.judge(docs, field).collect():  # decoding meets odd texts too
        assert 0 <= r["content_share"] <= 1 and r["kept"] == (not r["base_failed"] and r["content_share"] >= quality_crf.LEAST_SHARE)
    rows = quality_crf.judge(docs, None).collect()
    assert sorted(tuple(r)[1:6] for r in rows) == sorted(brute_base(t) for _, t in odd_rows())
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert quality_crf.judge(frame(spark, []), None).count() == 0


def test_line_labels_of_sample():
    docs = [(1, np.array([1, 2, 2])), (1, np.array([1, 3])), (0, np.array([1, 4])), (1, np.array([5]))]
    assert [g.tolist() for g in quality_crf.line_labels(docs)] == [[False, True, True], [False, True], [False, False], [True]]


def test_field_fit():
    """Against all label paths: the fitted field is a maximum of the penalised likelihood, and its transitions follow the labels."""
    rng = np.random.default_rng(6)
    seqs, gold = [], []
    for n in rng.integers(1, 6, 40):
        x = rng.normal(size=(n, quality_crf.D)) * 0.3
        g = np.zeros(n, bool)
        g[0] = rng.random() < 0.5
        for i in range(1, n):
            g[i] = g[i - 1] ^ (rng.random() < 0.2)
        x[:, 1] += g
        seqs.append(x)
        gold.append(g)
    weights = np.full(40, 1 / 40)
    crf = quality_crf.Crf.fit(seqs, gold, weights, steps=3000, penalty=0.01)

    def value(theta):
        emit, move, begin = theta[: 2 * quality_crf.D].reshape(2, -1), theta[-6:-2].reshape(2, 2), theta[-2:]
        total = 0.0
        for x, g, w in zip(seqs, gold, weights):
            e = x @ emit.T
            score = lambda y: begin[y[0]] + sum(e[i, y[i]] for i in range(len(y))) + sum(move[a, b] for a, b in zip(y, y[1:]))
            total += w / len(x) * (score(g.astype(int).tolist()) - np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=len(x))]))
        return total - 0.005 * theta @ theta

    theta = np.concatenate([crf.emit.ravel(), crf.move.ravel(), crf.begin])
    top = value(theta)
    for k in range(0, len(theta)):
        for step in (0.05, -0.05):
            moved = theta.copy()
            moved[k] += step
            assert value(moved) < top + 1e-6
    assert crf.move[0, 0] + crf.move[1, 1] > crf.move[0, 1] + crf.move[1, 0]  # labels stay


def test_kept_by_all_paths(spark):
    """content_share and kept against the best of all label paths."""
    docs = quality_crf.documents(spark, "/root/testdata/sf0.001")
    crf = quality_crf.Crf(np.random.default_rng(4).normal(size=(2, quality_crf.D)) * 0.6, np.array([[0.8, -0.4], [-0.3, 0.5]]), np.array([0.2, 0.1]))
    texts, met = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, 0
    for r in quality_crf.judge(docs, crf).collect():
        rows, sizes = quality_crf.line_vectors(texts[r["doc_id"]])
        if not 0 < len(rows) <= 9:
            continue
        met += 1
        e = np.array(rows) @ crf.emit.T
        score = lambda y: crf.begin[y[0]] + sum(e[i, y[i]] for i in range(len(y))) + sum(crf.move[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        share = sum(n for n, y in zip(sizes, best) if y) / sum(sizes)
        assert math.isclose(r["content_share"], share, abs_tol=1e-12) and r["kept"] == (not r["base_failed"] and share >= quality_crf.LEAST_SHARE)
    assert met > 20


def test_viterbi():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        crf = quality_crf.Crf(rng.normal(size=(2, quality_crf.D)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(n, quality_crf.D))
        e = x @ crf.emit.T
        score = lambda y: crf.begin[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(crf.move[a, b] for a, b in zip(y, y[1:]))
        assert tuple(crf.viterbi(x)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_lm(spark, sf_dir):
    texts = odd_rows() + [(50 + k, " ".join(random.Random(k).choices(["Red", "green", "blue", "tea"], k=30))) for k in range(20)]
    docs = frame(spark, texts)
    good = spark.createDataFrame([(50 + k,) for k in range(10)], "doc_id long")
    out = {(r["doc_id"], r["n_tokens"]): r for r in lm_score.score_documents(docs, good).collect()}
    vocab = {w: k for k, (w, _) in enumerate(sorted(Counter(w for _, t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())).items(), key=lambda x: (-x[1], x[0])))}
    v = len(vocab)
    counts = []
    seqs = [(i, [v + 1, *(vocab[w] for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))]) for i, t in texts]
    for keep in (lambda i: True, lambda i: i is not None and 50 <= i < 60):
        uni, ctx, big = Counter(), Counter(), Counter()
        for i, s in seqs:
            if keep(i):
                uni.update(s[1:])
                ctx.update(s[:-1])
                big.update(zip(s, s[1:]))
        counts.append((uni, ctx, big, sum(uni.values())))
    for i, s in seqs:
        loss = []
        for uni, ctx, big, n in counts:
            p = [lm_score.UNIGRAM * (uni[b] + 1) / (n + v + 2) + (1 - lm_score.UNIGRAM) * (big[a, b] / ctx[a] if ctx[a] else 0) for a, b in zip(s, s[1:])]
            loss.append(-sum(map(math.log, p)) / max(len(p), 1))
        r = out[i, len(s) - 1]
        assert math.isclose(r["background_loss"], loss[0], rel_tol=1e-5, abs_tol=1e-9) and math.isclose(r["score"], loss[1] - loss[0], rel_tol=1e-4, abs_tol=1e-6)
    assert lm_score.score_documents(frame(spark, []), good).count() == 0
    assert lm_score.score_documents(docs, good.limit(0)).count() == len(texts)


def test_lm_keeps_every_word_and_bigram(spark):
    """60,000 words of equal count: each keeps its own counts."""
    texts = [(k, " ".join(f"w{j % 60_000}" for j in range(1000 * k, 1000 * k + 1000))) for k in range(120)]
    docs = frame(spark, texts).repartition(3)
    out = {r["doc_id"]: r for r in lm_score.score_documents(docs, spark.createDataFrame([(0,), (1,)], "doc_id long")).collect()}
    uni, ctx, big = ([Counter(), Counter()] for _ in range(3))
    for i, t in texts:
        s = ["", *t.split()]
        for k in (0, 1) if i < 2 else (0,):
            uni[k].update(s[1:])
            ctx[k].update(s[:-1])
            big[k].update(zip(s, s[1:]))
    for i, t in texts:
        s, loss = ["", *t.split()], []
        for k in (0, 1):
            n = sum(uni[k].values()) + len(uni[0]) + 2
            p = [lm_score.UNIGRAM * (uni[k][b] + 1) / n + (1 - lm_score.UNIGRAM) * big[k][a, b] / max(ctx[k][a], 1) for a, b in zip(s, s[1:])]
            loss.append(-sum(map(math.log, p)) / len(p))
        assert math.isclose(out[i]["background_loss"], loss[0], rel_tol=1e-9) and math.isclose(out[i]["target_loss"], loss[1], rel_tol=1e-9)
