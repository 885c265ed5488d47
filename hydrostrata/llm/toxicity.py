"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Character 4- to 6-grams (bytes of the lower-cased text) are hashed into 2**20 features. Each feature is scaled
by its log-count ratio between toxic and other training texts; a logistic model over the scaled, binary
features is fitted on a fold that the ratios have not seen, its weights drawn towards their mean.

Training reads a bounded sample: at most SAMPLE labelled rows of each class, chosen by a hash of their ids. The
class prior is counted over all training labels. The model is two fixed-size arrays, whatever the corpus.

Defined cases: null and empty texts score as a text without features; labels that are null or contradict each
other for a doc_id are not learned from; without labels of both classes the score is the smoothed share of
toxic labels; rows that repeat are scored alike; a score of exactly the threshold is toxic; very long
texts are read whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, map_batches, mix64, texts
from .quality_qda import clean_labels

BITS = 20
SIZES = (4, 5, 6)
SAMPLE = 8000
#: Pseudo-counts shared by the classes, and the least ratio and count of a feature that is used.
SMOOTH, LEAST_RATIO, LEAST_COUNT = 4.0, 1.0, 3
PARTS = 16
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(max(SIZES))], np.uint64)


def grams(text: str) -> np.ndarray:
    """Feature of every n-gram, in order and with repeats."""
    data = b" ".join(text.lower().encode().split())
    if not data:
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint64) + np.uint64(1)
    out, h, done = [], np.zeros(len(b), np.uint64), 0
    for size in SIZES:
        n = len(b) - size + 1
        if n < 1:
            break
        h = h[:n]
        for k in range(done, size):
            h = h + b[k : k + n] * _POWERS[k]
        done = size
        out.append((mix64(h + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def sampled(labels: DataFrame, per_class: int) -> DataFrame:
    """At most per_class rows (doc_id, y) of each class, by a hash of the id."""
    pick = [labels.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return pick[0].unionByName(pick[1])


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Of rows (text, y): texts of each class with each feature, shape (2, 2**BITS); tasks send their own counts in parts that are added on executors."""
    width = (1 << BITS) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, y in zip(texts(batch.column("text")), batch.column("y").to_pylist(), strict=True):
                own[y, np.unique(grams(text))] += 1
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([own[:, p * width : (p + 1) * width].tobytes() for p in range(PARTS)], pa.binary())], ["part", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * width, np.int64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                total += np.frombuffer(blob, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    out = np.zeros((2, 1 << BITS), np.int64)
    for part, blob in docs.select("text", "y").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[:, part * width : (part + 1) * width] = np.frombuffer(blob, np.int64).reshape(2, width)
    return out


def log_ratios(counts: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
    """Log-count ratios; 0 for features that are rare or tell little. Pseudo-counts follow class sizes, so that unseen features are neutral."""
    share = [max(r, 1) / max(sum(rows), 1) for r in rows]
    a, b = counts[1] + SMOOTH * share[1], counts[0] + SMOOTH * share[0]
    r = np.log(a / max(rows[1], 1)) - np.log(b / max(rows[0], 1))
    r[(counts.sum(axis=0) < LEAST_COUNT) | (np.abs(r) < LEAST_RATIO)] = 0
    return r


def fit_linear(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, steps: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features: a shared weight and each feature's departure from it (penalised); returns coefficients and intercept."""
    used, flat = np.unique(np.concatenate(rows) if rows else np.empty(0, np.int64), return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = ratios[used][flat] if len(used) else np.empty(0)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    base = np.bincount(doc, value, len(rows))
    d, params = np.zeros(len(used)), np.array([0.3, 0.0])
    m, v, md, vd = np.zeros(2), np.zeros(2), np.zeros(len(used)), np.zeros(len(used))
    for t in range(1, steps + 1):
        s = params[0] * base + np.bincount(doc, value * d[flat], len(rows)) + params[1]
        e = weight * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y)
        g = np.array([e @ base, e.sum()])
        gd = np.bincount(flat, e[doc] * value, len(used)) + penalty * d
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        md, vd = 0.9 * md + 0.1 * gd, 0.99 * vd + 0.01 * gd * gd
        rate = 0.03 / (1 + t / 100)
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        d = d - rate * (md / (1 - 0.9**t)) / (np.sqrt(vd / (1 - 0.99**t)) + 1e-6)
    coef = params[0] * ratios
    coef[used] += d * ratios[used]
    return coef, float(params[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[np.ndarray | None, float]:
    """Coefficients by feature and intercept; labels: training rows (doc_id, y). Of the sample, one fold in four fits the weights."""
    spark = docs.sparkSession
    n = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    odds = float(np.log(prior / (1 - prior)))
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return None, odds
    pick = spark.createDataFrame(sampled(labels, per_class).collect(), labels.schema)  # at most 2 * per_class ids
    chosen = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)))
    first = chosen.where("_fold <> 0")
    sizes = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ratios = log_ratios(gram_counts(first), (sizes.get(0, 0), sizes.get(1, 0)))

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(g[ratios[g] != 0]).astype(np.int32).tobytes() for g in map(grams, texts(batch.column("text")))]
        return pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.binary())], ["y", "grams"])

    fold = map_batches(chosen.where("_fold = 0").select("text", "y"), own, "y int, grams binary").collect()
    y = np.array([r["y"] for r in fold])
    if len(set(y.tolist())) < 2:
        return ratios * 0.3, odds
    order = sorted(range(len(fold)), key=lambda k: (y[k], bytes(fold[k]["grams"])))  # the same sums in every run
    coef, bias = fit_linear([np.frombuffer(fold[k]["grams"], np.int32).astype(np.int64) for k in order], y[order], ratios)
    return coef, bias


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = 0.5, per_class: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; the folds are those of the contract."""
    train = clean_labels(labels, "toxic").where(crc_mod("doc_id", modulus) != held)
    scored = with_toxicity(docs.select("doc_id", "text"), fit(docs, train, per_class))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_toxicity(docs: DataFrame, model: tuple[np.ndarray | None, float], keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns keep (doc_id) and the score of every row, under the given name."""
    keep = keep or ["doc_id"]
    coef, bias = model
    coef = None if coef is None else coef.astype(np.float32)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.full(batch.num_rows, bias)
        if coef is not None:
            for k, text in enumerate(texts(batch.column("text"))):
                g = grams(text)
                g = g[coef[g] != 0]
                if len(g):
                    s[k] += coef[np.unique(g)].sum(dtype=np.float64)
        score = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], [*keep, name])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs, fn, f"{schema}, `{name}` double")


def op4_toxicity_nb_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
