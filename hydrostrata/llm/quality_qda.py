"""Quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (logarithms of counts, arcsine roots of shares). Each
class has a mean and a covariance, shrunk towards the pooled one and towards a scaled identity. The score is
the logistic of the difference of the two log densities, whose Mahalanobis terms use Cholesky factors that are
computed once and shipped with the model (a few kilobytes, whatever the corpus).

Defined cases: null and empty texts have the statistics of the empty text and a score; rows that repeat are
scored alike; labels that are null or contradict each other for a doc_id are not learned from; with under
MIN_ROWS rows of a class the score is the smoothed share of label 1; classes whose texts are all equal have the
ridge as their covariance; very long texts are read whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, map_batches, stored, texts
from .stats import base_counts, words_of

MIN_ROWS = 8
#: Shrinkage towards the pooled covariance, and of that towards the scaled identity.
POOL, RIDGE = 0.2, 0.02
#: Least mean variance that the ridge counts on, for classes whose texts are all equal.
LEAST_SPREAD = 1e-3
FEATURES = (
    "log_chars", "log_words", "word_chars", "long_word", "symbols", "upper", "digits", "punctuation", "distinct", "same_as_last",
    "top_word", "dup_lines", "repeat_words", "line_chars", "open_lines", "marked_words",
)


def vector(text: str) -> list[float]:
    words = words_of(text)
    n_words, chars, symbols, dup, repeat = base_counts(text, words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = max(len(code), 1)
    upper = ((code >= 65) & (code <= 90)) | ((code >= 192) & (code <= 222) & (code != 215))
    lower = ((code >= 97) & (code <= 122)) | ((code >= 223) & (code <= 255))
    n_upper, n_lower = int(upper.sum()), int(lower.sum())
    digits = int(((code >= 48) & (code <= 57)).sum())
    marks = int(((code > 32) & (code < 127)).sum()) - digits - int(((code >= 65) & (code <= 90)).sum()) - int(((code >= 97) & (code <= 122)).sum())
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    k, m = max(n_words, 1), max(len(lines), 1)
    share = lambda x: float(np.arcsin(np.sqrt(min(max(x, 0.0), 1.0))))
    return [
        float(np.log1p(len(code))), float(np.log1p(n_words)), float(np.log1p(chars / k)), float(np.log1p(max(map(len, words), default=0))),
        share(symbols / n), share(n_upper / max(n_upper + n_lower, 1)), share(digits / n), share(marks / n), share(len(counts) / k), share(sum(map(eq, words, words[1:])) / k),
        share(max(counts.values(), default=0) / k), share(dup / m), share(repeat / k), float(np.log1p(len(code) / m)), share(sum(x[-1] not in ".!?:;\"'" for x in lines) / m), share(sum(w[-1:] in b"!#*$%&|<>" for w in words) / k),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and its vector."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([vector(x) for x in texts(batch.column("text"))])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), pa.array(rows.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])

    return map_batches(docs.select("doc_id", "text"), fn, f"doc_id {kind}, x array<double>")


@dataclass
class Qda:
    """shift and scale standardise; means, Cholesky factors' inverses, log determinants and log priors by class."""

    prior: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    offsets: tuple[float, float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.prior)
        z = (x - self.shift) / self.scale
        dens = [self.offsets[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -50, 50)))


def fit(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], pool: float = POOL, ridge: float = RIDGE) -> Qda:
    """sums: by class the rows, the sum of vectors and the sum of their outer products."""
    n = {k: sums[k][0] if k in sums else 0 for k in (0, 1)}
    prior = (n[1] + 1) / (n[0] + n[1] + 2)
    if min(n.values()) < MIN_ROWS:
        return Qda(prior)
    d = len(sums[0][1])
    mean = {k: sums[k][1] / n[k] for k in (0, 1)}
    cov = {k: sums[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    shift = (sums[0][1] + sums[1][1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    pooled = pooled / np.outer(scale, scale)
    means, factors, offsets = [], [], []
    for k in (0, 1):
        own = cov[k] / np.outer(scale, scale)
        s = (1 - pool) * own + pool * pooled
        s = (1 - ridge) * s + ridge * max(np.trace(s) / d, LEAST_SPREAD) * np.eye(d)
        low = np.linalg.cholesky(s)
        means.append((mean[k] - shift) / scale)
        factors.append(np.linalg.inv(low))
        offsets.append(float(np.log((n[k] + 1) / (n[0] + n[1] + 2)) - np.log(np.diag(low)).sum()))
    return Qda(prior, shift, scale, tuple(means), tuple(factors), tuple(offsets))


def class_sums(labelled: DataFrame, d: int = len(FEATURES)) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Sums over every labelled row (x, y): each task adds up its own rows, and one small row a task and class is added on."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        x = batch.column("x").flatten().to_numpy().reshape(-1, d)
        out = [(int(k), np.concatenate([[float((y == k).sum())], x[y == k].sum(axis=0), (x[y == k].T @ x[y == k]).ravel()])) for k in (0, 1)]
        size = 1 + d + d * d
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in out for _ in range(size)], pa.int32()), pa.array(list(range(size)) * 2, pa.int32()), pa.array(np.concatenate([v for _, v in out]))], ["y", "i", "v"]
        )

    parts = map_batches(labelled.select("x", "y"), fn, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in (0, 1):
        v = np.zeros(1 + d + d * d)
        for row in parts:
            if row["y"] == k:
                v[row["i"]] = row["v"]
        out[k] = int(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)
    return out


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and y, one row an id, without null and contradicting labels."""
    return labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("y"), F.max(column).alias("_most")).where("y = _most").select("doc_id", "y")


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = stored(features(docs), "quality_features")
    train = clean_labels(labels, "quality").where(crc_mod("doc_id", modulus) != held)
    model = fit(class_sums(rows.join(train, "doc_id")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = map_batches(rows, fn, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
