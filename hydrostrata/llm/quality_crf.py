"""Quality rules by line labelling: a linear-chain conditional random field marks each line content or boilerplate.

Emissions are linear in the line's statistics, transitions couple neighbours, and Viterbi decoding gives the
labels. A document is kept if it passes the base rules and at least LEAST_SHARE of the code points of its
non-blank lines are content. The field is trained by gradient ascent on the conditional likelihood, from labels of
lines: content is a line of a document labelled good, unless COMMON or more different documents of the sample hold
it; such lines, and those of poor documents, are boilerplate. So labels change inside documents, and transitions are
learned.

Training reads a bounded sample: at most SAMPLE labelled documents of each class, chosen by a hash of their
ids; texts of more than MOST_LINES lines are cut into sequences of that many. Base counts and decoding cover every
line of every text.

Defined cases: a null or empty text has no words and fails the base rules; without labels of both classes
every line is content; rows that repeat are judged alike, and count once in training; very long texts are decoded
whole; in a tie a line is content; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, texts
from .quality_qda import clean_labels
from .stats import base_counts, words_of

SAMPLE, MOST_LINES = 1500, 200
#: Documents of the sample that must hold a line for it to be boilerplate.
COMMON = 3
LEAST_SHARE = 0.5
LEAST_WORDS, MOST_REPEAT_PERCENT = 20, 30
LINE_FEATURES = ("bias", "log_chars", "symbols", "marked_words", "upper", "digits", "pipes", "open_end", "same_as_last", "distinct", "seen_before", "short_words", "exclaimed")
D = len(LINE_FEATURES)


def line_vectors(text: str) -> tuple[list[list[float]], list[int]]:
    """Statistics and code points of each non-blank line."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        letters = [w for w in words if w[:1].isalpha()]
        upper = sum(w.isupper() and len(w) > 1 for w in letters)
        last = [w[-1] for w in words]
        rows.append([
            1.0, np.log1p(n) / 5, sum(map(line.count, "#*$%&|<>")) / n * 4, sum(c in "#*$%&|<>" for c in last) / k, upper / k, sum(map(line.count, "0123456789")) / n * 4,
            words.count("|") / k * 2, float(line.rstrip()[-1] not in ".!?:;"), sum(map(eq, words, words[1:])) / k, len(set(words)) / k, float(line in seen), sum(map((2).__ge__, map(len, words))) / k, last.count("!") / k,
        ])
        sizes.append(n)
        seen.add(line)
    return rows, sizes


class Crf:
    """Two labels, 0 boilerplate and 1 content. emit: (2, D); move: (2, 2) from, to; begin: (2,)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        e = (x @ self.emit.T).tolist()
        (aa, ab), (ba, bb) = self.move.tolist()
        s0, s1 = self.begin[0] + e[0][0], self.begin[1] + e[0][1]
        back = []
        for e0, e1 in e[1:]:
            from0, from1 = s0 + aa >= s1 + ba, s0 + ab > s1 + bb
            back.append((not from0, not from1))  # the label before, by the label here
            s0, s1 = max(s0 + aa, s1 + ba) + e0, max(s0 + ab, s1 + bb) + e1
        label = int(s1 >= s0)  # ties are content
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return np.array(out[::-1])

    @staticmethod
    def fit(seqs: list[np.ndarray], labels: list[np.ndarray], weights: np.ndarray, steps: int = 150, penalty: float = 0.002) -> "Crf":
        """Gradient ascent (Adam) on the weighted mean conditional log likelihood of the lines' labels. Sequences go side by side, longest first, so that each step takes those that are still running."""
        order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
        lens = np.array([len(seqs[k]) for k in order])
        w = weights[order] / lens
        running = [int((lens > i).sum()) for i in range(int(lens[0]))]
        x = [np.stack([seqs[k][i] for k in order[:n]]) for i, n in enumerate(running)]
        gold = [np.stack([labels[k][i] for k in order[:n]]).astype(int) for i, n in enumerate(running)]
        flat = np.concatenate(x)
        cuts = np.cumsum([0, *running])
        held = np.concatenate([np.eye(2)[g] for g in gold])
        line_w = np.concatenate([w[:n] for n in running])
        pairs = [2 * gold[i - 1][: running[i]] + gold[i] for i in range(1, len(running))]
        gold_move = sum((np.bincount(p, w[: len(p)], 4) for p in pairs), np.zeros(4)).reshape(2, 2)
        theta = np.zeros(2 * D + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            emit, move, begin = theta[: 2 * D].reshape(2, D), theta[2 * D : 2 * D + 4].reshape(2, 2), theta[2 * D + 4 :]
            e = flat @ emit.T
            es = [e[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            alpha, beta = [begin + es[0]], [np.zeros((n, 2)) for n in running]
            for i in range(1, len(running)):
                last = alpha[-1][: running[i]]
                alpha.append(np.stack([np.logaddexp(last[:, 0] + move[0, k], last[:, 1] + move[1, k]) for k in (0, 1)], axis=1) + es[i])
            for i in range(len(running) - 2, -1, -1):
                ahead = es[i + 1] + beta[i + 1]
                beta[i][: running[i + 1]] = np.stack([np.logaddexp(ahead[:, 0] + move[k, 0], ahead[:, 1] + move[k, 1]) for k in (0, 1)], axis=1)
            z = np.logaddexp(alpha[0][:, 0] + beta[0][:, 0], alpha[0][:, 1] + beta[0][:, 1])
            p = np.exp(np.concatenate(alpha) + np.concatenate(beta) - np.concatenate([z[:n] for n in running])[:, None])
            diff = (held - p) * line_w[:, None]
            g_move = gold_move.copy()
            for i in range(1, len(running)):
                n = running[i]
                g_move -= (np.exp(alpha[i - 1][:n, :, None] + move + (es[i] + beta[i])[:, None, :] - z[:n, None, None]) * w[:n, None, None]).sum(axis=0)
            g = np.concatenate([(diff.T @ flat).ravel(), g_move.ravel(), diff[: running[0]].sum(axis=0)]) - penalty * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        return Crf(theta[: 2 * D].reshape(2, D), theta[2 * D : 2 * D + 4].reshape(2, 2), theta[2 * D + 4 :])


def line_labels(documents: list[tuple[int, np.ndarray]], common: int = COMMON) -> list[np.ndarray]:
    """Of documents (label, a number for each line): whether each line is content."""
    names, counts = np.unique(np.concatenate([np.unique(lines) for _, lines in documents]), return_counts=True)
    shared = names[counts >= common]
    return [np.full(len(lines), bool(y)) & ~np.isin(lines, shared) for y, lines in documents]


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Crf | None:
    """The field, from a bounded sample of labelled documents."""
    clean = clean_labels(labels, "quality")
    picks = [clean.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    pick = docs.sparkSession.createDataFrame(picks[0].unionByName(picks[1]).collect(), clean.schema)  # at most 2 * per_class ids
    chosen = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").dropDuplicates(["y", "text"])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = texts(batch.column("text"))
        lines = [np.fromiter((xxhash.xxh3_64_intdigest(x) & (1 << 63) - 1 for x in t.split("\n") if x.split()), np.int64) for t in found]
        return pa.RecordBatch.from_arrays([batch.column("y"), pa.array([np.array(line_vectors(t)[0]).tobytes() for t in found], pa.binary()), pa.array([x.tobytes() for x in lines], pa.binary())], ["y", "x", "lines"])

    found = sorted((r["y"], bytes(r["x"]), bytes(r["lines"])) for r in map_batches(chosen.select("y", "text"), fn, "y int, x binary, lines binary").where("length(x) > 0").collect())
    if len({r[0] for r in found}) < 2:
        return None
    y = np.array([r[0] for r in found])
    gold = line_labels([(r[0], np.frombuffer(r[2], np.int64)) for r in found])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())  # classes weigh alike, whatever their sizes
    seqs, labelled, share = [], [], []
    for (_, x, _), g, w in zip(found, gold, weight, strict=True):
        rows = np.frombuffer(x).reshape(-1, D)
        for a in range(0, len(rows), MOST_LINES):
            seqs.append(rows[a : a + MOST_LINES])
            labelled.append(g[a : a + MOST_LINES])
            share.append(w * len(seqs[-1]) / len(rows))
    return Crf.fit(seqs, labelled, np.array(share))


def judge(docs: DataFrame, crf: Crf | None, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share and kept of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for text in texts(batch.column("text")):
            words = words_of(text)
            counts = base_counts(text, words)
            failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEAT_PERCENT * counts[0]
            share = 1.0
            rows, sizes = line_vectors(text)
            if rows and crf is not None:
                share = float(np.dot(crf.viterbi(np.array(rows)), sizes) / sum(sizes))
            for column, value in zip(out, (*counts, failed, share, not failed and share >= least_share), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

    return map_batches(docs.select("doc_id", "text"), fn, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
