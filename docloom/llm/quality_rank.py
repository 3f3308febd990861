"""Quality by Bradley-Terry pairwise ranking.

Documents labelled 1 are preferred to documents labelled 0. The ranker learns weights w so that
P(a preferred to b) = sigmoid(w . (f(a) - f(b))) by logistic loss on the feature differences of such pairs;
a document's rank score is w . f(d). A logistic fit of one slope and one offset maps it to (0, 1).

The fit uses a bounded sample: at most `max_labels` labelled rows (20,000), chosen by a hash of doc_id, the
classes alike. Features (FEATURES) are shares and rates of the whole text, so texts of any length compare.

Defined cases: very long texts are read whole; null and empty texts have the features of an empty text and get a score; labels other than 0 and 1, null labels and
labels of unknown documents are ignored; several labels of one document count each; with no pair to learn
from every score is 0.5; columns besides doc_id and text aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, crc_mod

FEATURES = (
    "log_words", "symbol", "upper", "bang", "pipe", "digit", "word_len", "distinct", "bigram_repeat", "run", "line_repeat", "symbol_words",
    "upper_words", "short", "punct", "empty",
)
SYMBOLS = b"#*$%&|<>"


def features(t: bytes) -> list[float]:
    """The numbers of FEATURES for one text in UTF-8."""
    words = t.split()
    n = len(words)
    if not n:
        return [0.0] * 15 + [1.0]
    size = sum(map(len, words))
    count = lambda chars: len(t) - len(t.translate(None, chars))
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in t.split(b"\n") if x.strip()]
    upper = sum(map(bytes.isupper, words))
    return [
        np.log1p(n), count(SYMBOLS) / size, count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, count(b"!") / size, count(b"|") / size, count(b"0123456789") / size,
        np.log1p(size / n), len(set(words)) / n, 1 - len(pairs) / max(1, n - 1), sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), sum(w[-1] in SYMBOLS for w in words) / n, upper / n, float(n < 20), count(b".,;:") / size, 0.0,
    ]


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 200_000, l2: float = 1e-3, steps: int = 25, seed: int = 5) -> np.ndarray:
    """Bradley-Terry weights by Newton steps on random preference pairs; the fixed number of pairs bounds time and memory."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w
    n = min(pairs, 8 * len(good) * len(bad))
    d = x[rng.choice(good, n)] - x[rng.choice(bad, n)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / n + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_scale(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the map from rank score to probability."""
    if len(set(y.tolist())) < 2:
        return 0.0, 0.0
    a = np.array([1.0, 0.0])
    z = np.stack([s, np.ones_like(s)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        a -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - y) + 1e-3 * a)
    return max(0.0, float(a[0])), float(a[1])


class Ranker:
    """Weights for standardised features, and the map to (0, 1)."""

    def __init__(self, mean, scale, w, slope, offset):
        self.mean, self.scale, self.w, self.slope, self.offset = mean, scale, w, slope, offset

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Ranker:
        if not len(x):
            return cls(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0, 0.0)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        w = fit_pairs((x - mean) / scale, y)
        return cls(mean, scale, w, *fit_scale((x - mean) / scale @ w, y))

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.rank(x) + self.offset, -30, 30)))


def _featured(docs: DataFrame, label: bool) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                f = np.array([features(t or b"") for t in b.column(0).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[b.column(1)] * label, pa.array(list(f), pa.list_(pa.float64()))], names=["label"] * label + ["f"])

    return docs.mapInArrow(run, "label int, f array<double>" if label else "f array<double>")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, where=None) -> Ranker:
    """Learn from labels (doc_id, quality) that satisfy `where`; the rows read for it and sent to the driver are max_labels and a quarter at most,
    chosen by a hash of doc_id, whatever the table's size."""
    own = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"),
    ).where("doc_id IS NOT NULL AND label IN (0, 1)")
    own = own.where(where) if where is not None else own
    n = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    each = max_labels // 2
    rest = {k: min(v, each) for k, v in n.items()}
    room = max_labels - sum(rest.values())
    keep = F.lit(False)
    for k, v in n.items():
        share = min(1.0, (rest[k] + max(0, room)) / v)
        keep = keep | ((F.col("label") == k) & (F.expr("shiftrightunsigned(xxhash64(doc_id), 1)") <= min((1 << 63) - 1, int(share * (1 << 63)))))
    chosen = own.where(keep).limit(max_labels + max_labels // 4)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    got = _featured(joined, True).limit(max_labels + max_labels // 4).toPandas()
    return Ranker.fit(np.array(got.f.tolist(), float).reshape(len(got), len(FEATURES)), got.label.to_numpy(float))


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """doc_id, rank (Bradley-Terry) and score in (0, 1) of every row of docs, in one pass without a shuffle."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                x = np.array([features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.rank(x)), pa.array(model.score(x))], names=["doc_id", "rank", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, rank double, score double")


def quantile_threshold(scored: DataFrame, share: float, error: float = 1e-3) -> float:
    """The score below which `share` of all rows lie: a distributed quantile sketch over every row."""
    q = scored.approxQuantile("score", [share], error)
    return q[0] if q else 0.0


def filter_documents(spark: SparkSession, docs: DataFrame, model: Ranker, threshold: float) -> DataFrame:
    """The rows of docs that score at least `threshold`, all columns as they were."""
    @F.arrow_udf("double")
    def judged(t: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([features(x or b"") for x in t.cast(pa.binary()).to_pylist()]).reshape(len(t), len(FEATURES))))

    return docs.where(judged(F.col("text")) >= threshold)


def op5(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(spark, docs, labels, where=crc_mod("doc_id", 5) != 0)
    return score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "rank",
    )
