"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are its letter 1- to 4-grams (lower-cased, word by word with word ends marked), hashed into BUCKETS
rows of an embedding table. The mean of their rows goes through a linear softmax. Both layers are
trained together by stochastic gradient descent in numpy. The softmax's temperature is then fitted on a part of the sample that training
did not see, and so is the score under which a prediction is rejected: the `reject` quantile of right predictions there.

As the model is linear after the mean, embedding and output layer fold into one table (bucket, language) for prediction:
one gather and one sum a text, over the whole text in pieces of bounded size.

Every lang value is learned. The fit uses a bounded sample: for each language about `per_lang` labelled rows (200), or its even share of `max_rows` (4,000) if
that is more, chosen by a 63-bit hash of doc_id and text, which leaves no language without rows however many there are; so sample and model grow with the number of languages, not of rows.
Defined cases: very long texts are read whole, in pieces of PIECE characters; null texts and texts without a letter are `und` with score 0; null langs are not learned from; with no labelled row
everything is `und`; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, crc_mod, mix

BUCKETS = 1 << 15
PIECE = 1 << 18  # characters hashed at a time
_letter = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _letter[97]:
        _letter[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def code_points(t: str) -> np.ndarray:
    return np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def grams(cp: np.ndarray) -> np.ndarray:
    """The bucket of each 1- to 4-gram inside a word; white space and other marks become one word end."""
    inside = _letters()[cp]
    c = np.where(inside, cp, 32).astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    word = c != 32
    out = []
    for n in (1, 2, 3, 4):
        if len(c) < n:
            break
        m = len(c) - n + 1
        h = np.full(m, n, np.uint64)
        ok = np.ones(m, bool)
        for k in range(n):
            with np.errstate(over="ignore"):
                h = (h + c[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            if 0 < k < n - 1:
                ok &= word[k : k + m]  # word ends only at a gram's ends
        ok &= word[: m] | word[n - 1 :] if n > 1 else word[:m]
        out.append((mix(h[ok]) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def pieces(t: str):
    """Code points of a whole text in pieces that end at white space where they can."""
    cp = code_points(t)
    at = 0
    while at < len(cp):
        end = min(len(cp), at + PIECE)
        if end < len(cp):
            gap = np.flatnonzero(cp[at:end] <= 32)
            end = at + int(gap[-1]) + 1 if len(gap) else end
        yield cp[at:end]
        at = end


def bag(t: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a whole text."""
    total = np.zeros(BUCKETS, np.int64)
    for cp in pieces(t):
        total += np.bincount(grams(cp), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


class LanguageModel:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, floor: float = 0.0):
        self.langs, self.table, self.bias, self.temperature, self.floor = langs, table, bias, temperature, floor
        self.layers: tuple = ()  # embedding and output layer, as trained

    @classmethod
    def fit(
        cls, bags: list, y: np.ndarray, langs: list[str], dim: int = 16, epochs: int = 4, rate: float = 0.5, reject: float = 0.01,
        seed: int = 3,
    ) -> LanguageModel:
        rng = np.random.default_rng(seed)
        n = len(langs)
        e = (rng.random((BUCKETS, dim)) - 0.5) / dim
        w, b = np.zeros((dim, n)), np.zeros(n)
        order = rng.permutation(len(bags))
        held, train = order[: len(order) // 5], order[len(order) // 5 :]
        steps, done = max(1, epochs * len(train)), 0
        for _ in range(epochs):
            for i in rng.permutation(train):
                lr = rate * (1 - done / steps)
                done += 1
                at, c = bags[i]
                if not len(at):
                    continue
                share = c / c.sum()
                h = share @ e[at]
                z = h @ w + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                dh = w @ p
                w -= lr * np.outer(h, p) * 4
                b -= lr * 0.1 * p
                e[at] -= lr * 40 * share[:, None] * dh
        model = cls(langs, e @ w, b)
        model.layers = e, w
        held = np.array([i for i in (held if len(held) else train) if len(bags[i][0])], int)
        if len(held):
            z = np.stack([model.logits(*bags[i]) for i in held])
            grid = np.geomspace(0.05, 20, 60)
            model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()))
            p = _softmax(z / model.temperature)
            right = p.max(1)[p.argmax(1) == y[held]]
            model.floor = float(np.quantile(right, reject)) if len(right) else 0.0
        return model

    def logits(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (c / c.sum()) @ self.table[at] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each whole text."""
        out = []
        for t in texts:
            total, n = np.zeros(len(self.langs)), 0
            if self.langs:
                for cp in pieces(t or ""):
                    g = grams(cp)
                    n += len(g)
                    total += self.table[g].sum(0)
            if not n:
                out.append(("und", 0.0, True))
                continue
            p = _softmax(((total / n + self.bias) / self.temperature)[None])[0]
            k = int(p.argmax())
            out.append((self.langs[k], float(p[k]), bool(p[k] < self.floor)))
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(spark: SparkSession, docs: DataFrame, max_rows: int = 4_000, where=None, per_lang: int = 200) -> LanguageModel:
    """Learn from rows with a lang that satisfy `where`; max_rows, or per_lang rows a language if more, bound what reaches the driver (bags of at most BUCKETS counts)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    own = own.where(where) if where is not None else own
    n = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(per_lang, max_rows // max(1, len(n)))
    most = max(max_rows, each * len(n))
    upto = spark.createDataFrame([(lang, min((1 << 63) - 1, int(each / k * (1 << 63)))) for lang, k in n.items()], "lang string, upto long")

    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                got = [bag(t) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(1), pa.array([g[0].astype("<u2").tobytes() for g in got]), pa.array([g[1].astype("<u4").tobytes() for g in got])],
                    names=["lang", "at", "c"],
                )

    kept = own.join(F.broadcast(upto), "lang").where(F.expr("shiftrightunsigned(xxhash64(doc_id, text), 1) <= upto"))  # a row a language
    rows = kept.select("text", "lang").limit(most + most // 4).mapInArrow(run, "lang string, at binary, c binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.at, r.c))
    langs = sorted({r.lang for r in rows})
    bags = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["c"], "<u4").astype(float)) for r in rows]
    return LanguageModel.fit(bags, np.array([langs.index(r.lang) for r in rows], int), langs)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row, in one pass without a shuffle."""

    model.layers = ()  # prediction needs the folded table only

    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                got = list(zip(*model.predict(b.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in got)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = fit(spark, docs, where=crc_mod("doc_id", 3) != 1)
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
