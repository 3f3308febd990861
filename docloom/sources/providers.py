"""Models behind plain protocols (SRC8, SRC9, EMB1-EMB4, SRC4, ING6): they are built inside the executor, and offline ones are deterministic."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, u_words

CAP = 100


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str], task: str) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompt: str, temperature: float, max_tokens: int) -> str: ...


class PageDecoder(Protocol):
    def pages(self, content: bytes, dpi: int) -> list[bytes]: ...

    def ruled_share(self, image: bytes) -> float: ...

    def text(self, image: bytes, language: str, psm: int) -> str: ...


class HashEmbedder:
    """EMB4: words counted in hash buckets, unit length; the same numbers as `hash_embedding`."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str], task: str = "") -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dimension] += 1
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


def hash_embedding(text: Column, dimension: int = 64) -> Column:
    """EMB4 as an expression: array<double>, a zero vector for a text without words. Words are hashed once, and counts and norm computed once."""
    words = u_words(F.lower(F.coalesce(text, F.lit(""))))
    buckets = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % dimension).cast("int"))
    counts = lambda b: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double"))
    unit = lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(c, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))
    return let(buckets, lambda b: let(counts(b), unit))


class ExtractiveGenerator:
    """An offline stand-in for a language model: the first context of the prompt, as it is."""

    def generate(self, prompt: str, temperature: float = 0.2, max_tokens: int = 4096) -> str:
        _, _, rest = prompt.partition("[Dokumen 1]\n")
        return rest.split("\n\n", 1)[0][: 4 * max_tokens]


def attempt(call: Callable, tries: int = 3, wait: float = 2.0, sleep: Callable = time.sleep):
    """EMB2: call again after `wait` and twice that; the last failure is raised as it was."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i == tries - 1:
                raise
            sleep(wait * (i + 1))


def embed_all(embedder: Embedder, texts: list[str], task: str = "RETRIEVAL_DOCUMENT", batch: int = CAP, sleep: Callable = time.sleep) -> list[list[float]]:
    """EMB1: in order, in batches of at most 100; a wrong number of answers is an error."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    out: list = []
    for i in range(0, len(texts), min(batch, CAP)):
        part = texts[i : i + min(batch, CAP)]
        got = attempt(lambda part=part: embedder.embed(part, task), sleep=sleep)
        if len(got) != len(part):
            raise ValueError(f"{len(got)} vectors for {len(part)} texts")
        out += got
    return out


def embed_query(embedder: Embedder, query: str) -> list[float]:
    """EMB3, FLT2: a blank query is an error."""
    if not query.strip():
        raise ValueError("the query is blank")
    return embedder.embed([query], "RETRIEVAL_QUERY")[0]


def embedded(chunks: DataFrame, make: Callable[[], Embedder], batch: int = CAP) -> DataFrame:
    """chunks with an embedding column beside each row (JN8: never zipped). Write the result before it is used twice: the model may not be deterministic."""
    at = chunks.columns.index("content")

    def run(batches):
        model = make()
        for b in batches:
            if b.num_rows:
                v = embed_all(model, [t or "" for t in b.column(at).to_pylist()], batch=batch)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))]))
