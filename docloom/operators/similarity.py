"""Cosine search (JN1, JN2, WIN3): exact, in two stages.

Each batch of the store is multiplied with a block of query vectors and gives its best k a query; only those rows, without contents, are
shuffled and ranked. Queries are taken in blocks of bounded bytes, and a block meets a batch in slices of both, so what the driver and a task hold doesn't grow
with the number of queries or rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cosine(a, b):
    """Cosine similarity of two array columns as an expression; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)


def _nearest(q: np.ndarray, vectors: pa.ListArray, place: np.ndarray, k: int, some: int = 256, cells: int = 1 << 18):
    """(query, row, distance) of the k rows of `vectors` nearest to each query, ties by `place`. Zero vectors are left out.

    `some` queries meet a slice of rows (k at least) at a time, of at most `cells` distances and numbers, and keep one number for each row found:
    beside the places, what is held depends neither on the number of rows nor, but for single rows, on how long vectors are.
    """
    none, row_of = np.iinfo(np.int64).max, np.argsort(place)
    step = max(k, cells // max(some, q.shape[1]))
    for i in range(0, len(q), some):
        best = np.empty((len(q[i : i + some]), 0), np.int64)
        for j in range(0, len(vectors), step):
            part = vectors.slice(j, step)
            d = q[i : i + some] @ _unit(np.asarray(part.flatten(), float).reshape(len(part), -1)).T
            d = np.rint(np.multiply(np.subtract(1, d, out=d), 1e6, out=d), out=d)
            gone = np.isnan(d)
            d[gone] = 0
            order = (d.astype(np.int64) << 32) + place[j : j + step]
            order[gone] = none
            best = np.concatenate([best, order], axis=1)
            if best.shape[1] > k:
                best = np.partition(best, k - 1, axis=1)[:, :k]
        ok = best != none
        found = best[ok]
        yield np.nonzero(ok)[0] + i, row_of[found & 0xFFFFFFFF], (found >> 32) / 1e6


def knn(
    spark: SparkSession, store: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding",
    query_key: str = "query_id", block_bytes: int = 1 << 25,
) -> DataFrame:
    """(query_key, key, distance, score, rank): the k rows of the store nearest to each query, distance and score rounded to 6 digits, ties by key.

    Null and zero vectors are never found. The store may be smaller than k. `block_bytes` of query vectors (65,536 of 64 numbers) are sent to the tasks for one scan of the store.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ids = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("v")).where("v IS NOT NULL").orderBy("q")
    kind, qkind = dict(store.dtypes)[key], dict(queries.dtypes)[query_key]
    to_q = to_arrow_type(queries.schema[query_key].dataType)
    schema = f"q {qkind}, key {kind}, distance double"

    def nearest(part) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r.q for r in part], _unit(np.array([r.v for r in part], float))))

        def run(batches):
            names, q = shared.value
            names = pa.array(names, to_q)
            for b in batches:
                if b.column(1).null_count:
                    b = b.filter(pa.compute.is_valid(b.column(1)))
                if not b.num_rows:
                    continue
                keys = b.column(0)
                place = np.empty(b.num_rows, np.int64)
                place[np.array(pa.compute.sort_indices(keys))] = np.arange(b.num_rows)
                for at, row, d in _nearest(q, b.column(1), place, k):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), keys.take(pa.array(row)), pa.array(d)], names=["q", "key", "distance"])

        return store.select(key, vector).mapInArrow(run, schema)

    out, part, held = None, [], 0
    for row in ids.toLocalIterator():
        part.append(row)
        held += 8 * len(row.v)
        if held >= block_bytes:
            out = nearest(part) if out is None else out.union(nearest(part))
            part, held = [], 0
    if part or out is None:
        last = nearest(part) if part else spark.createDataFrame([], schema)
        out = last if out is None else out.union(last)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "key"))
    ranked = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("key").alias(key), "distance", F.round(1 - F.col("distance"), 6).alias("score"), "rank")


def retrieve(
    spark: SparkSession, store: DataFrame, queries: DataFrame, top_k: int = 5, min_score: float = 0.6, key: str = "chunk_id",
    content: str = "content",
) -> DataFrame:
    """The whole retrieval: over-fetch (TOP1), contents joined to the candidates only, rescoring (PRJ5), threshold (FLT1), top k (TOP2).

    queries: query_id, query, embedding. Returns query_id, key, content, distance, score, rank.
    """
    from .rerank import rescored

    found = knn(spark, store, queries, max(2 * top_k, 25), key)
    with_text = found.join(store.select(key, content), key).join(queries.select("query_id", "query"), "query_id")
    scored = with_text.withColumn("score", rescored(F.col("query"), F.col(content), F.col("score"))).where(F.col("score") >= min_score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", key, content, "distance", "score", "rank")
