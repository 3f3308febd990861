"""Ingestion from files to the store (ING9, SNK4-SNK8, AGG8, AGG9, AGG16) and its sinks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import cleaning
from ..operators.chunking import chunk_documents, valid_chunks
from ..operators.pages import extracted
from ..operators.store import VectorStore, embedding_sample
from ..sources.providers import embedded


def to_texts(files: DataFrame, make_decoder: Callable, settings: Settings = Settings(), clean: bool = False) -> DataFrame:
    """source_file, document_id, text, page_count, pages, error; cleaning is off unless asked for."""
    out = extracted(files, make_decoder, settings)
    name = F.element_at(F.split("path", "/"), -1)
    text = cleaning.clean(F.col("text")) if clean else F.col("text")
    return out.select(
        name.alias("source_file"), F.sha2(name, 256).alias("document_id"), F.when(F.col("error").isNull(), text).alias("text"),
        "page_count", "pages", "error",
    )


def to_chunks(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return valid_chunks(chunk_documents(texts.where("error IS NULL"), size=settings.chunk_size, overlap=settings.chunk_overlap, separators=settings.separators))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """AGG9 per file: chunks and their average size, half to even."""
    return chunks.groupBy("source_file").agg(F.count("*").alias("chunk_count"), F.bround(F.avg("char_count"), 0).alias("avg_chunk_size"))


def summary(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """SNK6 per document: file, pages, characters, chunks, average chunk size (AGG9, half to even), error."""
    joined = texts.join(chunk_sizes(chunks), "source_file", "left")
    return joined.select(
        "source_file", "document_id", "page_count", F.coalesce(F.length("text"), F.lit(0)).alias("raw_chars"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("avg_chunk_size", F.lit(0.0)).alias("avg_chunk_size"), "pages",
        "error",
    )


def rollup(documents: DataFrame) -> DataFrame:
    """AGG8."""
    return documents.agg(
        F.count("*").alias("total_documents"), F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"),
    )


def write_markdown(texts: DataFrame, folder: str) -> None:
    """SNK4: one text folder per document."""
    texts.where("error IS NULL").select(
        "source_file", F.concat(F.lit("# "), "source_file", F.lit("\n\n"), "text").alias("value"),
    ).write.mode("overwrite").partitionBy("source_file").text(folder)


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """SNK5: JSON lines, a folder per document."""
    chunks.withColumn("file", F.col("source_file")).write.mode("overwrite").partitionBy("file").json(folder)


def write_summary(documents: DataFrame, folder: str) -> None:
    """SNK6: the totals, with the load's time if it is known, and the documents."""
    totals = rollup(documents)
    if "elapsed_seconds" in documents.columns:
        totals = totals.crossJoin(documents.agg(F.max("elapsed_seconds").alias("elapsed_seconds")))  # one row each
    totals.write.mode("overwrite").json(f"{folder}/totals")
    documents.write.mode("overwrite").json(f"{folder}/documents")


def export(rows: DataFrame, folder: str) -> None:
    """SNK7: chunk_id, source_file, content, ends of the vector and its dimension."""
    rows.select(
        "chunk_id", "source_file", "content", embedding_sample(F.col("embedding")).alias("embedding_sample"),
        F.size("embedding").alias("vector_dimension"),
    ).write.mode("overwrite").json(folder)


def sample_markdown(rows: DataFrame, n: int = 5) -> str:
    """SNK8: the first n records, for people."""
    return "\n".join(f"## {i}. {r.source_file} / {r.chunk_index}\n\n{r.content}\n" for i, r in enumerate(rows.orderBy("source_file", "chunk_index").limit(n).collect(), 1))


def load_store(store: VectorStore, chunks: DataFrame, make_embedder: Callable, work: str) -> None:
    """Embed, write once (a model isn't called again by a retried reader), upsert; a store that stays empty is an error."""
    spark: SparkSession = chunks.sparkSession
    embedded(chunks, make_embedder).write.mode("overwrite").parquet(work)
    store.upsert(spark.read.parquet(work))
    if store.read().isEmpty():
        raise RuntimeError("the store is empty")


def rebuild(store: VectorStore, files: DataFrame, make_decoder: Callable, make_embedder: Callable, work: str, settings: Settings = Settings()) -> DataFrame:
    """The bulk load: clear, extract, chunk, embed, upsert; returns the documents' summary. AGG16: `elapsed_seconds` is the whole load's time, `chunk_count` what each file added."""
    began = time.monotonic()
    store.clear()
    texts = to_texts(files, make_decoder, settings)
    texts.write.mode("overwrite").parquet(f"{work}/texts")
    texts = files.sparkSession.read.parquet(f"{work}/texts")
    chunks = to_chunks(texts, settings)
    load_store(store, chunks, make_embedder, f"{work}/vectors")
    return summary(texts, chunks).withColumn("elapsed_seconds", F.lit(round(time.monotonic() - began, 3)))
