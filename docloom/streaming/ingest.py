"""Continuous ingestion (STR1-STR3, SNK16, SNK17, SRC12, UDF2): uploads landed in a folder, the folder as a stream, chunks upserted per micro-batch, progress in a log table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import log_level
from ..operators.store import VectorStore
from ..plans.ingest import load_store, to_chunks, to_texts
from ..schemas import BINARY_FILE, LOG

WAITING = "Menunggu pemrosesan dimulai..."


def safe_name(name: str) -> str:
    """SRC12: the last part of an uploaded name, without anything that could leave the folder."""
    base = re.sub(r"[^\w.\- ]", "_", name.replace("\\", "/").rsplit("/", 1)[-1]).lstrip(".")
    if not base:
        raise ValueError("no file name")
    return base


def uploads(spark: SparkSession, folder: str, pattern: str = "*.pdf", most_files: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most_files).load(folder)


def land(spark: SparkSession, folder: str, name: str, content: bytes) -> str:
    """SNK16, SRC12: an upload, written beside the folder's files under a hidden name and then moved into place, so that a stream never sees half of it. Returns its path; an older file of that name is replaced."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    fs.mkdirs(path(folder))
    final, hidden = path(folder, safe_name(name)), path(folder, f".{safe_name(name)}.{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    out.write(content)
    out.close()
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(hidden, final):
        raise OSError(f"can't write {final}")
    return final.toString()


def progress(texts: DataFrame, chunks: DataFrame, stored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """STR2, UDF2: (filename, step, level, message), the lines that tell what became of each file: begun, its pages, characters read (a warning if none), chunks, then the outcome.

    texts as of `to_texts`; stored: (source_file, failure), one row for each file that had chunks.
    """
    per = chunks.groupBy("source_file").agg(F.count("*").alias("n"))
    x = texts.join(per, "source_file", "left").join(stored.select("source_file", "failure"), "source_file", "left")
    n, read = F.coalesce("n", F.lit(0)), F.coalesce(F.length("text"), F.lit(0))
    text, ok = (lambda *c: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in c))), F.col("error").isNull()
    page = F.transform(F.coalesce("pages", F.array()), lambda p: F.concat(
        F.lit("Halaman "), p.page_num.cast("string"), F.lit(": "), p.page_type, F.lit(" (PSM "), p.psm_used.cast("string"), F.lit("), "),
        p.char_count.cast("string"), F.lit(" karakter"),
    ))
    lines = F.concat(
        F.array(text("Memulai pemrosesan dokumen: ", F.col("source_file"))),
        page,
        F.when(ok, F.array(text("Ekstraksi selesai: ", read, " karakter."))).otherwise(F.array()),
        F.when(ok & (read == 0), F.array(F.lit("Peringatan: tidak ada teks yang terbaca."))).otherwise(F.array()),
        F.when(ok, F.array(text(f"Pemecahan teks (chunk_size {settings.chunk_size}, overlap {settings.chunk_overlap}): ", n, " chunk."))).otherwise(F.array()),
        F.array(F.when(~ok, text("CRITICAL ERROR: ", F.col("error"))).when(n == 0, text("ERROR: tidak ada chunk yang valid.")).when(
            F.col("failure").isNotNull(), text("CRITICAL ERROR: ", F.col("failure")),
        ).otherwise(text("SUCCESS: ", F.col("source_file"), " siap dicari."))),
    )
    return x.select(
        F.col("source_file").alias("filename"), F.posexplode(lines).alias("step", "message"),
    ).withColumn("level", log_level(F.col("message"))).select("filename", "step", "level", "message")


def _store_files(spark: SparkSession, store: VectorStore, chunks: DataFrame, make_embedder: Callable, work: str) -> DataFrame:
    """(source_file, failure): all files of a batch at once, or one by one if that fails, so that one file's failure leaves the others alone (ING10)."""
    names = [r.source_file for r in chunks.select("source_file").distinct().collect()]  # of one micro-batch
    failed = {}
    try:
        if names:
            load_store(store, chunks, make_embedder, work)
    except Exception:
        for i, name in enumerate(names):
            try:
                load_store(store, chunks.where(F.col("source_file") == name), make_embedder, f"{work}-{i}")
            except Exception as e:
                failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return spark.createDataFrame([(n, failed.get(n)) for n in names], "source_file string, failure string")


def ingest(
    spark: SparkSession, folder: str, store: VectorStore, make_decoder: Callable, make_embedder: Callable, work: str,
    settings: Settings = Settings(), most_files: int = 1000,
):
    """Process what is new in the folder, then stop; run again, it adds nothing that was there. Files replace what the store holds of them. `most_files` are one micro-batch."""

    def batch(files: DataFrame, number: int) -> None:
        texts = to_texts(files, make_decoder, settings)
        texts.write.mode("overwrite").parquet(f"{work}/texts-{number}")
        texts = spark.read.parquet(f"{work}/texts-{number}")
        to_chunks(texts, settings).write.mode("overwrite").parquet(f"{work}/chunks-{number}")
        chunks = spark.read.parquet(f"{work}/chunks-{number}")
        stored = _store_files(spark, store, chunks, make_embedder, f"{work}/vectors-{number}")
        lines = progress(texts, chunks, stored, settings)
        log = lines.select(
            "filename", F.lit(number).cast("bigint").alias("seq"),
            (F.current_timestamp() + F.expr("make_dt_interval(0, 0, 0, step / 1000000)")).alias("ts"), "level", "message",
        )
        log.write.mode("overwrite").parquet(f"{work}/log/batch={number}")

    return uploads(spark, folder, most_files=most_files).writeStream.foreachBatch(batch).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()


def log_of(log: DataFrame, filename: str) -> DataFrame:
    """SNK17: the lines of one file's latest upload in order; a waiting line if there is none."""
    spark = log.sparkSession
    own = log.where(F.col("filename") == filename)
    last = own.agg(F.max("seq").alias("seq"))
    rows = own.join(F.broadcast(last), "seq").select("ts", "message").orderBy("ts")
    return rows if not rows.isEmpty() else spark.createDataFrame([(None, WAITING)], "ts timestamp, message string")


def read_log(spark: SparkSession, work: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{work}/log/*")


def live_messages(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """STR3: chat messages as they are appended to a parquet folder."""
    return spark.readStream.schema(schema).parquet(folder)
