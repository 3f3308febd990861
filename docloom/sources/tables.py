"""Readers: parquet tables (SRC13), binary document folders (SRC2, SRC3), chunk files (SRC5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CHUNK


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents_in(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """SRC2: path, modificationTime, length, content of each file; not recursive, case-sensitive; the content is only read if a plan uses it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def document_names(files: DataFrame) -> DataFrame:
    """TOP6: (path, length) of files in order of their path; contents aren't read."""
    return files.select("path", "length").orderBy("path")


def one_document(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: one file, which must exist and end in .pdf in any case."""
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    return spark.read.format("binaryFile").load(path)


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC5: all chunks_*.json files, each an array of chunks or JSON lines; empty files give nothing, no file at all is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/chunks_*")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        raise FileNotFoundError(f"no chunks_* in {folder}")
    return spark.read.schema(CHUNK).option("multiLine", True).json(f"{folder}/chunks_*").where("chunk_id IS NOT NULL")
