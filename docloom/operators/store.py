"""A keyed vector table in versioned folders (SNK1-SNK3, SRC6, AGG4, AGG5): each change writes a new version, then moves a pointer.

All file work goes through Spark and Hadoop's file system, so any path that Spark reads will do. Readers keep the version they began with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import VECTOR

META = {"source_file": "", "document_id": "", "chunk_index": 0, "char_count": 0}


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, collection: str = "academic_docs"):
        self.spark, self.path, self.collection = spark, f"{path.rstrip('/')}/{collection}", collection

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[str]:
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(done)

    def read(self) -> DataFrame:
        """The newest whole version; an empty table if there is none."""
        have = self._versions()
        return self.spark.read.schema(VECTOR).parquet(f"{self.path}/{have[-1]}") if have else self.spark.createDataFrame([], VECTOR)

    def _write(self, df: DataFrame) -> None:
        have = self._versions()
        n = int(have[-1][1:9]) + 1 if have else 1
        df.select([F.col(c).cast(t) for c, t in self.spark.createDataFrame([], VECTOR).dtypes]).write.parquet(f"{self.path}/v{n:08d}-{uuid.uuid4().hex[:8]}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest versions."""
        for name in self._versions()[:-keep]:
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)

    def upsert(self, rows: DataFrame, replace: str | None = "source_file") -> None:
        """Rows win over stored ones with the same chunk_id, and (by default) over all stored rows of the same file. No rows: nothing happens."""
        if rows.where("embedding IS NULL").limit(1).count():
            raise ValueError("a chunk has no embedding")
        if rows.isEmpty():
            return
        self._write(upserted(self.read(), rows, replace))

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], VECTOR))

    def delete_by_document(self, document_id: str) -> None:
        self._write(deleted(self.read(), document_id))

    def stats(self) -> DataFrame:
        return counted(self.read()).select("total_chunks", F.lit(self.collection).alias("collection_name"), F.lit(self.path).alias("persist_directory"))


def counted(rows: DataFrame) -> DataFrame:
    """AGG4."""
    return rows.agg(F.count("*").alias("total_chunks"))


def upserted(old: DataFrame, new: DataFrame, replace: str | None = None) -> DataFrame:
    """SNK1, SET4: (old without the keys of new) and new; missing metadata gets its defaults; of repeated new keys one row wins."""
    new = new.fillna({k: v for k, v in META.items() if k in new.columns}).dropDuplicates(["chunk_id"])
    kept = old.join(new.select("chunk_id"), "chunk_id", "left_anti")
    if replace:
        kept = kept.join(new.select(replace).distinct(), replace, "left_anti")
    return kept.select(new.columns).unionByName(new)


def deleted(rows: DataFrame, document_id) -> DataFrame:
    """SNK3: rows of other documents; a null document_id never matches."""
    return rows.where(~F.col("document_id").eqNullSafe(F.lit(document_id)))


def documents_of(rows: DataFrame) -> DataFrame:
    """AGG5: each document and the file of its first chunk; rows without a document are skipped."""
    return rows.where("document_id IS NOT NULL AND document_id <> ''").groupBy("document_id").agg(F.min_by("source_file", "chunk_index").alias("source_file"))


def embedding_sample(vector):
    """PRJ9: the first and last five numbers around a marker, as text."""
    text = lambda a: F.transform(a, lambda x: F.format_string("%.6f", x.cast("double")))
    return F.concat(text(F.slice(vector, 1, 5)), F.array(F.lit("...")), text(F.slice(vector, -5, 5)))
