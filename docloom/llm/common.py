"""Helpers shared by the corpus operators: shared scratch tables, splits, batches, filters."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and U+0009 to U+000D.
SPACE = b" \t\n\v\f\r"
U64 = np.uint64


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in local mode, where driver and executors are one machine, may it be unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_scopes: list[list[str]] = []
_marked: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, which is deleted when the driver ends (or by `temporary`)."""
    top = f"{shared_root(spark)}/docloom-{spark.sparkContext.applicationId}"
    if top not in _marked:
        system, path = _hadoop(spark, top)
        system.deleteOnExit(path)
        _marked.add(top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    """The file system and the path, as the JVM knows them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Deletes at the end all that was made inside below `scratch` paths; write what should stay to a path from before."""
    _scopes.append(made := [])
    try:
        yield
    finally:
        _scopes.remove(made)
        for x in made:
            system, path = _hadoop(spark, x)
            system.delete(path, True)


#: Spark removes the shuffle files of an execution when it ends, if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _set(spark: SparkSession, **conf: str):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(spark: SparkSession, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back. `batch` is the most rows in an Arrow batch, where rows are large."""
    return write_table(spark, df, scratch(spark, name), batch)


def write_table(spark: SparkSession, df: DataFrame, path: str, batch: int | None = None) -> DataFrame:
    rows = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)} if batch else {}
    with _set(spark, **{CLEANUP: "true"}, **rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        system, path = _hadoop(spark, os.path.dirname(f))
        system.delete(path, True)


def finished(spark: SparkSession, *tables: DataFrame) -> None:
    """Free the disk of tables that nothing reads any more."""
    for t in tables:
        drop_table(spark, t)


#: Stands for a null doc_id where rows are told apart.
NO_ID = -0x7FFFFFFFFFFFFFF3


def identified(docs: DataFrame) -> DataFrame:
    """doc_id (long), text, and what tells rows apart: `row`, a hash of both, and `who`, the doc_id or NO_ID. Two rows agree in row and who only if they
    share a doc_id and a 64-bit hash, so rows of distinct doc_ids are never taken for one another."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("who"))


def packed_rows(docs: DataFrame) -> DataFrame:
    """All columns of docs as one struct `d` beside `row` and `who` (see `identified`): no name of a user's column can clash."""
    who = F.col("doc_id").cast("long")
    return docs.select(
        F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("d"), F.xxhash64(who, "text").alias("row"),
        F.coalesce(who, F.lit(NO_ID)).alias("who"),
    )


def rows_in(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs whose (row, who) is in stay, repeated rows once, all columns as they were."""
    once = packed_rows(docs).join(stay.select("row", "who").distinct(), ["row", "who"]).dropDuplicates(["row", "who"])
    return once.select("d.*")


def open_out(uri: str):
    """A file in a shared folder, for executors: local paths and any store that pyarrow.fs knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))
    return system, path


def put_file(uri: str, *parts) -> None:
    """Write a file whole under a private name, then move it into place: a repeated or lost task leaves no half file."""
    system, path = open_out(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(tmp) as out:
        for p in parts:
            out.write(p)
    system.move(tmp, path)


def get_file(uri: str) -> pa.Buffer:
    system, path = open_out(uri)
    with system.open_input_file(path) as f:
        return f.read_buffer()


def crc_mod(col: str, n: int):
    """crc32 of a column's text form modulo n; null where the column is null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b or b"" for b in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def lean(run):
    """run, giving back at the end of a partition what the Arrow pool holds for reuse."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def id_filter(spark: SparkSession, df: DataFrame, ids: DataFrame, key: str, most: int = 1 << 26) -> DataFrame:
    """Drop rows of df whose key surely isn't in ids, before a join shuffles them; all inside the JVM.

    About 16 bits per id, `most` bits (8 MB) at most, in bitmaps of 32,768 bits, which are broadcast: their size is bounded
    whatever the input. A full filter only prunes less, the join after it stays exact. df mustn't have columns __slot, __map and __bucket.
    """
    bits = min(most, 1 << max(12, (16 * rows_of(spark, ids)).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(bits)) + 1
    maps = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__map"))
    held = df.withColumn("__slot", slot).withColumn("__bucket", F.bitmap_bucket_number("__slot")).join(F.broadcast(maps), "__bucket")
    byte = F.expr("cast(conv(hex(substring(__map, cast(bitmap_bit_position(__slot) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.getbit(byte, (F.bitmap_bit_position("__slot") % 8).cast("int")) == 1
    return held.where(hit).select(*df.columns)


def rows_of(spark: SparkSession, df: DataFrame) -> int:
    return df.select(F.lit(1)).count()


def groups(total: float, per: float, least: int = 1) -> int:
    """How many groups of about `per` hold `total`: grows in step with the input."""
    return max(least, int(-(-total // per)))


class Memo(dict):
    """What pieces of text become, bounded in bytes: `room` empties it when too much is held. Pieces over `longest` characters shouldn't stay."""

    longest = 256

    def __init__(self, most: int = 96 << 20):
        self.most, self.held = most, 0

    def put(self, piece: str, ids: bytes) -> bytes:
        self.held += 4 * len(piece) + len(ids) + 200
        self[piece] = ids
        return ids

    def room(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0

    def drop_long(self, pieces) -> None:
        """Take out long pieces once they are used."""
        for w in pieces:
            if len(w) > self.longest and w in self:
                self.held -= 4 * len(w) + len(self.pop(w)) + 200


Batches = Iterator[pa.RecordBatch]
