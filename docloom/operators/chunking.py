"""Recursive character chunking (CHK1-CHK5): one Arrow pass over texts; also a table function for SQL."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings

DEFAULT = Settings()


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring parts joined up to the size; a new chunk begins with whole parts of the old one, up to the overlap."""
    out, held, total = [], [], 0
    for p in parts:
        if held and total + len(p) > size:
            out.append("".join(held))
            first = 0
            while total > overlap or (total > 0 and total + len(p) > size):
                total -= len(held[first])
                first += 1
            del held[:first]
        held.append(p)
        total += len(p)
    if held:
        out.append("".join(held))
    return [c for c in map(str.strip, out) if c]


def split_text(t: str, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap, separators: Sequence[str] = DEFAULT.separators) -> list[str]:
    """Chunks of at most `size` characters where the separators allow it: the first one that occurs splits the text (and stays at
    the front of what follows it), and what is still too long is split by those after it."""
    if overlap > size:
        raise ValueError("the overlap is larger than a chunk")
    at = next((i for i, s in enumerate(separators) if s in t), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    pieces = t.split(sep) if sep else list(t)
    parts = [p for p in ([pieces[0], *(sep + p for p in pieces[1:])] if sep else pieces) if p]
    out, short = [], []
    for p in parts:
        if len(p) < size:
            short.append(p)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_text(p, size, overlap, rest) if rest else [p]
    return out + _merge(short, size, overlap)


def chunk_rows(t: str | None, size: int, overlap: int, separators: Sequence[str]) -> list[tuple[int, str, int]]:
    """(index, content, length) of each chunk that isn't blank; indexes count blank ones too (CHK3)."""
    if not t or not t.strip():
        return []
    return [(i, c.strip(), len(c.strip())) for i, c in enumerate(split_text(t, size, overlap, separators)) if c.strip()]


def chunk_documents(
    docs: DataFrame, source: str = "source_file", document: str = "document_id", text: str = "text", size: int | None = None,
    overlap: int | None = None, separators: Sequence[str] | None = None, random_ids: bool = False,
) -> DataFrame:
    """Rows of the CHUNK schema. Ids are hashes of file, document, index and content, so repeated tasks give the same ones; or random if asked for."""
    s = DEFAULT.given(chunk_size=size, chunk_overlap=overlap, separators=separators)
    args = (s.chunk_size, s.chunk_overlap, tuple(s.separators))

    def run(batches):
        for b in batches:
            src, doc, rows = [], [], []
            for f, d, t in zip(*(c.to_pylist() for c in b.columns)):
                got = chunk_rows(t, *args)
                src += [f] * len(got)
                doc += [d] * len(got)
                rows += got
            if rows:
                i, c, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(src, pa.string()), pa.array(doc, pa.string()), pa.array(i, pa.int32()), pa.array(c, pa.string()), pa.array(n, pa.int32())],
                    names=["source_file", "document_id", "chunk_index", "content", "char_count"],
                )

    cut = docs.select(F.col(source).cast("string"), F.col(document).cast("string"), F.col(text).cast("string")).mapInArrow(
        run, "source_file string, document_id string, chunk_index int, content string, char_count int",
    )
    key = F.uuid() if random_ids else F.sha2(F.concat_ws("#", "source_file", "document_id", "chunk_index", "content"), 256)
    return cut.select(key.alias("chunk_id"), "source_file", "document_id", "chunk_index", "content", "char_count")


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """CHK4: chunks with more than white space."""
    from ..functions.text import u_trim

    return chunks.where(F.length(u_trim(F.col("content"))) > 0)


def register(spark: SparkSession, name: str = "chunk") -> None:
    """CHK5: SELECT ... FROM docs, LATERAL chunk(text)."""
    from pyspark.sql.functions import udtf

    class Chunk:
        def eval(self, t: str):
            yield from chunk_rows(t, DEFAULT.chunk_size, DEFAULT.chunk_overlap, DEFAULT.separators)

    spark.udtf.register(name, udtf(Chunk, returnType="chunk_index int, content string, char_count int"))
