"""First-fit decreasing packing with a tournament tree of bin capacities, in randomised groups of pieces.

A document's ids are cut at multiples of the sequence length; full pieces are sequences of their own, and
each piece goes to a group by a hash of (doc_id, start, text) and, for equal rows, of how many came before it in its batch, so groups are alike in size and content whatever
the order of the input and however many rows are equal. Inside a group the pieces are placed longest first, each into the first open bin that has
room: the tree's leaves hold the bins' free room and its inner nodes the largest below, so a piece costs
one descent. The number of groups follows the numbers of rows and bytes, and only piece descriptions are shuffled.

Defined cases: a null text counts as empty, and an empty document is its end id alone; a very long text is encoded whole in one task (a few times its size in memory), its pieces spread over all groups; rows that share a doc_id are packed as
separate documents (in the digest query their pieces have the same doc_id); ties go by a hash of the piece; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, groups
from .subwords import encoder

LENGTH = 2048


class CapacityTree:
    """The largest free room of every range of bins, for `room` bins at first; it doubles when all are in use."""

    def __init__(self, capacity: int, room: int = 64):
        self.capacity, self.leaves = capacity, room
        self.tree = [capacity] * (2 * room)

    def place(self, size: int) -> int:
        """The first bin with `size` free; it takes the piece."""
        tree = self.tree
        if tree[1] < size:
            self._double()
            tree = self.tree
        i = 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        tree[i] -= size
        at = i - self.leaves
        while i > 1:
            i //= 2
            top = tree[2 * i] if tree[2 * i] >= tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == top:
                break
            tree[i] = top
        return at

    def _double(self) -> None:
        used = self.tree[self.leaves :]
        self.leaves *= 2
        self.tree = [0] * self.leaves + used + [self.capacity] * len(used)
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece; equal sizes keep their order."""
    tree, filled = CapacityTree(capacity), []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        b = tree.place(int(sizes[i]))
        if b == len(filled):
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += int(sizes[i])
    return bins, offsets


def _pieces(tokenizer: str, end_id: int, length: int, n_groups: int, keep_ids: bool):
    kinds = [
        ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("group", pa.int64()),
    ] + [("ids", pa.binary())] * keep_ids
    end = np.array([end_id], "<u2")

    def run(batches: Batches) -> Batches:
        enc = encoder(tokenizer)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            rows = b.column(2).to_pylist()
            out, before = [], Counter()
            for d, r, t in zip(ids, rows, enc.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                t = np.concatenate([t, end])
                wide = t.astype("<u4")
                for s in range(0, len(t), length):
                    part = wide[s : s + length]
                    g = zlib.crc32(f"{r}:{s}:{before[r]}".encode()) * n_groups >> 32
                    out.append((d, r, s, len(part), zlib.crc32(part), len(t), g, *[t[s : s + length].tobytes()] * keep_ids))
                before[r] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k[1]) for c, k in zip(zip(*out), kinds, strict=True)], names=[k[0] for k in kinds])

    return run, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, group long" + ", ids binary" * keep_ids


def pack(
    spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, per_group: int = 8192,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, row, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids, 16 bits each, if asked for).

    A group holds per_group pieces at most on average, a few numbers each.
    """
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = groups(total + size / (2 * length), per_group)  # a token has two bytes or more, but for rare texts
    run, schema = _pieces(tokenizer, end_id, length, n, keep_ids)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"))
    pieces = src.mapInArrow(run, schema)

    def place(table: pa.Table) -> pa.Table:
        size = table["length"].to_numpy()
        order = np.lexsort((table["ids_crc32"].to_numpy(), table["start"].to_numpy(), table["row"].to_numpy()))
        bins, offsets = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        bins[order], offsets[order] = first_fit_decreasing(size[order], length)
        seq = (table["group"].to_numpy() << 40) + bins
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offsets))

    return pieces.groupBy("group").applyInArrow(place, schema.replace(", group long", "") + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack(keep_ids=True): sequence_id, n_tokens, ids (16 bits each, pieces in order of offset)."""
    return (
        packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
        .select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x.ids)).alias("ids"))
    )


def padding(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """How much of all sequences is padding; a sequence whose length is a power of two needs none."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    full = F.when(F.expr("n & (n - 1)") == 0, F.col("n")).otherwise(F.lit(length))
    return per.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_tokens"), F.sum(full - F.col("n")).alias("n_padding"))
