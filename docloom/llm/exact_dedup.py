"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when identical after all characters of ``[\\x20\\x09-\\x0D]`` are deleted. Map tasks
collapse equal texts inside each Arrow batch (so a text that a third of all rows share leaves a task
once a batch, not once a row). Owner tasks each hold one range of the 64-bit key: they read their rows in key order,
compare the bytes of texts under one key, chain unequal ones, and insert into a directory of
buckets that doubles when a bucket overflows. Owners are as many as rows and bytes ask for, each one task. An owner writes its index as one file in the shared folder, whole
or not at all. Every row then looks itself up in its owner's file; owners with many rows
are probed by several tasks.

Defined cases: a null text counts as empty, and all empty texts are one group; very long texts are
compared whole, one at a time; repeated doc_ids are separate rows; among equal texts the most code points, then the smallest doc_id (null last) stays, and
of several rows equal in both, all carry that keep_id and exactly one is kept, even if nothing tells them apart; an empty table gives
an empty result; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, SPACE, Batches, drop_table, get_file, groups, identified, materialise, put_file, rows_in, scratch, texts

BUCKET = 32
MAGIC = b"XHI1"
ODD = 0x9E3779B97F4A7C15
NULL_ID = np.iinfo(np.int64).max


class ExtendibleHash:
    """Directory of buckets addressed by the leading bits of a 64-bit key that follow `skip` bits.

    A bucket over `size` keys splits by one more bit, and the directory doubles when that bucket was as deep as
    the directory. Keys that agree in `deepest` leading bits share a bucket however many they are. One key is one entry; entries of unequal texts under one key are its chain.
    """

    def __init__(self, size: int = BUCKET, deepest: int = 24):
        self.size, self.deepest, self.depth = size, deepest, 0
        self.directory: list[list] = [[0, {}]]

    def insert(self, key: int, chain: list) -> None:
        while True:
            bucket = self.directory[key >> (64 - self.depth) if self.depth else 0]
            bucket[1][key] = chain
            if len(bucket[1]) <= self.size or bucket[0] >= self.deepest:
                return
            del bucket[1][key]
            self._split(bucket)

    def _split(self, bucket: list) -> None:
        if bucket[0] == self.depth:
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth += 1
        low, high = [bucket[0] + 1, {}], [bucket[0] + 1, {}]
        bit = 63 - bucket[0]
        for k, c in bucket[1].items():
            (high if k >> bit & 1 else low)[1][k] = c
        # the slots of one bucket are contiguous, as the address is a prefix of the key
        some = next(iter(bucket[1]))
        width = 1 << (self.depth - bucket[0])
        first = (some >> (64 - self.depth)) // width * width
        for i in range(width):
            self.directory[first + i] = low if i < width // 2 else high

    def pack(self) -> list[bytes]:
        """Header, directory, bucket offsets, then the columns of the entries in bucket order."""
        number: dict[int, int] = {}
        order, slots = [], []
        for b in self.directory:
            if id(b) not in number:
                number[id(b)] = len(order)
                order.append(b)
            slots.append(number[id(b)])
        entries = [(k, *e) for b in order for k, chain in b[1].items() for e in chain]
        starts = np.cumsum([0] + [sum(len(c) for c in b[1].values()) for b in order]).astype("<u4")
        head = np.array([self.depth, len(order), len(entries)], "<u8")
        cols = [
            np.array([e[0] for e in entries], "<u8").tobytes(),
            b"".join(e[1] for e in entries),
            np.array([e[2] for e in entries], "<i8").tobytes(),
            np.array([e[3] for e in entries], "<i8").tobytes(),
            np.array([e[4] for e in entries], "<i8").tobytes(),
        ]
        return [MAGIC, head.tobytes(), np.array(slots, "<u4").tobytes(), starts.tobytes(), *cols]


class IndexFile:
    """A packed index, for vectorised look-ups."""

    def __init__(self, raw):
        raw = memoryview(raw)
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not an index file")
        self.depth, buckets, n = (int(x) for x in np.frombuffer(raw, "<u8", 3, 4))
        at = 28
        self.slots = np.frombuffer(raw, "<u4", 1 << self.depth, at)
        at += 4 << self.depth
        self.starts = np.frombuffer(raw, "<u4", buckets + 1, at)
        at += 4 * (buckets + 1)
        self.keys = np.frombuffer(raw, "<u8", n, at)
        at += 8 * n
        self.sha = np.frombuffer(raw, "<u8", 4 * n, at).reshape(n, 4)
        at += 32 * n
        self.keep, self.count, self.row = (np.frombuffer(raw, "<i8", n, at + 8 * n * i) for i in range(3))

    def find(self, keys: np.ndarray, sha: np.ndarray) -> np.ndarray:
        """The entry of each (key, digest); every one must be there."""
        slot = (keys >> np.uint64(64 - self.depth)).astype(np.int64) if self.depth else np.zeros(len(keys), np.int64)
        bucket = self.slots[slot]
        at, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            open_ = open_[at[open_] < end[open_]]
            hit = (self.keys[at[open_]] == keys[open_]) & (self.sha[at[open_]] == sha[open_]).all(axis=1)
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        if (found < 0).any():
            raise KeyError("a row is missing from the index")
        return found


def _keys(sha: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(sha.view("<u8").reshape(-1, 4)[:, 0])


def _normal(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    raw = texts(batch)
    norm = [t.translate(None, SPACE) for t in raw]
    sha = np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in norm), np.uint8).copy()
    return raw, norm, sha, _keys(sha) if len(raw) else np.empty(0, np.uint64)


def _owner(keys: np.ndarray, owners: int) -> np.ndarray:
    """The key range that a key falls in."""
    return ((keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int32)


def _code_points(t: bytes) -> int:
    return len(t) if t.isascii() else len(t.decode())


def _collapse(owners: int):
    schema = pa.schema([
        ("owner", pa.int32()), ("key", pa.int64()), ("body", pa.binary()), ("n", pa.int64()), ("cp", pa.int64()), ("id", pa.int64()),
        ("row", pa.int64()),
    ])

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            raw, norm, _, keys = _normal(b)
            ids = b.column(b.schema.get_field_index("doc_id")).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            rows = b.column(b.schema.get_field_index("row")).to_numpy()
            best: dict[bytes, list] = {}
            for i, t in enumerate(norm):
                x = (-_code_points(raw[i]), int(ids[i]), int(rows[i]))
                if (e := best.get(t)) is None:
                    best[t] = [i, 1, x]
                else:
                    e[1] += 1
                    e[2] = min(e[2], x)
            first = np.array([e[0] for e in best.values()])
            k = keys[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_owner(k, owners)), pa.array(k.view(np.int64)), pa.array(list(best), pa.binary())]
                + [pa.array(x, pa.int64()) for x in (
                    [e[1] for e in best.values()], [-e[2][0] for e in best.values()], [e[2][1] for e in best.values()],
                    [e[2][2] for e in best.values()],
                )],
                schema=schema,
            )

    return run, "owner int, key long, body binary, n long, cp long, id long, row long"


def _build(root: str):
    """Rows come in order of owner and key; only the texts under one key are held at a time."""

    def run(batches: Batches) -> Batches:
        owner, key, index, chain, total, done = None, None, ExtendibleHash(), [], 0, []

        def close_key():
            if chain:
                index.insert(_spread(key & (1 << 64) - 1), [(hashlib.sha256(t).digest(), best[1], n, best[2]) for t, n, best in chain])

        def close_owner():
            if owner is not None:
                put_file(f"{root}/owner-{owner:07d}.xhi", *index.pack())
                done.append((owner, total, index.depth))

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(7)]
            for o, k, body, n, cp, i, row in zip(*cols, strict=True):
                if (o, k) != (owner, key):
                    close_key()
                    chain = []
                    if o != owner:
                        close_owner()
                        index, total = ExtendibleHash(), 0
                    owner, key = o, k
                total += n
                for e in chain:  # equal key: compare the bytes
                    if e[0] == body:
                        e[1] += n
                        e[2] = min(e[2], (-cp, i, row))
                        break
                else:
                    chain.append([body, n, (-cp, i, row)])
        close_key()
        close_owner()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int32())],
            names=["owner", "rows", "depth"],
        )

    return run, "owner int, rows long, depth int"


def _spread(keys):
    """Keys of one owner share their leading bits; an odd factor (one to one modulo 2^64) gives the directory even ones."""
    if isinstance(keys, int):
        return keys * ODD & (1 << 64) - 1
    with np.errstate(over="ignore"):
        return keys * np.uint64(ODD)


def _ask(owners: int, hot: dict[int, int]):
    """Each row's digest and the task that answers it: rows of a hot owner go to as many tasks as `hot` says.

    `lead` marks the first of equal rows (id and text) in a batch. All leads that are equal go to one task, which keeps one of them.
    """

    def run(batches: Batches) -> Batches:
        turn = 0
        shares = np.ones(owners, np.int64)
        for o, n in hot.items():
            shares[o] = n
        for b in batches:
            if not b.num_rows:
                continue
            _, _, sha, keys = _normal(b)
            owner = _owner(keys, owners)
            row = b.column(b.schema.get_field_index("row")).to_numpy()
            lead = np.zeros(len(keys), bool)
            lead[np.unique(np.stack([row, b.column(b.schema.get_field_index("who")).to_numpy()]), axis=1, return_index=True)[1]] = True
            part = np.where(lead, (row.view(np.uint64) >> np.uint64(8)).astype(np.int64), np.arange(turn, turn + len(keys))) % shares[owner]
            turn += len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("doc_id")), pa.array(row), pa.array(lead), pa.array(owner),
                    pa.array(((owner + part * 7919) % owners).astype(np.int32)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, pa.py_buffer(sha)]).cast(pa.binary()),
                ],
                names=["doc_id", "row", "lead", "owner", "task", "sha"],
            )

    return run, "doc_id long, row long, lead boolean, owner int, task int, sha binary"


def _answer(root: str):
    def run(batches: Batches) -> Batches:
        have: dict[int, IndexFile] = {}
        done: set[tuple[int, int]] = set()  # entries whose row is given, of those that more than one lead asks for
        for b in batches:
            if not b.num_rows:
                continue
            doc, row, lead, owner, sha = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "row", "lead", "owner", "sha"))
            hexes = [x.hex() for x in sha.to_pylist()]
            sha = np.frombuffer(b"".join(sha.to_pylist()), "<u8").reshape(-1, 4)
            owner, row, lead = owner.to_numpy(), row.to_numpy(), lead.to_numpy(zero_copy_only=False)
            ids = doc.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            keep, count, kept = (np.empty(len(owner), np.int64) for _ in range(3))
            for o in np.unique(owner):
                if o not in have:
                    if len(have) >= 4:
                        have.pop(next(iter(have)))
                    have[o] = IndexFile(get_file(f"{root}/owner-{o:07d}.xhi"))
                at, ix = np.flatnonzero(owner == o), have[o]
                e = ix.find(_spread(np.ascontiguousarray(sha[at, 0])), sha[at])
                keep[at], count[at], kept[at] = ix.keep[e], ix.count[e], ix.row[e]
            stays = lead & (kept == row) & (keep == ids)
            for i in np.flatnonzero(stays & (count > 1)).tolist():
                x = (int(row[i]), int(ids[i]))
                stays[i] = x not in done
                done.add(x)
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(row), pa.array(keep, mask=keep == NULL_ID), pa.array(count), pa.array(stays), pa.array(hexes)],
                names=["doc_id", "row", "keep_id", "group_size", "kept", "text_sha256"],
            )

    return run, "doc_id long, row long, keep_id long, group_size long, kept boolean, text_sha256 string"


def exact_dedup(spark: SparkSession, docs: DataFrame, per_owner: int = 50_000, owner_bytes: int = 1 << 26) -> DataFrame:
    """One row per row of docs: doc_id, row, keep_id, group_size, kept, text_sha256.

    `row` is a hash of the id and the original text. The driver learns of owners with over four times the mean number of rows only.
    """
    src = identified(docs)
    total, size = src.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    owners = max(groups(total, per_owner), groups(size, owner_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    root = scratch(spark, "exact")
    run, schema = _collapse(owners)
    mapped = src.mapInArrow(run, schema).repartitionById(owners, "owner").sortWithinPartitions("owner", "key")
    run, schema = _build(root)
    built = materialise(spark, mapped.mapInArrow(run, schema), "exact-owners")
    mean = max(1.0, total / owners)
    hot = {r.owner: groups(r.rows, mean) for r in built.where(F.col("rows") > 4 * mean).collect()}
    drop_table(spark, built)
    run, schema = _ask(owners, hot)
    asked = src.mapInArrow(run, schema).repartitionById(owners, "task")
    run, schema = _answer(root)
    return asked.mapInArrow(run, schema)


def kept_documents(spark: SparkSession, docs: DataFrame, per_owner: int = 50_000) -> DataFrame:
    """The rows of docs that stay, all columns as they were."""
    marks = exact_dedup(spark, docs, per_owner).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("who"), "row")
    return rows_in(docs, marks)
