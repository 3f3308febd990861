"""Token ids in raw shard files, with a minimal perfect hash index from document keys to shard offsets.

Format, below one folder: `shard-N.bin` holds ids back to back (unsigned 16-bit little-endian), nothing else; `index-N.mph` holds
one hash bucket of keys: the levels of a minimal perfect hash (each a bit array in which the keys alone on
their bit have it set; a key's slot is the rank of its bit) and, by slot, fingerprint, shard, first id,
number of ids and the number of ids before the shard; `keys` is a Parquet table of all keys, for reading everything back; `manifest.json` is written
last and says how many buckets there are, so `open_store` finds a store from its folder alone. A look-up hashes the key, tests one bit a level (1.6 levels on
average; the levels of a bucket, some bits a key, are read once and held for the last 64 buckets), and reads one slot of the index file and one range of the shard;
a stored 32-bit fingerprint turns away keys that were never stored.

Rows are range-partitioned and sorted by (doc_id, hash of text), encoded, and each partition writes one shard under a private name, moved
into place when whole. Shards are as many as rows and bytes ask for. A key is (doc_id, k): the k-th row of that doc_id, so a doc_id that many rows share
spreads over the buckets, and a look-up of a doc_id asks for k = 0, 1, ... until there is none. Ids before a shard are summed in windows of
BLOCK shards; only one row for each of these blocks reaches the driver.

Defined cases: null texts count as empty (the end id alone); a null doc_id is a key of its own and comes first; repeated doc_ids and repeated rows are
separate records in order of their text's hash; a very long text is encoded whole in one task and makes its shard longer; an empty table gives no shard and an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, Batches, drop_table, get_file, groups, materialise, mix, open_out, put_file, scratch, write_table
from .subwords import encoder

MAGIC = b"MPH1"
NULL_KEY = np.int64(NO_ID)
BLOCK = 1024
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u4"), ("pad", "<u4"), ("before", "<u8")])


def key_hash(doc_id: np.ndarray, k: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of a (doc_id, k) key."""
    with np.errstate(over="ignore"):
        return mix(mix(doc_id.view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) ^ mix(k.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))


class PerfectHash:
    """Levels of bit arrays with ranks; `gamma` bits a key in each level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        self.sizes = [8 * len(x) for x in levels]
        self.ranks, total = [], 0
        for x in levels:
            ones = np.bitwise_count(x).astype(np.int64)
            r = np.concatenate([[0], np.cumsum(ones)]) + total
            self.ranks.append(r)
            total = int(r[-1])
        self.count = total

    @staticmethod
    def _at(h: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(h + np.uint64(level + 1) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, rest = [], h
        while len(rest):
            if len(levels) > 60:
                raise ValueError("equal hashes: take another seed")
            bits = max(8, -(-int(gamma * len(rest)) // 8) * 8)
            at = cls._at(rest, len(levels), bits)
            count = np.bincount(at, minlength=bits)
            levels.append(np.packbits(count == 1, bitorder="little"))
            rest = rest[count[at] > 1]
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were never stored."""
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for i, (x, bits) in enumerate(zip(self.levels, self.sizes)):
            at = self._at(h[open_], i, bits)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = x[byte] >> bit & 1 == 1
            o = open_[hit]
            below = np.bitwise_count(x[byte[hit]] & ((np.uint16(1) << bit[hit].astype(np.uint16)) - 1).astype(np.uint8))
            out[o] = self.ranks[i][byte[hit]] + below
            open_ = open_[~hit]
        return out


def pack_index(doc_id: np.ndarray, k: np.ndarray, records: np.ndarray) -> list[bytes]:
    """An index file: header, levels, slots. Equal 64-bit hashes in the bucket (all but impossible) ask for another seed."""
    seed = 0
    while len(np.unique(h := key_hash(doc_id, k, seed))) < len(h):
        seed += 1
        if seed > 8:
            raise ValueError("a key is there twice")
    p = PerfectHash.build(h)
    slots = np.zeros(len(h), SLOT)
    slots[p.slots(h)] = records
    slots["print"][p.slots(h)] = IndexFile.print_of(h)
    head = np.array([seed, len(p.levels), len(h), *(len(x) for x in p.levels)], "<u8")
    return [MAGIC, head.tobytes(), *(x.tobytes() for x in p.levels), slots.tobytes()]


class IndexFile:
    """An index file; with `slots` left out, only what comes before them, `head` bytes long."""

    def __init__(self, raw, slots: bool = True):
        raw = memoryview(raw)
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not an index file")
        self.seed, n_levels, n = (int(x) for x in np.frombuffer(raw, "<u8", 3, 4))
        sizes = np.frombuffer(raw, "<u8", n_levels, 28).astype(int)
        at, levels = 28 + 8 * n_levels, []
        for s in sizes:
            levels.append(np.frombuffer(raw, np.uint8, s, at))
            at += s
        self.head, self.hash, self.slots = at, PerfectHash(levels), np.frombuffer(raw, SLOT, n, at) if slots else None

    @classmethod
    def levels_of(cls, file) -> IndexFile:
        """Of an open file, without its slots."""
        n_levels = int(np.frombuffer(file.read_at(8, 12), "<u8")[0])
        sizes = np.frombuffer(file.read_at(8 * n_levels, 28), "<u8")
        return cls(file.read_at(28 + 8 * n_levels + int(sizes.sum()), 0), slots=False)

    @staticmethod
    def print_of(h: np.ndarray) -> np.ndarray:
        return (mix(~h) >> np.uint64(32)).astype(np.uint32)

    def find(self, doc_id: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are stored (by fingerprint), and the slots of those."""
        h = key_hash(doc_id, k, self.seed)
        s = self.hash.slots(h)
        ok = s >= 0
        ok[ok] = self.slots["print"][s[ok]] == self.print_of(h[ok])
        return ok, self.slots[s[ok]]


class TokenStore:
    """The files of one write. `find` and `get` answer for single documents from any process that sees the folder."""

    def __init__(self, root: str, buckets: int):
        self.root, self.buckets, self._open = root, buckets, {}

    def find(self, doc_id: int | None, k: int = 0):
        """The slot of the k-th row of doc_id, or None."""
        d, n = np.array([NULL_KEY if doc_id is None else doc_id], np.int64), np.array([k], np.int64)
        b = int(bucket_of(d, n, self.buckets)[0])
        system, path = open_out(f"{self.root}/index-{b:06d}.mph")
        try:
            with system.open_input_file(path) as f:
                if b not in self._open:
                    if len(self._open) >= 64:
                        self._open.pop(next(iter(self._open)))
                    self._open[b] = IndexFile.levels_of(f)
                index = self._open[b]
                h = key_hash(d, n, index.seed)
                at = int(index.hash.slots(h)[0])
                slot = np.frombuffer(f.read_at(SLOT.itemsize, index.head + at * SLOT.itemsize), SLOT)[0] if at >= 0 else None
        except FileNotFoundError:
            return None
        return slot if slot is not None and slot["print"] == index.print_of(h)[0] else None

    def get(self, doc_id: int | None, k: int = 0) -> np.ndarray | None:
        """The ids of the k-th row of doc_id, or None: one slot and one range of one shard are read."""
        s = self.find(doc_id, k)
        if s is None:
            return None
        system, path = open_out(f"{self.root}/shard-{int(s['shard']):06d}.bin")
        with system.open_input_file(path) as f:
            return np.frombuffer(f.read_at(2 * int(s["n"]), 2 * int(s["first"])), "<u2")


def open_store(root: str) -> TokenStore:
    """The store that was written to a folder."""
    return TokenStore(root, json.loads(bytes(get_file(f"{root}/manifest.json")))["buckets"])


def bucket_of(doc_id: np.ndarray, k: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key_hash(doc_id, k, 99) % np.uint64(buckets)).astype(np.int32)


def _write_shards(root: str, tokenizer: str, end_id: int):
    """Rows of kind 0, one a record; a row of kind 1 for each shard (its first doc_id, n equal ones at its beginning, `first` ids in all), and one of kind 2 for its last doc_id, if another."""
    end = np.array([end_id], "<u2").tobytes()
    kinds = [("kind", pa.int32()), ("shard", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches: Batches) -> Batches:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        out, at, rows = [], 0, 0
        runs: list[list] = []  # the first and the last run of equal doc_ids
        for b in batches:
            if not b.num_rows:
                continue
            ids = [x.tobytes() + end for x in enc.encode([t or "" for t in b.column(1).to_pylist()])]
            for d, same in itertools.groupby(b.column(0).to_pylist()):
                if runs and runs[-1][0] == d:
                    runs[-1][1] += sum(1 for _ in same)
                else:
                    runs[1:] = [[d, sum(1 for _ in same)]]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            out += ids
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(n), np.int32)), pa.array(np.full(len(n), shard, np.int32)),
                    pa.array(np.arange(rows, rows + len(n))), b.column(0), pa.array(first), pa.array(n),
                ],
                schema=schema,
            )
            rows += len(n)
        if rows:
            put_file(f"{root}/shard-{shard:06d}.bin", *out)
            m = len(runs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(([1, 2][:m], [shard] * m, [rows] * m, [r[0] for r in runs], [at] * m, [r[1] for r in runs]), kinds)],
                schema=schema,
            )

    return run, "kind int, shard int, at long, doc_id long, first long, n long"


def _index(root: str):
    def build(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        doc, k = (table[c].to_numpy() for c in ("key", "k"))
        rec = np.zeros(len(doc), SLOT)
        for c in ("shard", "first", "n", "before"):
            rec[c] = table[c].to_numpy()
        put_file(f"{root}/index-{bucket:06d}.mph", *pack_index(doc, k, rec))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(doc)], pa.int64())})

    return build


def _bounds(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(shard, before, base): ids before each shard, and how many rows of its first doc_id earlier shards hold."""
    earlier = lambda key: Window.partitionBy(key).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = edges.where("kind = 1").select("shard", F.col("first").alias("ids"), F.expr(f"shard div {BLOCK}").alias("block"))
    blocks = totals.groupBy("block").agg(F.sum("ids").alias("ids")).orderBy("block").collect()  # one row for 1,024 shards
    sums = list(itertools.accumulate((r.ids for r in blocks), initial=0))
    sofar = spark.createDataFrame([(r.block, s) for r, s in zip(blocks, sums)], "block long, sofar long")
    before = totals.withColumn("inside", F.coalesce(F.sum("ids").over(earlier("block")), F.lit(0))).join(sofar, "block").select("shard", (F.col("inside") + F.col("sofar")).alias("before"))
    base = edges.withColumn("base", F.coalesce(F.sum("n").over(earlier("doc_id")), F.lit(0))).where("kind = 1").select("shard", "base")
    return before.join(base, "shard")


def _number(buckets: int):
    """The key of each record, from records in order of shard and place."""

    def run(batches: Batches) -> Batches:
        last = None  # shard, key, k and place of the last row
        for b in batches:
            if not b.num_rows:
                continue
            shard, doc, at, first, n, before, base = (b.column(b.schema.get_field_index(c)) for c in ("shard", "doc_id", "at", "first", "n", "before", "base"))
            key = doc.fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False)
            s, place = shard.to_numpy(), at.to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (s[1:] != s[:-1])]))
            begin = np.where(place[new] == 0, base.to_numpy()[new], 0)
            if last and last[:2] == (s[0], key[0]):
                begin[0] = last[2] + 1
            many = np.diff(np.append(new, len(key)))
            k = np.arange(len(key)) + np.repeat(begin - new, many)
            last = (s[-1], key[-1], k[-1])
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(key), pa.array(k), shard, first, n, before, pa.array(bucket_of(key, k, buckets))],
                names=["doc_id", "key", "k", "shard", "first", "n", "before", "bucket"],
            )

    return run, "doc_id long, key long, k long, shard int, first long, n long, before long, bucket int"


def write(
    spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, per_shard: int = 16_384, shard_bytes: int = 1 << 26,
    per_bucket: int = 262_144, root: str | None = None,
) -> TokenStore:
    """Encode, write and index all rows of docs below `root`, an empty or new folder that driver and executors share; by default one that lasts as long as the driver."""
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    root = root or scratch(spark, "tokens")
    buckets = groups(total, per_bucket)
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(max(groups(total, per_shard), groups(size, shard_bytes)), *order)
    run, schema = _write_shards(root, tokenizer, end_id)
    meta = materialise(spark, src.sortWithinPartitions(*order).mapInArrow(run, schema), "token-records")
    bounds = _bounds(spark, materialise(spark, meta.where("kind > 0"), "token-edges"))
    run, schema = _number(buckets)
    keyed = meta.where("kind = 0").join(bounds, "shard").repartition("shard").sortWithinPartitions("shard", "at")
    keyed = write_table(spark, keyed.mapInArrow(run, schema), f"{root}/keys")
    materialise(spark, keyed.groupBy("bucket").applyInArrow(_index(root), "bucket int, n long"), "token-buckets")
    drop_table(spark, meta)
    put_file(f"{root}/manifest.json", json.dumps({"buckets": buckets, "rows": total, "end_id": end_id, "tokenizer": tokenizer}).encode())
    return TokenStore(root, buckets)


def read_all(store: TokenStore) -> DataFrame:
    """Every stored row by keyed access: doc_id, k, start (ids of all rows before), n_tokens, ids_crc32 of 32-bit ids.

    Keys look themselves up in their bucket's index, then go to their shard, which is read once.
    """
    root = store.root

    def look(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        ok, s = IndexFile(get_file(f"{root}/index-{bucket:06d}.mph")).find(table["key"].to_numpy(), table["k"].to_numpy())
        if not ok.all():
            raise KeyError("a stored key isn't found")
        return pa.table({
            "doc_id": table["doc_id"], "k": table["k"], "shard": pa.array(s["shard"].astype(np.int32)),
            "first": pa.array(s["first"].astype(np.int64)), "n": pa.array(s["n"].astype(np.int64)),
            "before": pa.array(s["before"].astype(np.int64)),
        })

    def read(table: pa.Table) -> pa.Table:
        raw = memoryview(get_file(f"{root}/shard-{table['shard'][0].as_py():06d}.bin"))
        first, n = table["first"].to_numpy(), table["n"].to_numpy()
        crc = [zlib.crc32(np.frombuffer(raw, "<u2", int(m), 2 * int(f)).astype("<u4")) for f, m in zip(first, n)]
        return pa.table({
            "doc_id": table["doc_id"], "k": table["k"], "start": pa.array(first + table["before"].to_numpy()), "n_tokens": table["n"],
            "ids_crc32": pa.array(crc, pa.int64()),
        })

    keys = SparkSession.active().read.schema("doc_id long, key long, k long, bucket int").parquet(f"{root}/keys")
    found = keys.groupBy("bucket").applyInArrow(look, "doc_id long, k long, shard int, first long, n long, before long")
    return found.groupBy("shard").applyInArrow(read, "doc_id long, k long, start long, n_tokens long, ids_crc32 long")
