"""Repeated passages by sparse suffix arrays.

A suffix is retained at each anchor: the position whose 6-word hash is least among 32 consecutive ones (leftmost on ties). Every
window of 50 words has one anchor among its first 32 positions, chosen by the window's content alone, so
equal windows in two documents have suffixes retained at the same place, which agree in at least 19 words.

1. Retained suffixes are sorted by their words (the first four as 16 bits each, ties by a 64-bit hash of the first 19, then by where they stand; range-partitioned
   on all of it, so a passage that a third of all documents share spreads over many tasks) and compared with their neighbours,
   also across the borders of partitions. Suffixes that agree with neither in 19 words are left out.
2. All windows of an anchor together are its stretch. Where all suffixes with the same leading words have the same stretch (a second hash), every window of it repeats.
3. Where they differ, one suffix of each kind of stretch is sorted again, by all its words up to the stretch's end (48 bits a word). The words that it shares
   with its neighbours are counted; it shares no more with any other suffix. So matches are extended right: a window that ends
   beyond what is shared stands alone. The others are extended left: windows that agree in their words before the anchor as well (a 64-bit hash) are found by grouping.
4. Windows that occur twice or more, joined where they overlap, are the repeated passages: the same set of words that comparing
   all 50-word windows of all documents gives. The first occurrence, in order of doc_id, row and place, is marked as such.

Words are ``[^\\x20\\x09-\\x0D]+`` and compared as they are; white space between them doesn't matter. Equality is that of the hashes named.
Defined cases: null texts and texts under 50 words have no repeated passage; passages repeated inside one document count; very long texts are read whole, their anchors found
in pieces; a null doc_id comes last in order; rows that share a doc_id are separate rows; rows equal in doc_id and text are one row;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Batches, finished, groups, id_filter, identified, lean, materialise, mix, packed_rows, rows_of, texts
from .jaccard_join import ROWS, word_hashes

_B = 0x9E3779B97F4A7C15
AT = "struct<x:boolean,doc_id:bigint,row:bigint,p:bigint>"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Powers:
    """Powers of an odd base modulo 2^64, and of its inverse."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up), 4096)
            with np.errstate(over="ignore"):
                for name, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
                    p = np.full(n, base, np.uint64)
                    p[0] = 1
                    setattr(cls, name, np.multiply.accumulate(p))


class Text:
    """Hashes of any stretch of a text's words."""

    def __init__(self, w: np.ndarray):
        _Powers.to(len(w) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w) * _Powers.up[: len(w)], dtype=np.uint64)])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * _Powers.down[a])


class Shape:
    """The length of a passage and the spacing of anchors."""

    def __init__(self, words: int = 50, window: int = 32, gram: int = 6):
        if words - window + 1 < gram:
            raise ValueError("anchors too far apart for passages of this length")
        self.words, self.window, self.gram, self.lead = words, window, gram, words - window + 1

    def anchors(self, w: np.ndarray):
        """Anchor, first and last window start, the first four words, hash of the leading words, hash of the whole stretch."""
        n = len(w)
        if n < self.words:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 3
        t = Text(w)
        at = np.arange(n - self.gram + 1)
        h = t.hash(at, at + self.gram)
        starts = n - self.words + 1
        of = np.empty(starts, np.int64)
        for i in range(0, starts, 1 << 16):  # bounded memory for long texts
            part = np.lib.stride_tricks.sliding_window_view(h[i : min(starts, i + (1 << 16)) + self.window - 1], self.window)
            of[i : i + len(part)] = part.argmin(1) + np.arange(i, i + len(part))
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        last = np.append(first[1:], starts) - 1
        p = of[first]
        whole = t.hash(first, last + self.words)
        with np.errstate(over="ignore"):
            whole = mix(whole ^ ((p - first) * 64 + last - first).astype(np.uint64) * np.uint64(_B))
        top = mix(w) >> np.uint64(48)
        head = sum(top[p + i] << np.uint64(48 - 16 * i) for i in range(4)) ^ np.uint64(1 << 63)  # in order as a signed number
        return p, first, last, head, t.hash(p, p + self.lead), whole


def _anchors(shape: Shape):
    names = ["head", "lead", "whole", "doc_id", "row", "p", "back", "n"]

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            got = [shape.anchors(word_hashes(t)) for t in texts(b)]
            many = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
            p, first, last, head, lead, whole = (np.concatenate(c) for c in zip(*got))
            doc, row = (b.column(b.schema.get_field_index(c)).take(pa.array(many)) for c in ("doc_id", "row"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(head.view(np.int64)), pa.array(lead.view(np.int64)), pa.array(whole.view(np.int64)), doc, row, pa.array(p),
                    pa.array((p - first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                ],
                names=names,
            )

    return run, "head long, lead long, whole long, doc_id long, row long, p long, back int, n int"


def _neighbours(batches: Batches) -> Batches:
    """Suffixes that agree with a neighbour, and the first and last of the partition (edge), from sorted rows."""
    held = None  # the last row of what came before, and whether it agrees with the one before it
    begun = False
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.Table.from_batches(([held[0]] if held else []) + [b]).combine_chunks().to_batches()[0]
        lead = b.column(1).to_numpy()
        same = lead[1:] == lead[:-1]  # 19 words
        twin = np.concatenate([[held[1] if held else False], same]) | np.concatenate([same, [False]])
        edge = np.zeros(len(lead), bool)
        edge[0] = not begun
        begun = True
        out = twin | edge
        held = (b.slice(len(lead) - 1), bool(twin[-1]))
        out[-1] = False
        if out.any():
            k = pa.array(np.flatnonzero(out))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(k) for c in b.columns), pa.array(twin[out]), pa.array(edge[out])], names=[*b.schema.names, "twin", "edge"],
            )
    if held:
        b, twin = held
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([twin]), pa.array([True])], names=[*b.schema.names, "twin", "edge"])


def _stretches(shape: Shape):
    """Of each stretch asked for (`want`), its words before the anchor, last first, and from the anchor on: six bytes a word, in order."""
    passed = ["lead", "whole", "c", "at", "back", "n"]

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            want = b.column(0)
            offs, ws = want.offsets.to_numpy(), want.values
            p, back, n = (ws.field(c).to_numpy() for c in ("p", "back", "n"))
            entry, left, right = [], [], []
            for i, t in enumerate(texts(b)):
                w = np.ascontiguousarray(mix(word_hashes(t)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6])
                for j in range(offs[i], offs[i + 1]):
                    s = p[j] - back[j]
                    left.append(w[s : p[j]][::-1].tobytes())
                    right.append(w[p[j] : s + n[j] - 1 + shape.words].tobytes())
                    entry.append(j)
            at = pa.array(entry)
            yield pa.RecordBatch.from_arrays(
                [*(ws.field(c).take(at) for c in passed), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=[*passed, "before", "after"],
            )

    return run, f"lead long, whole long, c long, at {AT}, back int, n int, before binary, after binary"


def _words_of(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words as numbers, padded to `width`, and how many there are."""
    raw = col.to_pylist()
    many = np.array([len(x) // 6 for x in raw], np.int64)
    flat = np.zeros((many.sum(), 8), np.uint8)
    flat[:, 2:] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), width), np.uint64)
    out[np.arange(width) < many[:, None]] = flat.view(">u8").ravel()
    return out, many


def _windows(shape: Shape):
    """From sorted suffixes, the windows that may repeat: hash, place in the stretch, and what is known of the stretch."""

    def emit(b: pa.RecordBatch, after: np.ndarray, many: np.ndarray, shared: np.ndarray):
        before, back = _words_of(b.column("before"), shape.window)
        n = b.column("n").to_numpy()
        shared = np.where(b.column("c").to_numpy() > 1, shape.words, shared)  # a stretch that is there twice is shared whole
        # a window that begins k words before the anchor needs shape.words - k shared ones
        least = np.maximum(back - n + 1, shape.words - shared)
        hashes, entry, place = [], [], []
        for j in np.flatnonzero(least <= back):
            t = Text(np.concatenate([before[j, : back[j]][::-1], after[j, : many[j]]]))
            s = np.arange(back[j] - least[j] + 1)
            hashes.append(t.hash(s, s + shape.words))
            entry.append(np.full(len(s), j))
            place.append(s.astype(np.int32))
        if hashes:
            at = pa.array(np.concatenate(entry))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(place)),
                    *(b.column(c).take(at) for c in ("c", "whole", "lead", "at")),
                ],
                names=["w", "i", "c", "whole", "lead", "at"],
            )

    def run(batches: Batches) -> Batches:
        held = None  # the last row, and what it shares with the one before it; at the ends of a partition, all it has
        for b in batches:
            if not b.num_rows:
                continue
            if held:
                b = pa.Table.from_batches([held[0], b]).combine_chunks().to_batches()[0]
            after, many = _words_of(b.column("after"), shape.words)
            lead = b.column("lead").to_numpy()
            up_to = np.minimum(many[1:], many[:-1])
            equal = (after[1:] == after[:-1]) & (np.arange(shape.words) < up_to[:, None])
            common = np.where(lead[1:] == lead[:-1], np.logical_and.accumulate(equal, axis=1).sum(1), 0)
            above = np.concatenate([[held[1] if held else shape.words], common])
            shared = np.maximum(above, np.append(common, 0))
            k = len(lead) - 1
            if k:
                yield from emit(b.slice(0, k), after[:k], many[:k], shared[:k])
            held = b.slice(k), int(above[k])
        if held:
            after, many = _words_of(held[0].column("after"), shape.words)
            yield from emit(held[0], after, many, np.array([shape.words]))

    return run, f"w long, i int, c long, whole long, lead long, at {AT}"


def repeats(spark: SparkSession, docs: DataFrame, shape: Shape | None = None) -> DataFrame:
    """One row per repeated passage of each row of docs: doc_id, row, start and end (word numbers; end excluded), first, source_doc_id.

    `first` passages are first occurrences; the others repeat something that stands earlier, at its beginning in source_doc_id.
    """
    shape = shape or Shape()
    src = identified(docs)
    run, schema = _anchors(shape)
    made = materialise(spark, src.mapInArrow(lean(run), schema), "anchors")
    total = made.count()
    parts = groups(total, 400_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ("head", "lead", "row", "p")
    near = materialise(
        spark,
        made.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lean(_neighbours), schema + ", twin boolean, edge boolean"),
        "twins",
    )
    finished(spark, made)
    # leading words on both sides of a border between partitions: two rows a partition at most
    edges = near.where("edge").groupBy("lead").agg(F.countDistinct("row", "p").alias("c")).where("c > 1").select("lead")
    twins = near.where("twin").unionByName(near.where("edge AND NOT twin").join(edges, "lead").select(near.columns)).drop("head", "twin", "edge")
    # a stretch that stands often in one text is one row with all its places; repeated rows count once
    twins = twins.groupBy("lead", "whole", "doc_id", "row", "back", "n").agg(F.collect_set("p").alias("places"))
    twins = materialise(spark, twins, "candidates")
    finished(spark, near)

    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row", F.array_min("places").alias("p"))
    kinds = twins.groupBy("lead", "whole", "back", "n").agg(F.sum(F.size("places")).alias("c"), F.min(place).alias("at"))
    kinds = materialise(spark, kinds, "kinds")
    mixed = kinds.groupBy("lead").agg(F.count("*").alias("k")).where("k > 1").select("lead")
    ask = kinds.join(mixed, "lead").select("lead", "whole", "c", "at", "back", "n", F.col("at.row").alias("row"), F.col("at.p").alias("p"))
    ask = materialise(spark, ask, "mixed")
    wanted = ask.groupBy("row", F.coalesce("at.doc_id", F.lit(NO_ID)).alias("who")).agg(F.collect_list(F.struct("p", "back", "n", "c", "whole", "lead", "at")).alias("want"))
    with_text = id_filter(spark, src.select("row", "who", "text"), ask, "row").join(wanted, ["row", "who"]).dropDuplicates(["row", "who"]).select("want", "text")
    run, schema = _stretches(shape)
    suffixes = materialise(spark, with_text.mapInArrow(lean(run), schema), "suffixes", ROWS)
    run, schema = _windows(shape)
    parts = groups(rows_of(spark, ask), 100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    single = suffixes.repartitionByRange(parts, "lead", "after", "whole").sortWithinPartitions("lead", "after", "whole").mapInArrow(lean(run), schema)
    single = materialise(spark, single, "windows", ROWS)
    finished(spark, ask, suffixes)
    # `at` is the anchor's place; two equal windows stand at the same distance from their anchors
    found = single.groupBy("lead", "w").agg(F.sum("c").alias("c"), F.min("at").alias("src")).where("c > 1")
    bit = F.expr("shiftleft(1L, i)")
    masks = single.select("lead", "w", "whole", "i", "at").join(found, ["lead", "w"]).groupBy("lead", "whole").agg(
        F.bit_or(bit).alias("dup"), F.bit_or(F.when(F.col("at") == F.col("src"), bit).otherwise(F.lit(0).cast("long"))).alias("own"), F.min("src.doc_id").alias("src"), F.first("at").alias("head")
    )
    ones = F.expr("CASE WHEN n >= 63 THEN -1L ELSE shiftleft(1L, n) - 1L END")
    plain = kinds.join(mixed, "lead", "left_anti").where("c > 1").select(
        "lead", "whole", ones.alias("dup"), ones.alias("own"), F.col("at.doc_id").alias("src"), F.col("at").alias("head"),
    )
    verdict = plain.unionByName(masks)
    # one verdict a stretch, so a row of twins meets one at most
    marked = twins.join(verdict, ["lead", "whole"]).select(
        "doc_id", "row", "places", "back", "dup", "own", "src", F.when(F.col("head.row") == F.col("row"), F.col("head.p")).alias("head"),
    )
    per = marked.groupBy("row", "doc_id").agg(F.collect_list(F.struct("places", "back", "dup", "own", "src", "head")).alias("m"))

    def spans(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for row, doc, m in zip(*(b.column(i).to_pylist() for i in range(3))):
                at = sorted(((p - x["back"], p == x["head"], x) for x in m for p in x["places"]), key=lambda y: y[0])
                for first in (True, False):
                    now = None
                    for begin, head, x in at:
                        own = x["own"] if head else 0
                        mask = x["dup"] & (own if first else ~own)
                        mask &= (1 << 64) - 1
                        while mask:
                            i = (mask & -mask).bit_length() - 1
                            mask &= mask - 1
                            s = begin + i
                            if now and s <= now[1]:
                                now[1] = s + shape.words
                            else:
                                if now:
                                    out.append((doc, row, now[0], now[1], first, now[2]))
                                now = [s, s + shape.words, x["src"]]
                    if now:
                        out.append((doc, row, now[0], now[1], first, now[2]))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()))],
                    names=["doc_id", "row", "start", "end", "first", "source_doc_id"],
                )

    return per.select("row", "doc_id", "m").mapInArrow(spans, "doc_id long, row long, start long, end long, first boolean, source_doc_id long")


def cut(t: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the given words (start, end; in order) and the white space after them."""
    words = [m.span() for m in _WORD.finditer(t)]
    out, at = [], 0
    for a, b in spans:
        out.append(t[at : words[a][0]])
        at = words[b][0] if b < len(words) else len(t)
    out.append(t[at:])
    return b"".join(out)


def remove_repeats(spark: SparkSession, docs: DataFrame, shape: Shape | None = None) -> DataFrame:
    """docs with every repeated passage cut from all texts but the first occurrence; n_chars, if there, is counted anew. No row is dropped."""
    spans = repeats(spark, docs, shape).where("NOT first").select("row", F.coalesce("doc_id", F.lit(NO_ID)).alias("who"), "start", "end")
    spans = spans.groupBy("row", "who").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = packed_rows(docs).join(spans, ["row", "who"], "left")

    @F.arrow_udf("string")
    def without(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut(t.encode(), [(x["start"], x["end"]) for x in s]).decode() for t, s in zip(text.to_pylist(), spans.to_pylist())], pa.string())

    # only rows with a repeat go through Python
    plain = joined.where("spans IS NULL").select("d.*")
    hit = joined.where("spans IS NOT NULL").select("d", without("d.text", "spans").alias("text"))
    new = F.col("d").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return plain.unionByName(hit.select(new.alias("d")).select("d.*"))
