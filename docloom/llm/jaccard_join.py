"""Exact set-similarity self-join on word shingles with token-combination prefixes, and the classes it links.

Two documents link when their shingle sets have Jaccard similarity num/den or more. The steps, none of which drops a link:

1. Equal sets are one class (a 128-bit hash of the sorted 64-bit shingle hashes), so exact copies cost one row.
2. Tokens (shingles) are ordered rarest first, those in one class only coming before all others. A pair
   at the threshold t shares a token among the first n - ceil(t n) + 1 of either set, so a class with that many tokens of its own
   has no partner. Its own tokens are counted on a fixed share of the token space (2 (1 - t)): a lower
   bound, so leaving a class out is proven. For the classes left it is then counted on all tokens. Every map batch sends a token once: with its class, or
   as shared, so a token of a third of all documents costs one entry a batch.
3. Merging by sketches: entries are the `sketch` least hashes of each prefix, and each has a leader, in the first round its most central class, in further ones a random one.
   Each class is compared with the leader that it may be most like, until few comparisons link. Parity sketches of 1,024 bits say which pairs can't link (each bit that differs is a
   token that one has and the other hasn't) and how alike the others may be.
   Components make most of a group of near copies one, and links inside a component needn't be found again.
4. Tokens of one component only now count as its own. Document frequencies of the others are counted exactly, and prefixes are extended by
   B tokens: a pair then shares B + 1 of them. Rare tokens (up to `frequent` classes) are indexed alone. If a pair shares no rare one, two of its B + 1 frequent
   ones fall into the same of B groups of tokens, so combinations of two frequent tokens are indexed within groups. B is a power of two in step with the prefix, so
   long sets have few combinations as well; sets near a border between two values of B are indexed under both.
5. Entries that hold more than one component are merged like the sketches, in rounds of one comparison a class. In those
   that still do, and of entries with the same classes in only one, classes outside the entry's first component are compared with all others of other components that they
   may link with by length, by the positions of the shared tokens and by parity sketches.
6. Candidates are verified on the whole sets.

Defined cases: texts with fewer words than a shingle are one shingle, the whole sequence; null texts and texts without words have an empty set,
link with nothing and are their own component; very long texts have long sets, held whole one at a time; rows that share a doc_id are separate rows (a component's id is the
smallest doc_id in it, null only if it has no other); repeated rows are one class; ties between equal documents go by doc_id, then by a hash of the
row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Batches, drop_table, finished, groups, id_filter, identified, lean, materialise, mix, rows_in, rows_of, texts
from .components import components, partly

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: Rows of whole sets in an Arrow batch.
ROWS = 2000


#: 64-bit words of a parity sketch.
WORDS = 16


def parity(s: np.ndarray) -> np.ndarray:
    """The parity sketch of a set of hashes: whether an odd number of them falls on each of its bits."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


class _Hashes(dict):
    """The 64-bit hash of each word; emptied when large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Hashes()


def word_hashes(t: bytes) -> np.ndarray:
    return np.array(list(map(_words.__getitem__, t.split())), np.uint64)


def shingle_set(t: bytes, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, A-Z lower-cased."""
    w = word_hashes(t.lower())
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ (w[i : len(w) - k + 1 + i])) * _A
            h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


class Join:
    """Parameters of one join and the bounds that follow from them."""

    def __init__(self, width: int = 5, num: int = 80, den: int = 100, frequent: int = 64, sketch: int = 16):
        self.width, self.num, self.den, self.frequent, self.sketch = width, num, den, frequent, sketch
        self.share = min(256, 512 * (den - num) // den + 1)  # of 256: the part of the token space on which own tokens are counted

    def prefix(self, n: int) -> int:
        return n - _ceil(self.num * n, self.den) + 1

    def furthest(self, n: int, pos: int) -> int:
        """The largest partner that a class of n tokens can have when the first token they share is at pos."""
        return min(((self.den + self.num) * (n - pos) - self.num * n) // self.num, self.den * n // self.num)

    def spread(self, n: int) -> int:
        """The number B of token groups for sets of n tokens: about a quarter of the prefix, and less than linked sets share."""
        return 1 << max(0, min(self.prefix(n) // 4, _ceil(self.num * n, self.den) - 1).bit_length() - 1)

    def may_link(self, n: str, m: str, x: str, y: str) -> str:
        """The SQL condition that sets of n and m tokens with sketches x and y may link: by their sizes, and by how many tokens one has and the other hasn't.

        Each bit where the sketches differ is such a token at least.
        """
        differ = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(WORDS))
        sizes = f"{self.num} * greatest({n}, {m}) <= {self.den} * least({n}, {m})"
        return f"{sizes} AND (cast({n} + {m} as bigint) - ({differ})) * {self.den + self.num} >= {2 * self.num} * cast({n} + {m} as bigint)"

    def spreads(self, n: int) -> list[int]:
        """Every B that n or a partner of n may have."""
        low, high = self.spread(max(1, _ceil(self.num * n, self.den))), self.spread(self.den * n // self.num)
        return [1 << i for i in range(low.bit_length() - 1, high.bit_length())]


def _asks(own: list[np.ndarray], tags: np.ndarray, parts: int) -> pa.RecordBatch:
    """The tokens of some classes, packed by part of the token space: each token once, with the place of its class's tag in a list, or 0 if several have it."""
    tok = np.concatenate(own)
    tag = np.repeat(tags, [len(x) for x in own])
    order = np.argsort(tok)
    tok, tag = tok[order], tag[order]
    first = np.concatenate([[True], tok[1:] != tok[:-1]])
    count = np.diff(np.append(np.flatnonzero(first), len(tok)))
    tok, tag = tok[first], np.where(count > 1, np.uint64(0), tag[first])
    part = ((tok >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int32)
    cut = np.searchsorted(part, np.arange(parts + 1))
    full, asks = [], []
    for k, (i, j) in enumerate(zip(cut, cut[1:])):
        if i < j:
            u, at = np.unique(tag[i:j], return_inverse=True)
            low = ((tok[i:j] >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            full.append(k)
            asks.append(np.array([j - i, len(u)], "<u4").tobytes() + u.tobytes() + low.tobytes() + at.astype("<u2" if len(u) < 65536 else "<u4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(asks, pa.binary())], names=["part", "ask"])


def _sets(join: Join, parts: int):
    """Rows of two kinds: the class and set size of each document, and what a batch asks of each part of the token space."""
    kinds = [
        ("part", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("who", pa.int64()), ("node", pa.binary()), ("n", pa.int32()),
        ("ask", pa.binary()),
    ]
    schema = pa.schema(kinds)

    def rows(many: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(many, t) for k, t in kinds], schema=schema)

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            nodes, sizes, own, tags = [], [], [], []
            seen: set[bytes] = set()
            for t in texts(b):
                s = shingle_set(t, join.width)
                node = xxhash.xxh3_128_digest(s) if len(s) else None
                nodes.append(node)
                sizes.append(len(s))
                if node is not None and node not in seen and len(s) * (join.den - join.num) >= join.num:
                    seen.add(node)
                    own.append(s[(s & np.uint64(255)) < join.share])
                    tags.append(np.frombuffer(node, "<u8", 1)[0])
            ids = {c: b.column(b.schema.get_field_index(c)) for c in ("doc_id", "row", "who")}
            yield rows(len(nodes), **ids, node=pa.array(nodes, pa.binary()), n=pa.array(sizes, pa.int32()))
            if own:
                a = _asks(own, np.array(tags, np.uint64), parts)
                yield rows(a.num_rows, part=a.column(0), ask=a.column(1))

    return run, "part int, doc_id long, row long, who long, node binary, n int, ask binary"


def _all_asks(parts: int):
    """What whole sets (id, toks) ask; tags are id + 1."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            offs, v = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy().view(np.uint64)
            tags = b.column(0).to_numpy().astype(np.uint64) + np.uint64(1)
            # a million tokens at a time, and whole sets
            cuts = np.unique(np.searchsorted(offs, np.append(np.arange(offs[0], offs[-1], 1_000_000), offs[-1])))
            for x, y in zip(cuts, cuts[1:]):
                yield _asks([v[i:j] for i, j in zip(offs[x:y], offs[x + 1 : y + 1])], tags[x:y], parts)

    return run, "part int, ask binary"


def _count_own(asks: DataFrame, ways: int) -> DataFrame:
    """(tag, own): how many of the asked tokens each class has to itself."""
    counted = asks.groupBy("part").applyInArrow(lambda t: _own_tokens(t, ways), "way int, tags binary, own binary")
    return counted.groupBy("way").applyInArrow(_sum_own, "tag long, own long")


def _own_tokens(table: pa.Table, ways: int) -> pa.Table:
    """Packed by `way`, the residue of the class: how many tokens of one part of the token space each class has to itself. Tokens equal in 32 further bits count as shared: never too many."""
    tok, tag = [], []
    for raw in table["ask"].to_pylist():
        n, u = (int(x) for x in np.frombuffer(raw, "<u4", 2))
        names = np.frombuffer(raw, "<u8", u, 8)
        tok.append(np.frombuffer(raw, "<u4", n, 8 + 8 * u))
        tag.append(names[np.frombuffer(raw, "<u2" if u < 65536 else "<u4", n, 8 + 8 * u + 4 * n)])
    tok, tag = np.concatenate(tok), np.concatenate(tag)
    order = np.argsort(tok)
    tok, tag = tok[order], tag[order]
    at = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    lo, hi = np.minimum.reduceat(tag, at), np.maximum.reduceat(tag, at)
    who, n = np.unique(lo[(lo == hi) & (lo != 0)], return_counts=True)
    way = (who % np.uint64(ways)).astype(np.int32)
    order = np.argsort(way, kind="stable")
    who, n, way = who[order], n[order].astype("<u4"), way[order]
    cut = np.searchsorted(way, np.arange(ways + 1))
    full = [i for i in range(ways) if cut[i] < cut[i + 1]]
    return pa.table({
        "way": pa.array(full, pa.int32()), "tags": pa.array([who[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
        "own": pa.array([n[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
    })


def _sum_own(table: pa.Table) -> pa.Table:
    """The packed counts of some classes, summed over all parts of the token space."""
    who, at = np.unique(np.frombuffer(b"".join(table["tags"].to_pylist()), "<u8"), return_inverse=True)
    n = np.bincount(at, np.frombuffer(b"".join(table["own"].to_pylist()), "<u4"), len(who))
    return pa.table({"tag": pa.array(who.view(np.int64)), "own": pa.array(n.astype(np.int64))})


def _entries(join: Join, n: int, df: np.ndarray, tok: np.ndarray):
    """Keys and largest partners of one class of n tokens, given those it shares with other components, rarest first."""
    own, keys, far = n - len(df), [], []
    basic = max(0, join.prefix(n) - own)
    rare = int(np.searchsorted(df, join.frequent, "right"))
    alone = len(df) if join.num * n <= join.den else rare  # sets that may share a single token have no combination
    for i in range(min(alone, basic)):
        keys.append(tok[i : i + 1])
        far.append([join.furthest(n, own + i)])
    # the first shared token is in the basic prefix; if it is frequent, so are all others
    for spread in join.spreads(n) if rare < basic else ():
        u = tok[rare : basic + spread].view(np.uint64)
        group = (u >> np.uint64(20)) & np.uint64(spread - 1)
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            if len(at) > 1:
                x, y = np.triu_indices(len(at), 1)
                keys.append(mix(mix(u[at[x]] + np.uint64(spread)) ^ u[at[y]]).view(np.int64))
                # of B + 1 shared tokens, the first that shares its group with another is the B-th at the latest
                far.append([join.furthest(n, own + rare + max(0, int(p) - spread + 1)) for p in at[x]])
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, far = np.concatenate(keys), np.concatenate(far).astype(np.int64)
    fits = join.den * far >= join.num * n
    return keys[fits], far[fits]


def _index(join: Join):
    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            ids, sizes, rest = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            offs = rest.offsets.to_numpy()
            df, tok = (rest.values.field(i).to_numpy() for i in range(2))
            got = [_entries(join, int(n), df[i:j], tok[i:j]) for n, i, j in zip(sizes, offs, offs[1:])]
            m = [len(k) for k, _ in got]
            keys, far = (np.concatenate(c) for c in zip(*got))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys), pa.array(np.repeat(ids, m)), pa.array(np.repeat(sizes, m)), pa.array(far.astype(np.int32)),
                    b.column(3).take(pa.array(np.repeat(np.arange(len(m)), m))),
                ],
                names=["key", "id", "n", "far", "bits"],
            )

    return run, "key long, id long, n int, far int, bits array<bigint>"


def _verify(spark: SparkSession, join: Join, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            keep = []
            x, y = b.column(2), b.column(3)
            xo, yo, xv, yv = x.offsets.to_numpy(), y.offsets.to_numpy(), x.values.to_numpy(), y.values.to_numpy()
            for i in range(b.num_rows):
                p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                same = len(np.intersect1d(p, q, assume_unique=True))
                if join.den * same >= join.num * (len(p) + len(q) - same):
                    keep.append(i)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    kept = id_filter(spark, sets.select("id", "toks"), ends, "id")
    side = lambda end, toks: kept.select(F.col("id").alias(end), F.col("toks").alias(toks))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(lean(run), "a long, b long")


def _named(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries with the component of their class."""
    return entries.join(comp.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def _merge(
    spark: SparkSession, join: Join, entries: DataFrame, comp: DataFrame | None, links: list[DataFrame], sets: DataFrame, enough: str,
    central: bool, few: int = 5,
):
    """Compare classes with others of other components, round by round; returns what entries still hold several components, and the components.

    entries: key, id, n, far, bits (and weight if the first round goes by it). In each round an entry has one leader, and each class is verified against the leader that it may
    be most like, by sketches, of those it shares as many entries c with as `enough` says. Rounds end when one gives less than a link for `few` comparisons, its own or the first round's.
    """
    held, begun = entries, None
    columns = ["key", "id", "n", "far", "bits"]
    for turn in itertools.count():
        named = held.withColumn("comp", F.col("id")) if comp is None else _named(held, comp)
        weight = F.col("weight") if central and not turn else F.xxhash64("id", "key", F.lit(turn))
        lead = named.groupBy("key").agg(
            F.min(F.struct(weight.alias("w"), "id", "n", "far", "comp", "bits")).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        ).where("lo <> hi")
        lead = lead.select(
            "key", F.col("l.id").alias("b"), F.col("l.n").alias("m"), F.col("l.far").alias("far_b"), F.col("l.comp").alias("comp_b"),
            F.col("l.bits").alias("bits_b"),
        )
        mixed = named.join(lead, "key").withColumn("may", F.expr(f"comp <> comp_b AND m <= far AND n <= far_b AND {join.may_link('n', 'm', 'bits', 'bits_b')}"))
        alike = F.when(F.col("may"), F.expr("-(" + " + ".join(f"bit_count(bits[{i}] ^ bits_b[{i}])" for i in range(WORDS)) + ") / (n + m)"))
        met = materialise(spark, mixed.select(*columns, "b", alike.alias("alike")), "met")
        if turn:
            drop_table(spark, held)
        held = met.select(*columns)
        pairs = met.where("alike IS NOT NULL").groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.max("alike").alias("alike"))
        pairs = pairs.where(enough).groupBy("a").agg(F.max(F.struct("alike", "c", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        pairs = materialise(spark, pairs, "pairs")
        tried = rows_of(spark, pairs)
        if not tried:
            drop_table(spark, pairs)
            return held, comp
        new = materialise(spark, _verify(spark, join, pairs, sets), "new-links", ROWS)
        found = rows_of(spark, new)
        drop_table(spark, pairs)
        if found:
            links.append(new)
            old, comp = comp, partly(spark, _all(links), "components")
            if old is not None:
                drop_table(spark, old)
        begun = tried if begun is None else begun
        if found * few < max(tried, begun):
            return held, comp


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out


def link(spark: SparkSession, docs: DataFrame, join: Join) -> DataFrame:
    """One row per row of docs: doc_id, row and who (see common.identified), n_shingles, component_id, first (whether the row stands for its component)."""
    src = identified(docs)
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = groups(size / 6 * join.share / 256, 1_500_000)
    run, schema = _sets(join, parts)
    made = materialise(spark, src.mapInArrow(lean(run), schema), "sets", 2 * ROWS)
    meta = materialise(spark, made.where("part IS NULL").select("doc_id", "row", "who", "node", "n"), "rows")
    # the 8 bytes that tell classes apart in the counts, read as one number
    swap = "".join(f"substr(hex(node), {i}, 2), " for i in range(15, 0, -2)).rstrip(", ")
    classes = (
        meta.where("n > 0").groupBy("node").agg(
            F.first("n").alias("n"), F.count("*").alias("size"), F.min("doc_id").alias("low"),
            F.min(F.struct(F.col("doc_id").isNull().alias("x"), "who", "row")).alias("rep"),
        )
        .select(
            F.monotonically_increasing_id().alias("id"), "node", "n", "size", "low", "rep.who", "rep.row",
            F.expr(f"cast(conv(concat({swap}), 16, -10) as long)").alias("tag"),
        )
    )
    classes = materialise(spark, classes, "classes")  # ids are fixed by being written
    ways = groups(rows_of(spark, docs), 250_000)
    own = _count_own(made.where("part IS NOT NULL").select("part", "ask"), ways)
    prefix_sql = f"cast(n - ceil({join.num} * n / {join.den}D) + 1 as int)"
    alike = F.count("*").over(Window.partitionBy("tag"))  # classes with one tag can't tell whose tokens were counted
    live = classes.join(own, "tag", "left").withColumn("own", F.when(alike == 1, F.coalesce("own", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    live = live.where(f"n * {join.den - join.num} >= {join.num} AND own < {prefix_sql}").select(
        "id", "who", "row", "own", F.least("size", F.lit((1 << 20) - 1)).alias("size"),
    )
    live = materialise(spark, live, "live")
    finished(spark, made)

    def whole(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                got = [shingle_set(t, join.width) for t in texts(b)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array([len(g) for g in got], pa.int32()), pa.array([g.view(np.int64) for g in got], pa.list_(pa.int64())), b.column(2),
                        pa.array([parity(g) for g in got], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "toks", "weight", "bits"],
                )

    texts_of = id_filter(spark, src.select("row", "who", "text"), live, "row").join(live, ["row", "who"]).dropDuplicates(["row", "who"])
    # a leader has fewest tokens of its own, then most copies: what near copies were made from, rather than one of them
    texts_of = texts_of.select("id", "text", F.expr("own * 1048576 - size").alias("weight"))
    first = materialise(spark, texts_of.mapInArrow(lean(whole), "id long, n int, toks array<bigint>, weight long, bits array<bigint>"), "live-sets", ROWS)
    # the same count over all tokens of the classes left
    total = first.agg(F.sum("n").cast("long")).first()[0] or 0
    run, schema = _all_asks(groups(total, 1_500_000))
    own = _count_own(
        first.select("id", "toks").mapInArrow(lean(run), schema), groups(rows_of(spark, first), 250_000),
    ).select((F.col("tag") - 1).alias("id"), "own")
    left = materialise(spark, first.select("id", "n").join(own, "id", "left").where(f"coalesce(own, 0) < {prefix_sql}").select("id"), "left", 2 * ROWS)
    sets = materialise(spark, id_filter(spark, first, left, "id").join(left, "id"), "left-sets")
    finished(spark, first, left)

    # any order of tokens serves for merging: the standard prefix by hash
    quick = sets.select(
        "id", "n", "weight", F.explode(F.expr(f"slice(toks, 1, least({join.sketch}, {prefix_sql}))")).alias("key"),
        F.expr(f"cast({join.den} * n div {join.num} as int)").alias("far"), "bits",
    )
    links: list[DataFrame] = []
    held, comp = _merge(spark, join, quick, None, links, sets, f"4 * c >= least({join.sketch}, {prefix_sql})", True)
    finished(spark, held)

    named = sets.select("id", "toks")
    named = (_named(named, comp) if comp is not None else named.withColumn("comp", F.col("id"))).select("id", "comp", F.explode("toks").alias("tok"))
    flat = materialise(spark, named, "tokens")
    df = flat.groupBy("tok").agg(
        F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
    ).where("lo <> hi").select("tok", F.col("df").cast("int").alias("df"))
    ordered = flat.select("tok", "id").join(df, "tok").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("rest"))
    run, schema = _index(join)
    index = materialise(spark, ordered.join(sets.select("id", "n", "bits"), "id").select("id", "n", "rest", "bits").mapInArrow(lean(run), schema), "index", ROWS)
    finished(spark, flat)

    held, comp = _merge(spark, join, index, comp, links, sets, "c > 0", False)
    finished(spark, index)
    last = held
    held = _named(held, comp) if comp is not None else held.withColumn("comp", F.col("id"))
    # keys held by the same classes ask for the same pairs: they become one list, named by its classes (a name shared by chance only adds candidates)
    h = F.xxhash64("id")
    name = F.xxhash64(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(F.lit(1), "id")), F.min("id"), F.max("id"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), name.alias("list")).where("lo <> hi").select("key", "lo", "list")
    lists = held.join(mixed, "key").groupBy("list", "lo", "id").agg(F.max("far").alias("far"), F.first("n").alias("n"), F.first("comp").alias("comp"), F.first("bits").alias("bits"))
    lists = materialise(spark, lists, "lists")
    x = lists.where("comp <> lo").select("list", "lo", F.col("id").alias("a"), "n", F.col("far").alias("fa"), F.col("comp").alias("ca"), "bits")
    y = lists.select("list", "lo", F.col("id").alias("b"), F.col("n").alias("m"), F.col("far").alias("fb"), F.col("comp").alias("cb"), F.col("bits").alias("bits_b"))
    rest = x.join(y, ["list", "lo"]).where(f"ca <> cb AND m <= fa AND n <= fb AND {join.may_link('n', 'm', 'bits', 'bits_b')}")
    rest = materialise(spark, rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
    if rows_of(spark, rest):
        links.append(materialise(spark, _verify(spark, join, rest, sets), "new-links", ROWS))
    if links:
        comp = components(spark, _all(links), "components")
    finished(spark, last, lists, rest, sets, live, *links)
    low = classes.select("id", "node", "low", "row", "who")
    low = _named(low, comp) if comp is not None else low.withColumn("comp", F.col("id"))
    best = low.groupBy("comp").agg(F.min(F.struct(F.col("low").isNull().alias("x"), "low", "who", "row")).alias("best"))
    by_class = low.join(best, "comp").select(
        "node", F.col("best.low").alias("component_id"), F.col("best.row").alias("best"), F.col("best.who").alias("best_who"),
    )
    out = meta.join(by_class, "node", "left")
    alone = F.col("node").isNull()
    first = alone | ((F.col("row") == F.col("best")) & (F.col("who") == F.col("best_who")))
    return out.select(
        "doc_id", "row", "who", F.col("n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), first.alias("first"),
    )


def first_documents(spark: SparkSession, docs: DataFrame, join: Join) -> DataFrame:
    """One row of docs for each group of linked ones, all columns as they were."""
    return rows_in(docs, link(spark, docs, join).where("first"))
