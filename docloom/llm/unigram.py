"""SentencePiece encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

`Pieces.from_file` reads a .model file's pieces, types, scores and normalizer flags. Unigram files have log
probabilities. BPE files have ranks in their place; there the pieces get Zipf log scores by rank, log(1 / (r + 2)) normalised, and
the best segmentation under them is this operator's result (it isn't the file's merge order).

The trie is over UTF-8 bytes, in two arrays: a state's child by byte b is at base[state] + b if check there names the state.
White space becomes the marker U+2581, with one put before the text if the file says so. A character that no
piece starts is unknown: it costs the least score less 10, and becomes its bytes' pieces if there are any, else the unknown id. Since no piece
has the marker after another character (checked on loading; else texts are encoded whole), the parts between markers are
encoded one by one, with a bounded memo. Decoding joins pieces, turns byte pieces back to bytes, markers to spaces, and takes off the first.

Defined cases: very long texts are encoded whole, part by part, and a text without white space in memory of some bytes a character;
null and empty texts have no pieces (a text is never given the leading marker alone); U+2581 in a text decodes to a space, the one loss there is;
repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, Memo

MARK = "▁"
#: Fixed values of the file format: piece types, model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
PENALTY = 10.0


def _fields(raw: bytes):
    """(number, wire type, value) of each field of a serialised message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = raw[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        yield key >> 3, kind, value


class Pieces:
    def __init__(self, pieces: list[tuple[str, float, int]], prefix: bool = True, squeeze: bool = False):
        self.pieces, self.prefix, self.squeeze = pieces, prefix, squeeze

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        with open(path, "rb") as f:
            raw = f.read()
        pieces, model, prefix, squeeze, charsmap = [], UNIGRAM, True, True, b""
        for number, _, value in _fields(raw):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                pieces.append((text, score, kind))
            elif number == 2:
                model = next((v for n, _, v in _fields(value) if n == 3), UNIGRAM)
            elif number == 3:
                for n, _, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        prefix = bool(v)
                    elif n == 4:
                        squeeze = bool(v)
        if charsmap:
            raise ValueError("files with a character map aren't supported")
        if model != UNIGRAM:
            order = sorted((i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)), key=lambda i: (-pieces[i][1], i))
            norm = math.log(sum(1 / (r + 2) for r in range(len(order))))
            for r, i in enumerate(order):
                # as 32-bit numbers, as the files store them
                pieces[i] = (pieces[i][0], float(np.float32(-math.log(r + 2) - norm)), pieces[i][2])
        return cls(pieces, prefix, squeeze)


class DoubleArray:
    """A byte trie in two arrays, built state by state from the sorted keys; value[state] is a key's number or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, v in keys.items():
            s = 0
            for b in k:
                if b not in children[s]:
                    children[s][b] = len(children)
                    children.append({})
                    ends.append(-1)
                s = children[s][b]
            ends[s] = v
        size = 1 << 12
        free = np.ones(size, bool)
        free[0] = False
        base, parent, value = (np.full(size, -1, np.int64) for _ in range(3))
        todo, low, width, reach = [(-len(children[0]), 0, 0)], 1, 0, 1
        while todo:  # states with most children first; those with one fill the gaps
            _, node, state = heapq.heappop(todo)
            value[state] = ends[node]
            kids = np.array(sorted(children[node]), np.int64)
            if not len(kids):
                continue
            # a class of equally many children goes on where its last one was placed
            if len(kids) != width:
                width, reach = len(kids), low
            at, found = max(low, reach), -1
            while found < 0:
                if at + 5000 > size:
                    free = np.concatenate([free, np.ones(size, bool)])
                    base, parent, value = (np.concatenate([x, np.full(size, -1, np.int64)]) for x in (base, parent, value))
                    size *= 2
                b = np.flatnonzero(free[at : at + 64 if len(kids) == 1 else at + 512]) + at - kids[0]
                b = b[b > 0]
                if len(kids) > 1:
                    b = b[free[b[:, None] + kids].all(1)]
                if len(b):
                    found = int(b[0])
                else:
                    at += 64 if len(kids) == 1 else 512
            reach = max(reach, at)
            free[found + kids] = False
            parent[found + kids] = state
            base[state] = found
            while not free[low]:
                low += 1
            for c in kids.tolist():
                k = children[node][c]
                heapq.heappush(todo, (-len(children[k]), k, found + c))
        # a state without children points where no child is
        base[base < 0] = size
        base, check, value = base.tolist(), parent.tolist() + [-1] * (size + 256), value.tolist()
        self.base, self.check, self.value = base, check, value

    def prefixes(self, key: bytes, at: int = 0):
        """(end, number) of each stored key that starts at `at`."""
        s, base, check, value = 0, self.base, self.check, self.value
        for i in range(at, len(key)):
            n = base[s] + key[i]
            if check[n] != s:
                return
            s = n
            if value[s] >= 0:
                yield i + 1, value[s]


class Unigram:
    def __init__(self, model: Pieces, trie: DoubleArray | None = None):
        self.model, self.memo, self.base = model, Memo(), Memo()
        ps = model.pieces
        self.trie = trie or DoubleArray({t.encode(): i for i, (t, _, k) in enumerate(ps) if k in (NORMAL, USER) and t})
        top = max((s for _, s, k in ps if k == NORMAL), default=0.0)
        # a piece that the file's user defined wins over any split of it
        self.score = [s if k != USER else len(t.encode()) * top + 0.1 for t, s, k in ps]
        self.worst = min((s for _, s, k in ps if k == NORMAL), default=0.0) - PENALTY
        self.bytes = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(ps) if k == BYTE}
        self.back = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, p in enumerate(ps) if p[2] == UNKNOWN), 0)
        self.splits = not any(MARK in t.lstrip(MARK) for t, _, k in ps if k in (NORMAL, USER))
        # a text may be cut between two characters that no piece has next to each other
        self.glued = {t[i : i + 2] for t, _, k in ps if k in (NORMAL, USER) for i in range(len(t) - 1)}
        self.lines = self.splits and not any("\n" in t for t, _, k in ps if k in (NORMAL, USER))

    def viterbi(self, t: str) -> list[int]:
        """Ids of the best segmentation; on equal scores the piece that was reached first, from shorter to longer."""
        raw = t.encode()
        n = len(raw)
        best, came, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        at = 0
        while at < n:
            b = raw[at]
            width = 1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4
            here, s, single = best[at], 0, False
            for i in range(at, n):
                x = base[s] + raw[i]
                if check[x] != s:
                    break
                s = x
                v = value[s]
                if v >= 0:
                    if i + 1 - at == width:
                        single = True
                    c = here + score[v]
                    if c > best[i + 1]:
                        best[i + 1], came[i + 1], piece[i + 1] = c, at, v
            if not single:
                c = here + self.worst
                if c > best[at + width]:
                    best[at + width], came[at + width], piece[at + width] = c, at, -1
            at += width
        out: list[int] = []
        while n:
            p = piece[n]
            if p >= 0:
                out.append(p)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(raw[came[n] : n])]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # a run of unknown characters is one
            n = came[n]
        return out[::-1]

    def _parts(self, t: str) -> list[str]:
        if self.model.squeeze:
            t = re.sub(" +", " ", t.strip(" "))
            if not t:
                return []
        t = (MARK if self.model.prefix else "") + t.replace(" ", MARK)
        if not self.splits:
            return [t]
        if MARK * 2 in t:
            return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", t)
        if self.lines and "\0" not in t and self.bytes:
            return t.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0")
        return t.replace(MARK, "\0" + MARK).split("\0") if "\0" not in t else re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", t)

    def _part(self, w: str) -> bytes:
        """A last comma or full stop apart, where that is exact: the rest is more often known."""
        base = self.base
        parts = (w[:-1], w[-1]) if w[-1:] in (",", ".") and len(w) > 2 and w[-2:] not in self.glued else (w,)
        for k in parts:
            if k not in base:
                base.put(k, np.array(self.viterbi(k), "<u4").tobytes())
        return b"".join(map(base.__getitem__, parts))

    def encode(self, t: str) -> np.ndarray:
        """The ids of a whole text."""
        if not t:
            return np.empty(0, "<u4")
        memo, base = self.memo, self.base
        memo.room()
        parts = self._parts(t)
        new = [w for w in set(parts) if w not in memo]
        for w in new:
            base.room()
            memo.put(w, self._part(w))
            base.drop_long((w, w[:-1]))
        out = np.frombuffer(b"".join(map(memo.__getitem__, parts)), "<u4")
        memo.drop_long(new)
        return out

    def decode(self, ids: np.ndarray) -> str:
        if not hasattr(self, "_raw"):
            self._raw = [p[0].replace(MARK, " ").encode() if p[2] in (NORMAL, USER) else bytes([self.back[i]]) if p[2] == BYTE else b"" if p[2] == CONTROL else b" \xe2\x81\x87 " for i, p in enumerate(self.model.pieces)]
        t = b"".join(map(self._raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return t[1:] if self.model.prefix and t[:1] == " " else t


_have: dict[str, Unigram] = {}


def encoder(path: str) -> Unigram:
    """One encoder for each worker process."""
    if path not in _have:
        _have[path] = Unigram(Pieces.from_file(path))
    return _have[path]


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (32-bit ids), round_trip (decoding gives the text back), and the ids if asked for. One pass, no shuffle."""

    built = encoder(path)
    # bounded by the vocabulary; built once, on the driver
    tables = spark.sparkContext.broadcast((built.model, built.trie))

    def run(batches: Batches) -> Batches:
        if path not in _have:
            _have[path] = Unigram(*tables.value)
        enc = _have[path]
        byte_ids = np.array(sorted(enc.back), np.uint32)
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for t in b.column(1).to_pylist():
                ids = enc.encode(t or "")
                n_bytes = int(((ids >= byte_ids[0]) & (ids <= byte_ids[-1])).sum()) if len(byte_ids) else 0
                out.append((len(ids), n_bytes, zlib.crc32(ids), enc.decode(ids) == (t or ""), *[ids] * keep_ids))
            c = list(zip(*out))
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.bool_())]
            names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]
            if keep_ids:
                cols.append(pa.array([x.astype(np.int32) for x in c[4]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
