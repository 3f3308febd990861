"""Token ids of whole texts for two kinds of vocabulary files of the tokenizers library.

Byte-level BPE files (the library's pattern, no normalizer) are merged by tiktoken over the file's own
vocabulary: the same ids, several times faster. Files that drop white space and end words with a suffix are encoded by the
tokenizers library itself, one space-delimited piece at a time with a memo bounded in bytes (texts that aren't composed, or hold a letter whose lower case
depends on its place, whole): no word of such a vocabulary
crosses white space, so a text's ids are its pieces' ids in order. Tests compare both with the library's encoding
of whole texts. A text that holds a string of the file's added tokens is split at it, as the library does by default: such texts go through the library
whole (`encoder`, for the operators). `load` alone takes these strings as ordinary text, unless asked for `added`.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .common import Memo

#: Fixed value: the word pattern of byte-level BPE files that have use_regex set.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Texts with this many white-space characters in a row go through the library.
BLANK = 50_000
_BLANKS = re.compile(r"\s{%d}" % BLANK)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class Added:
    """Texts that hold a string of the file's added tokens go through the library with its default settings, the others through `plain`."""

    def __init__(self, path: str, spec: dict, plain: ByteLevelEncoder | WordEncoder):
        if any(a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that are looked for in normalised text")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.plain, self.lib = path, plain, None
        self.marks = [a["content"] for a in spec["added_tokens"]]

    def _whole(self, t: str) -> np.ndarray:
        if self.lib is None:
            self.lib = Tokenizer.from_file(self.path)
        return np.array(self.lib.encode(t, add_special_tokens=False).ids, "<u2")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        held = [any(m in t for m in self.marks) for t in texts]
        rest = iter(self.plain.encode([t for t, h in zip(texts, held) if not h]))
        return [self._whole(t) if h else next(rest) for t, h in zip(texts, held)]


class ByteLevelEncoder:
    def __init__(self, path: str, spec: dict):
        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in back for c in token) and i < len(spec["model"]["merges"]) + 256}
        self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.path, self.lib = path, None

    def _one(self, t: str) -> np.ndarray:
        # the fast pattern engine gives up on white space of about a million characters in a row
        if len(t) > BLANK and _BLANKS.search(t):
            if self.lib is None:
                self.lib = Tokenizer.from_file(self.path)
                self.lib.encode_special_tokens = True
            return np.array(self.lib.encode(t, add_special_tokens=False).ids, "<u2")
        return np.array(self.fast.encode_ordinary(t), "<u2")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._one(t) for t in texts]


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.memo, self.base = Memo(), Memo()
        self.letters = {b: c for b, c in byte_letters().items()}

    def _word(self, w: str) -> bytes:
        """A lower-case word of letters is one word of the vocabulary's pattern; anything else goes through the whole library."""
        if w.isascii() and w.isalpha():
            return np.array([x.id for x in self.lib.model.tokenize(w)], "<u2").tobytes()
        if w.isalpha() and self.lib.normalizer.normalize_str(w) == w:
            return np.array([x.id for x in self.lib.model.tokenize("".join(map(self.letters.__getitem__, w.encode())))], "<u2").tobytes()
        return self._whole(w).tobytes()

    def _whole(self, t: str) -> np.ndarray:
        return np.array(self.lib.encode(t, add_special_tokens=False).ids, "<u2")

    def _learn(self, new: list[str]) -> None:
        """A comma or full stop after a letter or digit is a word of its own."""
        memo, base, held, more = self.memo, self.base, 0, 0
        for w in new:
            x, y = (w[:-1], w[-1]) if w[-1:] in (",", ".") and w[-2:-1].isalnum() else (w, "")
            ids = base.get(x)
            if ids is None:
                base[x] = ids = self._word(x)
                more += 4 * len(x) + len(ids) + 200
            if y:
                if y not in base:
                    base.put(y, self._word(y))
                ids += base[y]
            memo[w] = ids
            held += 4 * len(w) + len(ids) + 200
        memo.held += held
        base.held += more
        for w in new:
            if len(w) > base.longest:
                base.drop_long((w, w[:-1]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text, as unsigned 16-bit numbers."""
        memo, out = self.memo, []
        for t in texts:
            # lower case letter by letter, as the library does after composing; anything else is the library's
            if not (t.isascii() or (unicodedata.is_normalized("NFC", t) and "İ" not in t and "Σ" not in t)):
                out.append(self._whole(t))
                continue
            memo.room()
            self.base.room()
            ws = t.lower().replace("\n", " ").split(" ")
            new = [w for w in set(ws) if w not in memo]
            if new:
                self._learn(new)
            out.append(np.frombuffer(b"".join(map(memo.__getitem__, ws)), "<u2"))
            memo.drop_long(new)
        return out


def load(path: str, added: bool = False) -> ByteLevelEncoder | WordEncoder | Added:
    """The encoder of a file; with `added`, ids are those of the unmodified library also where texts hold its added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]) >= 1 << 16:
        raise ValueError("more ids than 16 bits hold")
    if added:
        plain = load(path)
        return Added(path, spec, plain) if spec["added_tokens"] else plain
    pre = spec["pre_tokenizer"]
    if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None:
        return ByteLevelEncoder(path, spec)
    split = [p for p in pre.get("pretokenizers", []) if p["type"] == "Split"]
    if len(split) == 1 and split[0]["invert"] and split[0]["behavior"] == "Removed" and spec["model"]["end_of_word_suffix"]:
        return WordEncoder(path)
    raise ValueError("a vocabulary of neither kind")


_have: dict[str, ByteLevelEncoder | WordEncoder | Added] = {}


def encoder(path: str) -> ByteLevelEncoder | WordEncoder | Added:
    """One encoder for each worker process."""
    if path not in _have:
        _have[path] = load(path, added=True)
    return _have[path]
