"""Rule bitmask ledger.

Every rule is evaluated once a document; the ledger keeps its measurements and one 64-bit mask of failed
rules. A policy is a named, versioned mask of rules and how many of them may fail; applying one is a bitwise AND over the
ledger, and an ablation (what each rule alone removes, what would come back without it) is bitwise
aggregation over the distinct masks, never a second look at the text.

Words are ``[^\\x20\\x09-\\x0D]+``. n_repeat_words counts word positions that lie in a 3-word window found twice or more in the text,
the first one included. Defined cases: very long texts are measured whole, in memory of some ten times their size; a null text has no words and fails the base rules; texts without
words have ratios of 0; rows are judged one by one, so repeated rows and ids get equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches

SYMBOLS = b"#*$%&|<>"

#: Rule names in bit order, and the SQL condition over the measurements under which a document fails.
RULES = {
    "too_few_words": "n_words < 50",
    "repeats_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols * 20 > n_words * 3",
    "dup_lines": "n_dup_lines > 2 AND n_dup_lines * 10 > n_lines * 3",
    "shouting": "n_upper_words * 2 > n_words",
    "exclaims": "n_bang_words * 5 > n_words",
    "long_words": "word_chars > 14 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "word_runs": "n_same_words * 10 > n_words",
}
BIT = {name: i for i, name in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_bang_words", "n_same_words")


@dataclass(frozen=True)
class Policy:
    """A version of which rules count and how many of them a kept document may fail."""

    name: str
    version: int
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeats_windows"))
STRICT = Policy("strict", 1, tuple(RULES))


def measure(t: bytes) -> tuple[int, ...]:
    """MEASURES of one text in UTF-8."""
    words = t.split()
    n = len(words)
    if not n:
        return (0,) * 9
    seen: set[bytes] = set()
    dup = lines = 0
    for line in t.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        count = Counter(windows)
        if len(count) < n - 2:
            end = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + 3 - max(end, i)
                    end = i + 3
    chars = sum(map(len, words)) if t.isascii() else len(b"".join(words).decode())
    return (
        n, chars, len(t) - len(t.translate(None, SYMBOLS)), dup, repeat, lines, sum(map(bytes.isupper, words)), sum(w.endswith(b"!") for w in words),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, the measurements (long) and fail_bits (long): one pass, no shuffle. The mask is computed on the JVM side."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                got = zip(*(measure(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in got)], names=["doc_id", *MEASURES])

    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)]))
    bits = " + ".join(f"IF({cond}, {1 << i}L, 0L)" for i, cond in enumerate(rules.values()))
    return measured.withColumn("fail_bits", F.expr(bits))


def keeps(policy: Policy):
    """Whether a ledger row is kept under a policy, as a column."""
    return F.bit_count(F.col("fail_bits").bitwiseAND(F.lit(policy.mask))) <= policy.allowed


def ablate(led: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: n_failed, n_failed_alone (lost to this rule only), n_kept_without (kept if the rule were dropped), n_kept.

    Rows are first summed per distinct mask (at most 2^rules of them), on the map side too.
    """
    masks = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in policy.rules)))
    hit, rest = "(m & bit) != 0", "bit_count(m & ~bit)"
    return masks.select("m", "n", rules.alias("r")).select("m", "n", "r.rule", "r.bit").groupBy("rule").agg(
        F.expr(f"coalesce(sum(n) FILTER (WHERE {hit}), 0L)").alias("n_failed"),
        F.expr("coalesce(sum(n) FILTER (WHERE m = bit), 0L)").alias("n_failed_alone"),
        F.expr(f"coalesce(sum(n) FILTER (WHERE {rest} <= {policy.allowed}), 0L)").alias("n_kept_without"),
        F.expr(f"coalesce(sum(n) FILTER (WHERE bit_count(m) <= {policy.allowed}), 0L)").alias("n_kept"),
    )


def op1(docs: DataFrame) -> DataFrame:
    led = ledger(docs)
    return led.select("doc_id", *MEASURES[:5], (~keeps(BASE)).alias("base_failed"), (keeps(BASE) & keeps(STRICT)).alias("kept"), "fail_bits", *MEASURES[5:])
