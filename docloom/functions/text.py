"""Text expressions with the Unicode rules of the reference semantics, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u_trim(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def u_words(c: Column) -> Column:
    """Words between white space (Unicode); an empty text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def count_matching(c: Column, cls: str) -> Column:
    """How many characters of c are in a character class."""
    return F.length(c) - F.length(F.regexp_replace(c, cls + "+", ""))


def let(value: Column, use) -> Column:
    """use(value), with value computed once: inside an expression, Spark computes what is written twice twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def contains_any(c: Column, words) -> Column:
    """Whether c contains any of some literal words."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def how_many(c: Column, words) -> Column:
    """How many of some literal words c contains."""
    out = F.lit(0)
    for w in words:
        out = out + F.when(c.contains(w), 1).otherwise(0)
    return out


def shortened(c: Column, n: int = 30) -> Column:
    """PRJ7: the first n code points and "...", if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def file_title(c: Column) -> Column:
    """PRJ8: a file name without any ".pdf"."""
    return F.replace(c, F.lit(".pdf"), F.lit(""))


def html_escape(c: Column) -> Column:
    """PRJ20: five characters as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unquote(c: Column) -> Column:
    """PRJ15: trimmed, without one pair of quotation marks around it; a lone mark becomes empty."""
    t = u_trim(c)
    return F.when(t.startswith('"') & t.endswith('"'), F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t)


def password_hash(c: Column) -> Column:
    """PRJ18: SHA-256 in hexadecimal."""
    return F.sha2(c, 256)


def log_level(c: Column) -> Column:
    """PRJ19: the kind of a progress line; success and errors end a job."""
    return F.when(c.contains("SUCCESS:"), "success").when(c.contains("CRITICAL ERROR") | c.contains("ERROR:"), "error").when(c.contains("Peringatan:"), "warning").otherwise("info")


def generation_error(c: Column) -> Column:
    """PRJ16: what the user is told when generation fails."""
    return F.when(
        c.contains("429") | c.contains("RESOURCE_EXHAUSTED"), "The language model is busy (rate limit). Please try again later.",
    ).otherwise(F.concat(F.lit("Generation failed: "), c))
