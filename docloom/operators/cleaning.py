"""Text cleaning (CLN1-CLN7): Column expressions, each step usable alone; `clean` applies them in order. A null text becomes empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import count_matching, let, u_trim, u_words

# Words of user-interface lines. In strict parity "DEV AREALogout" stays one pattern.
UI_WORDS = ("No results found", "Resize table columns", "DEV AREALogout", "Back$", "Dashboard", "Blog Post", "Tagihan", "Ganti User", "Hak akses", "Close$")
UI_WORDS_SPLIT = tuple(x for w in UI_WORDS for x in (("DEV AREA", "Logout") if w == "DEV AREALogout" else (w,)))
# Characters that stand for misread dot leaders.
LEADER_NOISE = "oWc#nmaA»”rXkTeNlBKG"


def normalize(t: Column) -> Column:
    """CLN1: no-break spaces, NULs and line ends."""
    c = F.coalesce(t, F.lit(""))
    blank = u_trim(c) == ""
    c = F.regexp_replace(F.replace(F.replace(c, F.lit(" "), F.lit(" ")), F.lit("\u0000"), F.lit("")), "\r\n?", "\n")
    return F.when(blank, "").otherwise(c)


def dehyphenate(t: Column) -> Column:
    """CLN2: words broken by a hyphen at a line's end."""
    return F.regexp_replace(t, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def _keeps(s: Column, n: Column, words: Column, strict: bool) -> Column:
    """Whether a line stays, by its trimmed text, length and words; the cheap rules come first."""
    ui = "(?i)" + "|".join(UI_WORDS if strict else UI_WORDS_SPLIT).replace("$", r"\z")
    share = lambda count: count.cast("double") / n
    drop = (
        (n < 3)
        | ((F.size(words) > 4) & ((F.size(F.filter(words, lambda w: F.length(w) <= 2)).cast("double") / F.size(words)) > 0.65))
        | (share(count_matching(s, r"(?U)[\p{L}\p{N}\s.,;:()/\-]")) < 0.5)
        | (share(count_matching(s, r"[%&@#$^*_=<>~]")) > 0.3)
        | ((n > 30) & (share(count_matching(s, r"\p{L}")) < 0.15))
        | s.rlike(ui)
    )
    return F.when(n == 0, True).otherwise(~drop)


def keeps_line(line: Column, strict: bool = True) -> Column:
    """CLN3: whether a line stays. Blank lines do; a kept line isn't trimmed."""
    return let(u_trim(line), lambda s: let(F.struct(F.length(s).alias("n"), u_words(s).alias("w")), lambda x: _keeps(s, x["n"], x["w"], strict)))


def drop_garbage_lines(t: Column, strict: bool = True) -> Column:
    """CLN3 on every line. What rules ask of a line is computed once, in steps of their own."""
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.struct(x.alias("line"), u_trim(x).alias("s")))
    lines = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["s"].alias("s"), F.length(x["s"]).alias("n"), u_words(x["s"]).alias("w")))
    kept = F.filter(lines, lambda x: _keeps(x["s"], x["n"], x["w"], strict))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def drop_artifacts(t: Column) -> Column:
    """CLN4: page numbers, stamps and closing phrases of scans."""
    c = F.regexp_replace(t, r"(?md)^\s*-\s*\d+\s*-\s*$", "")
    c = F.regexp_replace(c, r"(?md)^\s*SALINAN\s*$", "")
    c = F.regexp_replace(c, r"(?imd)^\s*ttd\.?\s*$", "")
    return F.regexp_replace(c, r"(?isd)Salinan sesuai dengan aslinya.*?(?=\n\n|\z)", "")


def _leaders(line: Column) -> Column:
    """One line that holds two dots in a row."""

    def split(line: Column) -> Column:
        return let(F.regexp_extract(line, r"(?s)^(.*?)\.{2,}", 1), lambda prefix: judged(line, prefix, F.substring(line, F.length(prefix) + 1, F.length(line))))

    def judged(line: Column, prefix: Column, suffix: Column) -> Column:
        parts = F.struct(suffix.alias("suffix"), F.regexp_replace(suffix, r"[ .\t]", "").alias("odd"))
        return let(parts, lambda x: shown(line, prefix, x["suffix"], x["odd"]))

    def shown(line: Column, prefix: Column, suffix: Column, odd: Column) -> Column:
        noise = F.length(odd) - F.length(F.translate(odd, LEADER_NOISE, ""))
        bad = (F.length(odd) > 0) & (((noise.cast("double") / F.length(odd)) > 0.45) | suffix.rlike(r"(.)\1{3,}"))
        page = F.regexp_extract(suffix, r"(\d{1,3})\s*\z", 1)
        return F.when(bad, F.concat(prefix, let(page, lambda p: F.when(p != "", F.concat(F.lit(" "), p)).otherwise("")))).otherwise(line)

    return let(F.regexp_replace(line, r"\.{3,}\s*(\d{1,3})\z", " $1"), lambda x: F.when(x.contains(".."), split(x)).otherwise(x))


def clean_leaders(t: Column) -> Column:
    """CLN5: dot leaders of tables of contents and what was misread in them."""
    return F.array_join(F.transform(F.split(t, "\n", -1), lambda x: F.when(x.contains(".."), _leaders(x)).otherwise(x)), "\n")


def collapse(t: Column) -> Column:
    """CLN6."""
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), " {2,}", " ")


def trim_lines(t: Column) -> Column:
    """CLN7: every line, then the whole."""
    return u_trim(F.array_join(F.transform(F.split(t, "\n", -1), u_trim), "\n"))


def clean(t: Column, strict: bool = True) -> Column:
    return trim_lines(collapse(clean_leaders(drop_artifacts(drop_garbage_lines(dehyphenate(normalize(t)), strict)))))


def text_metrics(t: Column) -> dict[str, Column]:
    """AGG10: char, word and line counts and the share of noise characters in percent; zeros for an empty text."""
    c = F.coalesce(t, F.lit(""))
    n = F.length(c)
    noise = count_matching(c, r"""[^\p{L}\p{N}.,;:()/\-_?!'"\n\t ]""")
    empty = c == ""
    return {
        "char_count": n.cast("long"), "word_count": F.size(u_words(c)).cast("long"),
        "line_count": F.when(empty, 0).otherwise(count_matching(c, "\n") + 1).cast("long"), "noise_ratio": F.when(empty, F.lit(0.0)).otherwise(100.0 * noise / n),
    }
