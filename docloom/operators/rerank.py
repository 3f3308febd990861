"""Rule-based rescoring (PRJ1-PRJ5) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_any, how_many, u_words

# Words that ask for a time, names of months, words of calendars.
TIME_WORDS = ("tanggal", "kapan", "jadwal", "batas", "bulan", "tahun", "hari", "deadline", "date", "schedule", "when")
MONTHS = ("januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember")
CALENDAR = ("jadwal", "tanggal", "kalender", "herregistrasi", "registrasi")


def time_intent(query: Column) -> Column:
    return contains_any(F.lower(query), TIME_WORDS)


def term_hits(query: Column, content: Column) -> Column:
    """How many query words of over two characters the content contains, repeated ones each time."""
    low = F.lower(content)
    return F.size(F.filter(u_words(F.lower(query)), lambda w: (F.length(w) > 2) & low.contains(w)))


def boost(query: Column, content: Column, months=MONTHS, calendar=CALENDAR) -> Column:
    low = F.lower(content)
    timed = F.when(contains_any(low, months), 0.15).otherwise(0.0) + 0.05 * how_many(low, calendar)
    return F.when(time_intent(query), timed).otherwise(0.0) + 0.02 * term_hits(query, content)


def rescored(query: Column, content: Column, score: Column, months=MONTHS, calendar=CALENDAR) -> Column:
    """The score with all boosts, rounded to 6 digits so that thresholds don't depend on the order of additions."""
    return F.round(score + boost(query, content, months, calendar), 6)
