"""Document catalog (JN3, FLT7, PRJ10): files of a folder beside what the store holds of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_title


def shown_date(c: Column) -> Column:
    """PRJ10: day, short month and year in the session's time zone."""
    return F.date_format(c, "dd MMM yyyy")


def catalog(files: DataFrame, stored: DataFrame) -> DataFrame:
    """title, file, date, status of each file (file, modified); stored: (document_id, source_file). Store documents without a file are left out."""
    have = stored.select(F.col("source_file").alias("file"), F.lit(True).alias("have")).distinct()
    return files.join(have, "file", "left").select(
        file_title(F.col("file")).alias("title"), "file", F.coalesce(shown_date(F.col("modified")), F.lit("-")).alias("date"),
        F.when(F.col("have"), "Ready").otherwise("Proses").alias("status"),
    )


def search(rows: DataFrame, keyword: str) -> DataFrame:
    """FLT7: rows with the keyword in title or file, in any case."""
    k = keyword.lower()
    return rows.where(F.lower("title").contains(k) | F.lower("file").contains(k))
