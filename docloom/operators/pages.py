"""Page-wise text extraction (SRC4, ING1-ING10): one row per page after decoding, so that long documents spread over tasks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import u_trim
from ..sources.providers import PageDecoder


# The least share of ruled pixels of a kind of page.
RULED = ((0.005, "table"), (0.002, "mixed"))


def page_type(ratio: Column) -> Column:
    """ING1: by the share of pixels on long ruled lines."""
    out = F.lit("text")
    for least, kind in reversed(RULED):
        out = F.when(ratio > least, kind).otherwise(out)
    return out


def psm_for(kind: Column, s: Settings = Settings()) -> Column:
    """ING2: the layout mode of the text recogniser."""
    return F.when(kind == "table", s.psm_table).when(kind == "mixed", s.psm_mixed).otherwise(s.psm_text)


def fold(pages: DataFrame, key: str, number: str = "page_num", text: str = "text") -> DataFrame:
    """ING7: (key, text, page_count): trimmed page texts in page order, a blank line between them; empty pages count but add nothing."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), u_trim(F.coalesce(text, F.lit(""))).alias("t"))))
    return pages.groupBy(key).agg(rows.alias("p")).select(
        key, F.array_join(F.transform(F.filter("p", lambda x: x.t != ""), lambda x: x.t), "\n\n").alias("text"),
        F.size("p").cast("long").alias("page_count"),
    )


def decode(files: DataFrame, make: Callable[[], PageDecoder], s: Settings = Settings(), page: int | None = None) -> DataFrame:
    """SRC4: path, page_num (from 1), image, error; a file that can't be decoded is one row with its error (ING10). With `page`, only that page of each file (TOP7)."""

    def run(batches):
        decoder = make()
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out += [(path, i, p, None) for i, p in enumerate(decoder.pages(content, s.dpi), 1) if page in (None, i)]
                except Exception as e:  # one file's failure leaves the others alone
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(c, (pa.string(), pa.int32(), pa.binary(), pa.string()))],
                    names=["path", "page_num", "image", "error"],
                )

    return files.select("path", "content").mapInArrow(run, "path string, page_num int, image binary, error string")


def recognised(pages: DataFrame, make: Callable[[], PageDecoder], s: Settings = Settings()) -> DataFrame:
    """ING1-ING6: path, page_num, page_type, psm_used, text, char_count, error. A page whose recognition fails is kept, empty."""

    def run(batches):
        decoder = make()
        for b in batches:
            out = []
            for path, n, image in zip(*(b.column(i).to_pylist() for i in range(3))):
                ratio = decoder.ruled_share(image)
                kind = next((k for least, k in RULED if ratio > least), "text")
                psm = {"table": s.psm_table, "mixed": s.psm_mixed, "text": s.psm_text}[kind]
                try:
                    text, error = decoder.text(image, s.ocr_lang, psm).strip(), None
                except Exception as e:  # as above, for a page
                    text, error = "", f"{type(e).__name__}: {e}"
                out.append((path, n, kind, psm, text, len(text), error))
            if out:
                c = list(zip(*out))
                types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(c, types)],
                    names=["path", "page_num", "page_type", "psm_used", "text", "char_count", "error"],
                )

    ok = pages.where("error IS NULL").select("path", "page_num", "image").repartition("path", "page_num")
    return ok.mapInArrow(run, "path string, page_num int, page_type string, psm_used int, text string, char_count int, error string")


def extracted(files: DataFrame, make: Callable[[], PageDecoder], s: Settings = Settings()) -> DataFrame:
    """ING8: path, text, page_count, pages (array of page details), error."""
    pages = decode(files, make, s)
    done = recognised(pages, make, s)
    detail = done.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page_num", "page_type", "psm_used", "char_count"))).alias("pages"))
    good = fold(done, "path").join(detail, "path").select("path", "text", "page_count", "pages", F.lit(None).cast("string").alias("error"))
    bad = pages.where("error IS NOT NULL").select(
        "path", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("page_count"),
        F.lit(None).cast(good.schema["pages"].dataType).alias("pages"), "error",
    )
    return good.unionByName(bad)
