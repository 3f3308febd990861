"""Evaluation (JN9, AGG10-AGG15): one search at the largest k serves every cell of the grid; the judge's run; layout modes compared."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cleaning import text_metrics
from ..operators.prompt import prompt
from ..schemas import JUDGE

TOP_K, MIN_SCORE = (5, 10, 15), (0.3, 0.5)


def has_keyword(content: Column, keywords: Column) -> Column:
    """JN9: any of an array of keywords in the content, in any case."""
    low = F.lower(content)
    return F.exists(keywords, lambda k: low.contains(F.lower(k)))


def first_hits(found: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, first_rank) of every case: the least rank of what it found (query_id, rank, content) that has one of its keywords (query_id, keywords), 0 if none has."""
    hit = found.join(cases, "query_id").where(has_keyword(F.col("content"), F.col("keywords"))).groupBy("query_id").agg(F.min("rank").alias("r"))
    return cases.join(hit, "query_id", "left").select("query_id", F.coalesce("r", F.lit(0)).alias("first_rank"))


def recall_mrr(first: DataFrame) -> DataFrame:
    """AGG11, AGG12 of (query_id, first_rank)."""
    hit = F.col("first_rank") > 0
    return first.agg(
        F.round(100.0 * F.count_if(hit) / F.count("*"), 6).alias("recall"),
        F.round(F.coalesce(F.sum(F.when(hit, 1.0 / F.col("first_rank"))), F.lit(0.0)) / F.count("*"), 6).alias("mrr"),
    )


def grid(candidates: DataFrame, cases: DataFrame, top_k=TOP_K, min_score=MIN_SCORE) -> DataFrame:
    """AGG13: (top_k, min_score, recall, mrr) per cell. candidates: query_id, id, rank (by distance), score (rescored), relevant; cases: query_id.

    A cell takes the first max(2k, 25) candidates, those that reach the score, the k best of them, and the rank of the first relevant one.
    """
    each = [F.struct(F.lit(k).cast("int").alias("top_k"), F.lit(s).cast("double").alias("min_score")) for k in top_k for s in min_score]
    listed = F.array(*each).cast("array<struct<top_k: int, min_score: double>>")
    cells = candidates.sparkSession.range(0, 1, 1, 1).select(F.inline(listed))  # rows from Python would take Python workers of their own
    own = candidates.join(F.broadcast(cells), (F.col("rank") <= F.greatest(2 * F.col("top_k"), F.lit(25))) & (F.col("score") >= F.col("min_score")))
    place = F.row_number().over(Window.partitionBy("query_id", "top_k", "min_score").orderBy(F.desc("score"), "rank"))
    hits = own.withColumn("place", place).where((F.col("place") <= F.col("top_k")) & F.col("relevant")).groupBy("query_id", "top_k", "min_score").agg(F.min("place").alias("first"))
    total = cases.select("query_id").distinct().agg(F.count("*").alias("n"))
    sums = hits.groupBy("top_k", "min_score").agg(F.count("*").alias("found"), F.sum(1.0 / F.col("first")).alias("inverse"))
    every = cells.join(sums, ["top_k", "min_score"], "left").crossJoin(F.broadcast(total))
    return every.select(
        "top_k", "min_score", F.round(100.0 * F.coalesce("found", F.lit(0)) / F.col("n"), 6).alias("recall"),
        F.round(F.coalesce("inverse", F.lit(0.0)) / F.col("n"), 6).alias("mrr"),
    )


def best(cells: DataFrame) -> DataFrame:
    """AGG14: the cell of the highest MRR; of equal ones the smallest k, then the smallest score."""
    return cells.orderBy(F.desc("mrr"), "top_k", "min_score").limit(1)


def judge_averages(verdicts: DataFrame) -> DataFrame:
    """AGG15: averages per temperature of (temperature, json) over answers that are JSON objects; a missing score counts 0."""
    j = verdicts.select(
        "temperature", F.from_json("json", JUDGE).alias("j"), F.get_json_object("json", "$").alias("raw"),
    ).where("raw IS NOT NULL AND startswith(raw, '{')")
    avg = lambda c: F.round(F.avg(F.coalesce(F.col(f"j.{c}.skor"), F.lit(0)).cast("double")), 6).alias(c)
    return j.groupBy("temperature").agg(avg("relevansi"), avg("factuality"), avg("completeness"), F.count("*").alias("n_valid"))


#: What the judge's verdict is made of.
MEASURES = ("relevansi", "factuality", "completeness")


def judge_prompt(question: Column, context: Column, answer: Column) -> Column:
    """What a judging model is asked: three scores from 1 to 5, each with a reason, as a JSON object."""
    shape = "{" + ", ".join(f'"{m}": {{"skor": 5, "alasan": "..."}}' for m in MEASURES) + "}"
    ask = "Nilai jawaban berikut dengan skor 1 sampai 5 untuk relevansi (langsung menjawab), factuality (hanya dari konteks) dan completeness (semua hal penting dalam konteks)."
    return F.concat(
        F.lit(f"{ask}\n\nPERTANYAAN:\n"), question, F.lit("\n\nKONTEKS:\n"), context, F.lit("\n\nJAWABAN:\n"), answer,
        F.lit(f"\n\nBalas dengan JSON saja:\n{shape}\n"),
    )


def judged(answers: DataFrame, make_generator: Callable, temperatures=(0.1, 0.8), pause: float = 5.0, sleep: Callable = time.sleep) -> DataFrame:
    """The judge's run: (temperature, query_id, answer, json) of answers (query_id, query, context), one row a temperature. Write the result before it is used twice.

    The model answers each question at each temperature and then judges the answer; busy answers and failed calls have a null json, which `judge_averages` leaves out. `pause` seconds lie between judgements.
    """
    cells = answers.sparkSession.createDataFrame([(float(t),) for t in temperatures], "temperature double")
    prompts = answers.crossJoin(F.broadcast(cells)).select("temperature", "query_id", "query", "context", prompt(F.col("query"), F.col("context")).alias("ask"))
    left, right = judge_prompt(F.lit("\x01"), F.lit("\x02"), F.lit("\x03")), answers.sparkSession.range(1)
    form = right.select(left.alias("f")).first().f

    def run(batches):
        model = make_generator()
        for b in batches:
            out = []
            for t, q, query, context, ask in zip(*(b.column(i).to_pylist() for i in range(5))):
                answer = verdict = None
                try:
                    answer = model.generate(ask, t, 4096)
                    if "rate limit" not in answer.lower():
                        verdict = model.generate(form.replace("\x01", query).replace("\x02", context).replace("\x03", answer), 0.0, 4096)
                except Exception as e:  # one case's failure leaves the others alone
                    answer = answer or f"{type(e).__name__}: {e}"
                sleep(pause)
                out.append((t, str(q), answer, verdict))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.float64(), pa.string(), pa.string(), pa.string()))],
                    names=["temperature", "query_id", "answer", "json"],
                )

    return prompts.mapInArrow(run, "temperature double, query_id string, answer string, json string")


def layout_metrics(images: DataFrame, make_decoder: Callable, language: str = "ind", modes=(3, 6)) -> DataFrame:
    """Layout modes of the recogniser side by side: (path, page_num, psm, text and its metrics, AGG10) of pages (path, page_num, image)."""

    def run(batches):
        decoder = make_decoder()
        for b in batches:
            out = [(p, n, m, decoder.text(image, language, m)) for p, n, image in zip(*(b.column(i).to_pylist() for i in range(3))) for m in modes]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.string()))],
                    names=["path", "page_num", "psm", "text"],
                )

    got = images.select("path", "page_num", "image").mapInArrow(run, "path string, page_num int, psm int, text string")
    return got.select("*", *(c.alias(k) for k, c in text_metrics(F.col("text")).items()))
