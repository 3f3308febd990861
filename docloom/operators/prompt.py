"""Prompts and answers around retrieval (PRJ6, PRJ11-PRJ16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import u_trim, u_words

NOT_FOUND = "No information about this was found in the documents."
TASKS = (
    "Answer the question from the context below alone, factually and precisely.",
    "Bring together what different documents say about it.",
    "Write out specific details: dates, numbers, names and places.",
    "Use lists where there is much to list.",
    "Come to the point and don't repeat anything.",
    "If the question is so broad that the context holds several procedures or choices for it, don't describe them all: give a short introduction, list the choices, and ask which one is meant.",
)
INTRO = "\nYou answer questions about a collection of documents.\n\nTasks:\n" + "".join(f"{i}. {t}\n" for i, t in enumerate(TASKS, 1)) + f"\nIf the context doesn't hold the answer, reply exactly: {NOT_FOUND}\nDon't invent facts, use no other knowledge, and answer in the language of the question.\n"


def needs_condensing(query: Column, has_history: Column) -> Column:
    """PRJ6: a short question after earlier messages: four words or fewer, or 25 characters or fewer."""
    return has_history & ((F.size(u_words(u_trim(query))) <= 4) | (F.length(query) <= 25))


def role_label(role: Column) -> Column:
    """PRJ11."""
    return F.when(role == "user", "User").otherwise("Assistant")


def history_strings(messages: DataFrame, key: str, order: list[str], role: str = "role", content: str = "content") -> DataFrame:
    """PRJ12: (key, history): a line for each message, in order."""
    line = F.concat(role_label(F.col(role)), F.lit(": "), F.coalesce(content, F.lit("")), F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return messages.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x.line), "").alias("history"))


def context_blocks(hits: DataFrame, key: str, rank: str = "rank", content: str = "content") -> DataFrame:
    """PRJ13: (key, context): numbered blocks in order of rank."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(content).alias("c"))))
    block = lambda x: F.concat(F.lit("[Dokumen "), x.r.cast("string"), F.lit("]\n"), x.c)
    return hits.groupBy(key).agg(F.array_join(F.transform(rows, block), "\n\n").alias("context"))


def prompt(query: Column, context: Column) -> Column:
    """PRJ14: the instructions, then the parts CONTEXT, PERTANYAAN and JAWABAN."""
    return F.concat(F.lit(INTRO + "\nCONTEXT:\n"), context, F.lit("\n\nPERTANYAAN:\n"), query, F.lit("\n\nJAWABAN:\n"))


def condensing_prompt(query: Column, history: Column) -> Column:
    """PRJ15: asks for a question that can be understood without the history."""
    return F.concat(
        F.lit("Rewrite the last question so that it can be understood alone. Answer with the question only.\n\nHistory:\n"), history,
        F.lit("\nQuestion: "), query,
    )
