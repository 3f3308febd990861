"""The training-data pipeline: quality classifier, exact dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns a DataFrame; all but the last
return those columns, whatever else they are called. run() writes what a stage returns as Parquet in the shared folder and reads it back for the next one;
what a stage needed in between is deleted when its result is written, and the result when the next one is.

The quality stage rejects what scores below QUALITY, the dedup stages keep one row of each group, the suffix stage cuts repeated passages and keeps every row.
In every stage, null texts count as empty (the quality stage scores them like empty ones; exact dedup keeps one of all empty texts; the others leave them as they are);
very long texts are read whole; of equal texts the longest original and then the smallest doc_id stays, of linked ones that with the smallest doc_id; repeated
rows become one in the exact dedup stage; an empty table gives an empty result; columns besides doc_id, text and n_chars pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import exact_dedup, jaccard_join, packing, quality_rank, suffix_dedup
from docloom.llm.common import drop_table, scratch, temporary, write_table
from docloom.llm.queries import table, vocabulary

#: Least quality score of a document that stays.
QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rank.fit(spark, docs, table(spark, sf_dir, "labels"))
    return quality_rank.filter_documents(spark, docs, model, QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_documents(spark, docs, jaccard_join.Join(width=5, num=80, den=100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, vocabulary("byte_bpe_50k.json")).drop("row")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("packing", packed),
]

#: Learned weights, similarity classes and tokenizer ids aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{name}")
        with temporary(spark):
            new = write_table(spark, stage(spark, docs, sf_dir), path)
        if i:
            drop_table(spark, docs)
        docs = new
    return docs
