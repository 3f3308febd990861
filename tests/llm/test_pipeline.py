"""The pipeline's stages, and the registered SQL of this subpackage."""

import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from test_operators import slow_features
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import quality_rank
from docloom.llm.queries import ORACLE_SQL, queries, vocabulary


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert oracle.from_spark(queries()[name](spark, sf)) == oracle.from_sql(ORACLE_SQL[name], sf)


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[1] > seen[2] and seen[-1] == seen[-2]
    assert docs.join(labels.where("quality = 0"), "doc_id").count() == 0
    assert docs.select(F.regexp_replace("text", r"\s", "")).where("1 = 1").distinct().count() >= docs.count() - 1
    packed = corpus_pipeline.packed(spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_quality_stage_is_its_definition(spark, sf):
    """Against features computed slowly and the score's formula: whole rows, all that score enough."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality_rank.fit(spark, docs, labels)

    def score(t):
        x = slow_features((t or "").encode())
        return 1 / (1 + np.exp(-m.slope * sum(min(8, max(-8, (a - b) / c)) * d for a, b, c, d in zip(x, m.mean, m.scale, m.w)) - m.offset))

    want = sorted(map(str, (r for r in docs.collect() if score(r.text) >= corpus_pipeline.QUALITY)))
    assert sorted(map(str, corpus_pipeline.quality_classifier(spark, docs, sf).collect())) == want and len(want) < docs.count()


def test_packing_stage_is_the_librarys(spark, docs, rows):
    """Each document's pieces in order against the library's ids; sequences gapless and not overfull."""
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got, seq = {}, {}
    for r in corpus_pipeline.packed(spark, docs.dropDuplicates(["doc_id"]), None).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    texts = {r.doc_id: r.text for r in docs.dropDuplicates(["doc_id"]).collect()}
    for i, t in texts.items():
        ids, at = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc, total in sorted(got[i]):
            assert (start, total) == (at, len(ids)) and crc == zlib.crc32(ids[start : start + length])
            at += length
        assert at == len(ids)
    for own in seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_take_hard_tables(spark, docs, empty, sf):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for d in (own, empty):
            out = stage(spark, d, sf)
            assert out.count() >= 0 and (name == "packing" or out.columns == own.columns)


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_copies, corpus_pipeline.repeated_passages, corpus_pipeline.near_copies])
def test_stages_take_narrow_ids(spark, docs, stage):
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 24").coalesce(1)
    narrow = wide.withColumn("doc_id", F.col("doc_id").cast("int"))
    a, b = (sorted(str((r.doc_id, r.text)) for r in stage(spark, d, None).collect()) for d in (wide, narrow))
    assert a == b and a


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
