"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, jaccard_join, language, link_graph, packing, quality_rank, quality_rules, suffix_dedup, token_store, unigram

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark, d):
    return quality_rules.op1(table(spark, d, "documents"))


def op2_link_graph(spark, d):
    return link_graph.judge(spark, table(spark, d, "pages"))


def op3_language_id(spark, d):
    return language.op3(spark, table(spark, d, "documents"))


def op4_sentencepiece(spark, d):
    return unigram.encode_documents(spark, table(spark, d, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_quality_rank(spark, d):
    return quality_rank.op5(spark, table(spark, d, "documents"), table(spark, d, "labels"))


def op6_packing(spark, d):
    return packing.pack(spark, table(spark, d, "documents"), vocabulary("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    )


def op7_token_store(spark, d):
    store = token_store.write(spark, table(spark, d, "documents"), vocabulary("word_bpe_49k.json"))
    return token_store.read_all(store).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_suffix_dedup(spark, d):
    return suffix_dedup.repeats(spark, table(spark, d, "documents")).select("doc_id", "start", "end", "first")


def op9_jaccard_join(spark, d):
    join = jaccard_join.Join(width=3, num=90, den=100)
    return jaccard_join.link(spark, table(spark, d, "documents"), join).select("doc_id", "n_shingles", "component_id")


def op10_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(spark, table(spark, d, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, count(*) FILTER (WHERE n > 1) AS n_dup_lines, count(*) AS n_lines FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) GROUP BY doc_id),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
v AS (SELECT doc_id, w, i, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) AS c FROM v WHERE w2 IS NOT NULL) WHERE c > 1) GROUP BY doc_id),
u AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS n_upper_words, count(*) FILTER (WHERE ends_with(w, '!')) AS n_bang_words, count(*) FILTER (WHERE w = w1) AS n_same_words FROM v GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_upper_words, 0) AS n_upper_words, coalesce(n_bang_words, 0) AS n_bang_words, coalesce(n_same_words, 0) AS n_same_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, cond in enumerate(quality_rules.RULES.values()))})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, n_lines, n_upper_words, n_bang_words, n_same_words FROM f""",
    "op8_suffix_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS s FROM d WHERE len(ws) >= 50),
w AS (SELECT doc_id, s, sha256(array_to_string(ws[s + 1:s + 50], ' ')) AS w FROM s),
c AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) = 1 AS first, count(*) OVER (PARTITION BY w) AS c FROM w),
e AS (SELECT doc_id, s, first, coalesce(s > lag(s) OVER (PARTITION BY doc_id, first ORDER BY s) + 50, true)::INT AS new FROM c WHERE c > 1),
g AS (SELECT doc_id, s, first, sum(new) OVER (PARTITION BY doc_id, first ORDER BY s) AS g FROM e)
SELECT doc_id, min(s) AS start, max(s) + 50 AS "end", first FROM g GROUP BY doc_id, first, g""",
    "op9_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
}
