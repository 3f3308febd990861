"""The registered queries: one per operator, on the fixture tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, cleaning, pages, prompt, store
from ..operators.rerank import TIME_WORDS, rescored, time_intent
from ..operators.similarity import knn, retrieve
from ..sources.providers import hash_embedding
from ..sources.tables import table
from ..streaming.ingest import log_of
from . import catalog, chat, evaluate, ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "documents")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"),
        F.lit(None).cast("string").alias("sources"), F.timestamp_seconds("turn").alias("timestamp"),
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").where("conv_id % 5 <> 0").select("conv_id").distinct()
    return ids.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.when(F.col("conv_id") % 3 == 0, chat.OLD_TITLE).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("T"), F.col("conv_id").cast("string"))).alias("title"),
        F.timestamp_seconds(F.col("conv_id")).alias("updated_at"),
        F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("user"), (F.col("conv_id") % 3).cast("string"))).alias("username"),
    )


M = "WITH m AS (SELECT turn AS id, CAST(conv_id AS VARCHAR) AS session_id, role, text AS content, turn AS ts FROM conversations), s AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'Sesi Riwayat' WHEN conv_id % 3 = 1 THEN 'T' || conv_id END AS title, conv_id AS updated_at, CASE WHEN conv_id % 7 <> 0 THEN 'user' || (conv_id % 3) END AS username FROM conversations WHERE conv_id % 5 <> 0) "
SHORT = "CASE WHEN length({0}) > 30 THEN substr({0}, 1, 30) || '...' ELSE {0} END"
FIRST = "(SELECT session_id, arg_min(content, id) AS content, min(ts) AS ts FROM m WHERE role = 'user' GROUP BY session_id)"
COS = "round(1 - list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 6)"


def _secs(c):
    return F.unix_timestamp(c).alias(c)


@query("SELECT doc_id, lang, source, n_chars, length(text) AS n FROM documents")
def scan_documents(spark, d):
    return _docs(spark, d).select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("n"))


# -- text ------------------------------------------------------------------

# literal parts stand in for what the documents don't have: CR, no-break spaces, hyphens at line ends, stamps
_ROUGH = "concat('a', char(13), char(10), char(160), replace(text, '. ', concat('-', char(10))), char(13))"
_ROUGH_SQL = "('a' || chr(13) || chr(10) || chr(160) || replace(text, '. ', '-' || chr(10)) || chr(13))"


def _out(spark, d, c, rough=None):
    docs = _docs(spark, d).withColumn("t", F.expr(rough) if rough else F.col("text"))
    return docs.select("doc_id", c(F.col("t")).alias("out"))


@query(f"SELECT doc_id, regexp_replace(replace({_ROUGH_SQL}, chr(160), ' '), '\\r\\n?', chr(10), 'g') AS out FROM documents")
def clean_normalize(spark, d):
    return _out(spark, d, cleaning.normalize, _ROUGH)


@query(f"SELECT doc_id, regexp_replace({_ROUGH_SQL}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS out FROM documents")
def clean_dehyphenate(spark, d):
    return _out(spark, d, cleaning.dehyphenate, _ROUGH)


def _lines_sql(src: str) -> str:
    """(doc_id, i, x): the lines of a CTE (doc_id, t)."""
    return f"SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM {src}"


def _garbage_sql(src: str) -> str:
    """(doc_id, t): the texts of a CTE (doc_id, t) without garbage lines."""
    return f"""WITH l AS (SELECT doc_id, i, x, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS s FROM ({_lines_sql(src)})),
k AS (SELECT *, length(s) AS n, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) AS w, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '' AND length(w) <= 2)) AS w2 FROM l)
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE s = '' OR NOT (regexp_matches(s, '(?i)No results found|Resize table columns|DEV AREALogout|Back$|Dashboard|Blog Post|Tagihan|Ganti User|Hak akses|Close$') OR n < 3
 OR length(regexp_replace(s, '[^\\p{{L}}\\p{{N}}\\s.,;:()/\\-]', '', 'g')) / n < 0.5 OR length(regexp_replace(s, '[^%&@#$^*_=<>~]', '', 'g')) / n > 0.3 OR (n > 30 AND length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) / n < 0.15) OR (w > 4 AND w2 / w > 0.65))), '') AS t FROM k GROUP BY doc_id"""


def _artifacts_sql(t: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(?m)^\\s*-\\s*\\d+\\s*-\\s*$', '', 'g'), '(?m)^\\s*SALINAN\\s*$', '', 'g'), '(?im)^\\s*ttd\\.?\\s*$', '', 'g'), '(?is)Salinan sesuai dengan aslinya.*?(\\n\\n|\\z)', '\\1', 'g')"


def _leaders_sql(src: str) -> str:
    """(doc_id, t): the texts of a CTE (doc_id, t) with clean leaders."""
    return f"""WITH l AS (SELECT doc_id, i, regexp_replace(x, '\\.{{3,}}\\s*(\\d{{1,3}})$', ' \\1') AS x FROM ({_lines_sql(src)})), p AS (SELECT *, regexp_extract(x, '(?s)^(.*?)\\.{{2,}}', 1) AS prefix FROM l), s AS (SELECT *, substr(x, length(prefix) + 1) AS suffix FROM p),
o AS (SELECT *, regexp_replace(suffix, '[ .\\t]', '', 'g') AS odd, regexp_extract(suffix, '(\\d{{1,3}})\\s*$', 1) AS page, len(list_filter(list_distinct(string_split(suffix, '')), lambda c: c <> '' AND contains(suffix, repeat(c, 4)))) > 0 AS runs FROM s)
SELECT doc_id, string_agg(CASE WHEN contains(x, '..') AND length(odd) > 0 AND ((length(odd) - length(translate(odd, '{cleaning.LEADER_NOISE}', ''))) / length(odd) > 0.45 OR runs) THEN prefix || CASE WHEN page <> '' THEN ' ' || page ELSE '' END ELSE x END, chr(10) ORDER BY i) AS t FROM o GROUP BY doc_id"""


_COLLAPSE = "regexp_replace(regexp_replace({0}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')"
_TRIM = "regexp_replace(list_aggregate(list_transform(string_split({0}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), 'string_agg', chr(10)), '^\\s+|\\s+$', '', 'g')"
_CLEAN_ALL = (
    "WITH n AS (SELECT doc_id, CASE WHEN trim(t) = '' THEN '' ELSE regexp_replace(regexp_replace(replace(replace(t, chr(160), ' '), chr(0), ''), '\\r\\n?', chr(10), 'g'), '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g') END AS t FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), "
    f"g AS ({_garbage_sql('n')}), a AS (SELECT doc_id, {_artifacts_sql('t')} AS t FROM g), d AS ({_leaders_sql('a')}) SELECT doc_id, {_TRIM.format(_COLLAPSE.format('t'))} AS out FROM d"
)


@query(f"WITH d AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, t AS out FROM ({_garbage_sql('d')})")
def clean_garbage_lines(spark, d):
    return _out(spark, d, cleaning.drop_garbage_lines)


_STAMPS = "concat('- 12 -', char(10), text, char(10), 'SALINAN', char(10), 'salinan', char(10), ' TTD.', char(10), 'Salinan sesuai dengan aslinya', char(10), 'x', char(10), char(10), 'rest')"
_STAMPS_SQL = "('- 12 -' || chr(10) || text || chr(10) || 'SALINAN' || chr(10) || 'salinan' || chr(10) || ' TTD.' || chr(10) || 'Salinan sesuai dengan aslinya' || chr(10) || 'x' || chr(10) || chr(10) || 'rest')"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STAMPS_SQL}, '(?m)^\\s*-\\s*\\d+\\s*-\\s*$', '', 'g'), '(?m)^\\s*SALINAN\\s*$', '', 'g'), '(?im)^\\s*ttd\\.?\\s*$', '', 'g'), '(?is)Salinan sesuai dengan aslinya.*?(\\n\\n|\\z)', '\\1', 'g') AS out FROM documents")
def clean_artifacts(spark, d):
    return _out(spark, d, cleaning.drop_artifacts, _STAMPS)


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, '. ', repeat(chr(10), 4)), ',', '   '), '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g') AS out FROM documents")
def clean_collapse(spark, d):
    return _out(spark, d, cleaning.collapse, "replace(replace(text, '. ', repeat(char(10), 4)), ',', '   ')")


@query("SELECT doc_id, regexp_replace(list_aggregate(list_transform(string_split(replace(text, '.', ' ' || chr(10) || ' '), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), 'string_agg', chr(10)), '^\\s+|\\s+$', '', 'g') AS out FROM documents")
def clean_whitespace(spark, d):
    return _out(spark, d, cleaning.trim_lines, "replace(text, '.', concat(' ', char(10), ' '))")


@query(f"WITH d AS (SELECT doc_id, replace(text, ', ', ' ..oooo.. 7' || chr(10)) || ' ..... 5' AS t FROM documents) SELECT doc_id, t AS out FROM ({_leaders_sql('d')})")
def clean_leaders(spark, d):
    return _out(spark, d, cleaning.clean_leaders, "concat(replace(text, ', ', ' ..oooo.. 7\n'), ' ..... 5')")


@query(_CLEAN_ALL)
def clean_all(spark, d):
    return _out(spark, d, cleaning.clean)


@query("""SELECT doc_id, length(text) AS char_count, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS line_count,
CASE WHEN text = '' THEN 0.0 ELSE round(100.0 * length(regexp_replace(text, '[\\p{L}\\p{N}.,;:()/\\-_?!''"\\n\\t ]', '', 'g')) / length(text), 6) END AS noise_ratio FROM documents""")
def ocr_metrics(spark, d):
    m = cleaning.text_metrics(F.col("text"))
    return _docs(spark, d).select(
        "doc_id", *(m[c].alias(c) for c in ("char_count", "word_count", "line_count")), F.round(m["noise_ratio"], 6).alias("noise_ratio"),
    )


# -- pages and chunks --------------------------------------------------------


@query("SELECT event_id, CASE WHEN value / 10000 > 0.005 THEN 'table' WHEN value / 10000 > 0.002 THEN 'mixed' ELSE 'text' END AS page_type, CASE WHEN value / 10000 > 0.005 THEN 6 WHEN value / 10000 > 0.002 THEN 3 ELSE 6 END AS psm FROM events")
def page_type_classify(spark, d):
    kind = pages.page_type(F.col("value") / 10000)
    return table(spark, d, "events").select("event_id", kind.alias("page_type"), pages.psm_for(kind).alias("psm"))


@query("SELECT conv_id, coalesce(string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> ''), '') AS text, count(*) AS page_count FROM conversations GROUP BY conv_id")
def page_text_concat(spark, d):
    return pages.fold(table(spark, d, "conversations"), "conv_id", "turn")


def _chunks(spark, d):
    return chunking.chunk_documents(_docs(spark, d).select("source", "doc_id", "text"), "source", "doc_id")


@query()
def chunk_documents(spark, d):
    return _chunks(spark, d)


@query("SELECT doc_id, true AS all_fit, true AS in_order, true AS all_there FROM documents WHERE trim(text) <> ''")
def chunk_invariants(spark, d):
    c = _chunks(spark, d).groupBy(F.col("document_id").cast("long").alias("doc_id")).agg(
        F.max("char_count").alias("most"), F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("c"),
    )
    bare = lambda x: F.regexp_replace(x, r"(?U)\s", "")
    j = c.join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return j.select(
        "doc_id", (F.col("most") <= 1000).alias("all_fit"),
        (F.size(F.array_distinct(F.transform("c", lambda x: x.chunk_index))) == F.size("c")).alias("in_order"),
        F.forall("c", lambda x: bare(F.col("text")).contains(bare(x.content))).alias("all_there"),
    )


@query("SELECT conv_id, turn FROM conversations WHERE trim(CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END) <> ''")
def valid_chunks(spark, d):
    c = table(spark, d, "conversations").withColumn("content", F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")))
    return chunking.valid_chunks(c).select("conv_id", "turn")


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents), c AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS norm FROM c) SELECT doc_id, b AS bucket, round(n / norm, 6) AS value FROM s""")
def hash_embedding_values(spark, d):
    e = _docs(spark, d).select("doc_id", F.posexplode(hash_embedding(F.col("text"), 64)).alias("b", "value"))
    return e.where("value > 0").select("doc_id", F.col("b").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


# -- search -------------------------------------------------------------------

QUESTION = "when is the schedule date"


def _store(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return _docs(spark, d).select("doc_id", F.col("text").alias("content"), F.col("source").alias("source_file")).join(e, "doc_id")


def _asked(spark, d, cond="vec_id = 0"):
    return table(spark, d, "embeddings").where(cond).select(F.col("vec_id").alias("query_id"), F.lit(QUESTION).alias("query"), "embedding", "label")


_STORE = "st AS (SELECT doc_id, text AS content, source AS source_file, embedding, label FROM documents JOIN embeddings ON vec_id = doc_id)"
_TIME = "(" + " OR ".join(f"contains('{QUESTION}', '{w}')" for w in TIME_WORDS) + ")"
_BOOST = (
    f"CASE WHEN {_TIME} THEN CASE WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in (
        "januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember",
    ))
    + " THEN 0.15 ELSE 0 END + 0.05 * (" + " + ".join(f"contains(lower(content), '{w}')::INT" for w in ("jadwal", "tanggal", "kalender", "herregistrasi", "registrasi"))
    + ") ELSE 0 END + 0.02 * (" + " + ".join(f"contains(lower(content), '{w}')::INT" for w in QUESTION.split() if len(w) > 2) + ")"
)


def _ranked_sql(cond: str, k: int, top: int, least: float) -> str:
    return (
        f"WITH {_STORE}, q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE {cond}), c AS (SELECT query_id, doc_id, content, {COS.format('embedding', 'qe')} AS distance FROM st, q), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS n FROM c), b AS (SELECT query_id, doc_id, distance, round(round(1 - distance, 6) + CAST({_BOOST} AS DOUBLE), 6) AS score FROM r WHERE n <= {k}), "
        f"f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, doc_id) AS rank FROM b WHERE score >= {least}) SELECT query_id, doc_id, distance, score, rank FROM f WHERE rank <= {top}"
    )


@query(f"WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT query_id, vec_id, {COS.format('embedding', 'qe')} AS distance FROM embeddings, q) SELECT query_id, vec_id, distance, round(1 - distance, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM c QUALIFY rank <= 10")
def knn_cosine_topk(spark, d):
    return knn(spark, table(spark, d, "embeddings"), _asked(spark, d, "vec_id % 50 = 0"), 10, "vec_id").withColumn("rank", F.col("rank").cast("long"))


@query(_ranked_sql("vec_id = 0", 25, 5, 0.25))
def retrieve_one(spark, d):
    return retrieve(spark, _store(spark, d), _asked(spark, d), 5, 0.25, "doc_id").drop("content").withColumn("rank", F.col("rank").cast("long"))


@query(_ranked_sql("vec_id % 50 = 0", 25, 5, 0.25))
def retrieve_batch(spark, d):
    return retrieve(
        spark, _store(spark, d), _asked(spark, d, "vec_id % 50 = 0"), 5, 0.25, "doc_id",
    ).drop("content").withColumn("rank", F.col("rank").cast("long"))


# words of the fixtures' vocabulary stand in for months and calendar words, which they hardly have
_MONTHS, _CALENDAR = ("ther", "eaux"), ("tion", "heit", "ción", "ement", "ment")


@query(
    "SELECT doc_id, round(0.5 + CAST(CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in _MONTHS) + " THEN 0.15 ELSE 0 END + 0.05 * (" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in _CALENDAR)
    + ") + 0.02 * (" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in QUESTION.split() if len(w) > 2) + ") AS DOUBLE), 6) AS score FROM documents"
)
def rerank(spark, d):
    return _docs(spark, d).select("doc_id", rescored(F.lit(QUESTION), F.col("text"), F.lit(0.5), _MONTHS, _CALENDAR).alias("score"))


@query("SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{w}')" for w in TIME_WORDS) + " AS timed FROM conversations")
def time_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", time_intent(F.col("text")).alias("timed"))


@query("SELECT vec_id, list_transform(list_concat(embedding[1:5], embedding[-5:]), lambda x: round(CAST(x AS DOUBLE), 6))[1] AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last, 11 AS n, len(embedding) AS dimension FROM embeddings")
def embedding_sample(spark, d):
    s = store.embedding_sample(F.col("embedding"))
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(F.element_at(s, 1).cast("double"), 6).alias("first"),
        F.round(F.element_at(s, 11).cast("double"), 6).alias("last"), F.size(s).alias("n"),
        F.size("embedding").cast("long").alias("dimension"),
    )


# -- store --------------------------------------------------------------------


def _rows(spark, d, cond, tag):
    e = table(spark, d, "embeddings").where(cond)
    return e.select(
        F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit(tag), (F.col("vec_id") % 7).cast("string")).alias("source_file"), F.col("label").cast("string").alias("document_id"),
        F.col("vec_id").cast("int").alias("chunk_index"), F.lit(tag).alias("content"), F.lit(3).alias("char_count"), "embedding",
    )


_ROWS = "SELECT 'c' || vec_id AS chunk_id, '{tag}' || (vec_id % 7) AS source_file, CAST(label AS VARCHAR) AS document_id, CAST(vec_id AS INT) AS chunk_index, '{tag}' AS content FROM embeddings WHERE {cond}"


@query(f"WITH o AS ({_ROWS.format(tag='old', cond='true')}), n AS (SELECT CASE WHEN label = 0 THEN 'new-' ELSE '' END || chunk_id AS chunk_id, source_file, document_id, chunk_index, content FROM (SELECT *, CAST(document_id AS BIGINT) AS label FROM ({_ROWS.format(tag='new', cond='true')}))) SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT * FROM n")
def vector_upsert(spark, d):
    new = _rows(spark, d, "true", "new").withColumn(
        "chunk_id", F.when(F.col("document_id") == "0", F.concat(F.lit("new-"), "chunk_id")).otherwise(F.col("chunk_id")),
    )
    out = store.upserted(_rows(spark, d, "true", "old"), new)
    return out.select("chunk_id", "source_file", "document_id", "chunk_index", "content")


@query(f"SELECT * FROM ({_ROWS.format(tag='old', cond='true')}) WHERE document_id IS DISTINCT FROM '3'")
def vector_delete_by_document(spark, d):
    return store.deleted(_rows(spark, d, "true", "old"), "3").select("chunk_id", "source_file", "document_id", "chunk_index", "content")


@query("SELECT count(*) AS total_chunks FROM embeddings")
def store_stats(spark, d):
    return store.counted(_rows(spark, d, "true", "old"))


@query(f"SELECT document_id, arg_min(source_file, chunk_index) AS source_file FROM ({_ROWS.format(tag='old', cond='true')}) GROUP BY document_id")
def distinct_documents(spark, d):
    return store.documents_of(_rows(spark, d, "true", "old"))


# -- catalog, log, small functions -------------------------------------------


@query("SELECT replace('doc' || d.doc_id || '.pdf', '.pdf', '') AS title, 'doc' || d.doc_id || '.pdf' AS file, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (d.doc_id % 365), '%d %b %Y') AS date, CASE WHEN l.doc_id IS NOT NULL THEN 'Ready' ELSE 'Proses' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def catalog_left_join(spark, d):
    name = lambda c: F.concat(F.lit("doc"), F.col(c).cast("string"), F.lit(".pdf"))
    files = _docs(spark, d).select(
        name("doc_id").alias("file"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id % 365 as int))").alias("modified"),
    )
    return catalog.catalog(files, table(spark, d, "labels").select(name("doc_id").alias("source_file"), F.col("doc_id").alias("document_id")))


@query("SELECT doc_id, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 365), '%d %b %Y') AS date FROM documents")
def catalog_date(spark, d):
    return _docs(spark, d).select(
        "doc_id", catalog.shown_date(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id % 365 as int))")).alias("date"),
    )


@query("SELECT doc_id, source FROM documents WHERE contains(lower(lang || source), 'src1')")
def catalog_search(spark, d):
    return catalog.search(
        _docs(spark, d).select("doc_id", "source", F.col("source").alias("file"), F.concat("lang", "source").alias("title")), "SRC1",
    ).select("doc_id", "source")


@query("SELECT event_id, CASE WHEN contains(m, 'SUCCESS:') THEN 'success' WHEN contains(m, 'CRITICAL ERROR') OR contains(m, 'ERROR:') THEN 'error' WHEN contains(m, 'Peringatan:') THEN 'warning' ELSE 'info' END AS level FROM (SELECT event_id, ['SUCCESS: a', 'ERROR: b', 'CRITICAL ERROR', 'Peringatan: c', 'd'][1 + event_id % 5] AS m FROM events)")
def log_level(spark, d):
    m = F.element_at(F.array(*map(F.lit, ("SUCCESS: a", "ERROR: b", "CRITICAL ERROR", "Peringatan: c", "d"))), (1 + F.col("event_id") % 5).cast("int"))
    return table(spark, d, "events").select("event_id", T.log_level(m).alias("level"))


@query("SELECT event_id, event_type AS message FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def event_log_by_key(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("filename"), F.lit(0).cast("bigint").alias("seq"), "user_id",
        F.timestamp_seconds("event_id").alias("ts"), F.col("event_type").alias("message"),
    )
    return log_of(e, str(e.agg(F.min("user_id")).first()[0])).select(F.unix_timestamp("ts").alias("event_id"), "message")


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&quot;') AS out FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("out"))


@query("SELECT event_id, event_id % 3 > 0 AS valid, CASE event_id % 3 WHEN 1 THEN event_type END AS title, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS n FROM events")
def json_field(spark, d):
    # by turns no JSON, one source, an empty list
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("no json "), "event_type")).when(
        F.col("event_id") % 3 == 1, F.to_json(F.array(F.struct(F.col("event_type").alias("title"), F.lit("f.pdf").alias("file")))),
    ).otherwise("[]")
    got = table(spark, d, "events").select("event_id", chat.decoded_sources(raw).alias("s"))
    return got.select(
        "event_id", F.col("s").isNotNull().alias("valid"), F.get("s", F.lit(0)).title.alias("title"),
        F.when(F.col("s").isNotNull(), F.size("s")).alias("n"),
    )


@query(f"SELECT conv_id, turn, {SHORT.format('text')} AS title FROM conversations")
def session_title(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.shortened(F.col("text")).alias("title"))


@query("SELECT conv_id, turn, CASE WHEN starts_with(t, '\"') AND ends_with(t, '\"') THEN substr(t, 2, greatest(length(t) - 2, 0)) ELSE t END AS out FROM (SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN ' \"' || text || '\" ' WHEN 1 THEN '\"' ELSE text END) AS t FROM conversations)")
def unquote(spark, d):
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(' "'), "text", F.lit('" '))).when(F.col("turn") % 3 == 1, '"').otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.unquote(raw).alias("out"))


@query("SELECT event_id, CASE WHEN contains(e, '429') OR contains(e, 'RESOURCE_EXHAUSTED') THEN 'The language model is busy (rate limit). Please try again later.' ELSE 'Generation failed: ' || e END AS out FROM (SELECT event_id, ['code 429', 'RESOURCE_EXHAUSTED', event_type][1 + event_id % 3] AS e FROM events)")
def error_map(spark, d):
    e = F.element_at(F.array(F.lit("code 429"), F.lit("RESOURCE_EXHAUSTED"), "event_type"), (1 + F.col("event_id") % 3).cast("int"))
    return table(spark, d, "events").select("event_id", T.generation_error(e).alias("out"))


# -- chat ----------------------------------------------------------------------


@query(M + f"SELECT session_id, coalesce(CASE WHEN title <> '' THEN title END, {SHORT.format('content')}) AS title, ts FROM {FIRST} JOIN s USING (session_id) WHERE username = 'user1'")
def history_sessions(spark, d):
    return chat.list_sessions(messages(spark, d), sessions(spark, d), "user1").select("session_id", "title", _secs("ts"))


@query(M + f"SELECT session_id, content, ts FROM {FIRST}")
def first_user_message(spark, d):
    return chat.first_user_message(messages(spark, d)).select("session_id", "content", _secs("ts"))


@query(M + "SELECT session_id, arg_min(content, id) AS content, min(ts) AS ts FROM m WHERE role = 'user' AND session_id NOT IN (SELECT session_id FROM s) GROUP BY session_id")
def orphan_sessions_not_in(spark, d):
    return chat.orphans(messages(spark, d), sessions(spark, d)).select("session_id", "content", _secs("ts"))


@query(M + "SELECT DISTINCT session_id FROM m WHERE EXISTS (SELECT 1 FROM s WHERE s.session_id = m.session_id)")
def session_exists_semi(spark, d):
    return chat.existing(messages(spark, d).select("session_id").distinct(), sessions(spark, d))


@query(M + "SELECT id, role, content, ts FROM m WHERE session_id = '7'")
def session_transcript(spark, d):
    return chat.transcript(messages(spark, d), "7").select("id", "role", "content", F.unix_timestamp("timestamp").alias("ts"))


@query(M + "SELECT session_id, id, role FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) BETWEEN 2 AND 7")
def history_window(spark, d):
    return chat.history_window(messages(spark, d), 6).select("session_id", "id", "role")


@query(M + "SELECT session_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content || chr(10), '' ORDER BY ts, id) AS history FROM m GROUP BY session_id")
def history_string(spark, d):
    return prompt.history_strings(messages(spark, d), "session_id", ["timestamp", "id"])


@query(M + "SELECT session_id, id, (id > 0) AND (len(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda w: w <> '')) <= 4 OR length(content) <= 25) AS condense FROM m WHERE role = 'user'")
def condense_gate(spark, d):
    return messages(spark, d).where("role = 'user'").select("session_id", "id", prompt.needs_condensing(F.col("content"), F.col("id") > 0).alias("condense"))


@query(M + ", n AS (SELECT DISTINCT session_id FROM m) SELECT * FROM s UNION ALL SELECT session_id, 'new', 0, 'guest' FROM n WHERE session_id NOT IN (SELECT session_id FROM s)")
def session_insert_ignore(spark, d):
    new = messages(spark, d).select(
        "session_id", F.lit("new").alias("title"), F.timestamp_seconds(F.lit(0)).alias("updated_at"), F.lit("guest").alias("username"),
    )
    return chat.inserted(sessions(spark, d), new).withColumn("updated_at", F.unix_timestamp("updated_at"))


@query(M + ", n AS (SELECT DISTINCT session_id, 'named' AS title, 9 AS updated_at, 'guest' AS username FROM m WHERE CAST(session_id AS BIGINT) % 4 = 0) SELECT coalesce(s.session_id, n.session_id) AS session_id, coalesce(n.title, s.title) AS title, coalesce(n.updated_at, s.updated_at) AS updated_at, CASE WHEN s.session_id IS NOT NULL THEN s.username ELSE n.username END AS username FROM s FULL JOIN n ON s.session_id = n.session_id")
def session_title_upsert(spark, d):
    new = messages(spark, d).where("cast(session_id as bigint) % 4 = 0").select(
        "session_id", F.lit("named").alias("title"), F.timestamp_seconds(F.lit(9)).alias("updated_at"), F.lit("guest").alias("username"),
    ).distinct()
    return chat.renamed(sessions(spark, d), new).withColumn("updated_at", F.unix_timestamp("updated_at"))


@query(M + f", a AS (SELECT session_id, title, updated_at, coalesce(username, 'user') AS username FROM s UNION ALL SELECT session_id, {SHORT.format('content')}, ts, 'user' FROM {FIRST} WHERE session_id NOT IN (SELECT session_id FROM s)) SELECT a.session_id, CASE WHEN title = 'Sesi Riwayat' AND f.content IS NOT NULL THEN {SHORT.format('f.content')} ELSE title END AS title, updated_at, username FROM a LEFT JOIN {FIRST} f ON f.session_id = a.session_id")
def session_migration(spark, d):
    return chat.migrated(messages(spark, d), sessions(spark, d)).select("session_id", "title", _secs("updated_at"), "username")


@query(M + "SELECT session_id, id, 'message' AS kind FROM m WHERE session_id <> '7' UNION ALL SELECT session_id, NULL, 'session' FROM s WHERE session_id <> '7'")
def session_delete(spark, d):
    left, kept = chat.deleted(messages(spark, d), sessions(spark, d), "7")
    return left.select("session_id", "id", F.lit("message").alias("kind")).unionByName(kept.select(
        "session_id", F.lit(None).cast("long").alias("id"), F.lit("session").alias("kind"),
    ))


@query(M + "SELECT session_id, title, updated_at, coalesce(username, 'user') AS username FROM s")
def session_backfill(spark, d):
    return chat.backfilled(sessions(spark, d)).withColumn("updated_at", F.unix_timestamp("updated_at"))


@query(M + "SELECT count(*) FILTER (WHERE username IS DISTINCT FROM 'user1') AS refused, count(*) AS n FROM s")
def ownership_guard(spark, d):
    return sessions(spark, d).agg(F.count_if(chat.refused("user1")).alias("refused"), F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN u = '' OR p = '' THEN 'username and password are required' WHEN length(u) < 3 THEN 'username too short' WHEN length(p) < 6 THEN 'password too short' END AS error FROM (SELECT c_custkey, trim(substr(c_name, 1, CAST(c_custkey % 6 AS INT))) AS u, substr(c_mktsegment, 1, CAST(c_custkey % 8 AS INT)) AS p FROM customer)")
def register_validation(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.expr("substring(c_name, 1, cast(c_custkey % 6 as int))").alias("u"),
        F.expr("substring(c_mktsegment, 1, cast(c_custkey % 8 as int))").alias("p"),
    )
    return c.select("c_custkey", chat.registration_error(F.col("u"), F.col("p")).alias("error"))


@query("SELECT c_custkey AS id, c_name AS username, c_mktsegment AS role FROM customer WHERE c_name = (SELECT min(c_name) FROM customer) AND sha256(c_name) = sha256((SELECT min(c_name) FROM customer))")
def login_lookup(spark, d):
    users = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), T.password_hash(F.col("c_name")).alias("password"),
        F.col("c_mktsegment").alias("role"),
    )
    name = users.agg(F.min("username")).first()[0]
    return chat.login(users, name, name)


_HITS = "SELECT conv_id AS query_id, turn + 1 AS rank, text AS content, 'f' || (turn % 3) || '.pdf' AS source_file FROM conversations"


def _hits(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("text").alias("content"),
        F.concat(F.lit("f"), (F.col("turn") % 3).cast("string"), F.lit(".pdf")).alias("source_file"),
    )


@query(f"SELECT query_id, string_agg('[Dokumen ' || rank || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM ({_HITS}) GROUP BY query_id")
def prompt_context(spark, d):
    return prompt.context_blocks(_hits(spark, d), "query_id")


# the whole prompt, written out
_PROMPT = """
You answer questions about a collection of documents.

Tasks:
1. Answer the question from the context below alone, factually and precisely.
2. Bring together what different documents say about it.
3. Write out specific details: dates, numbers, names and places.
4. Use lists where there is much to list.
5. Come to the point and don''t repeat anything.
6. If the question is so broad that the context holds several procedures or choices for it, don''t describe them all: give a short introduction, list the choices, and ask which one is meant.

If the context doesn''t hold the answer, reply exactly: No information about this was found in the documents.
Don''t invent facts, use no other knowledge, and answer in the language of the question.

CONTEXT:
' || text || '

PERTANYAAN:
' || substr(text, 1, 20) || '

JAWABAN:
"""


@query(f"SELECT item_id, '{_PROMPT}' AS prompt FROM benchmark")
def prompt_build(spark, d):
    return table(spark, d, "benchmark").select("item_id", prompt.prompt(F.substring("text", 1, 20), F.col("text")).alias("prompt"))


@query(f"SELECT query_id, string_agg(replace(source_file, '.pdf', '') || '|' || source_file, ',' ORDER BY r) AS sources FROM (SELECT query_id, source_file, min(rank) AS r FROM ({_HITS}) GROUP BY ALL) GROUP BY query_id")
def source_dedupe(spark, d):
    return chat.sources_of(_hits(spark, d), "query_id").select(
        "query_id", F.array_join(F.transform("sources", lambda s: F.concat(s.title, F.lit("|"), s.file)), ",").alias("sources"),
    )


# -- ingestion and evaluation ---------------------------------------------------


@query("SELECT count(*) AS total_documents, count(*) FILTER (WHERE doc_id % 9 <> 0) AS successful, count(*) FILTER (WHERE doc_id % 9 = 0) AS failed, CAST(sum(n_chars // 1000) AS BIGINT) AS total_chunks FROM documents")
def ingest_summary(spark, d):
    return ingest.rollup(_docs(spark, d).select(F.when(F.col("doc_id") % 9 == 0, "bad").alias("error"), F.expr("n_chars div 1000").alias("chunk_count")))


@query("SELECT source, CAST(round_even(avg(n_chars), 0) AS DOUBLE) AS avg_size FROM documents GROUP BY source")
def avg_chunk_size(spark, d):
    return ingest.chunk_sizes(_docs(spark, d).select(F.col("source").alias("source_file"), F.col("n_chars").alias("char_count"))).select(
        F.col("source_file").alias("source"), F.col("avg_chunk_size").alias("avg_size"),
    )


def _candidates(spark, d):
    asked = _asked(spark, d, "vec_id % 50 = 0")
    found = knn(spark, table(spark, d, "embeddings"), asked, 30, "vec_id")
    labels = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("own"))
    return found.join(labels, "vec_id").join(asked.select("query_id", "label"), "query_id").select(
        "query_id", F.col("vec_id").alias("id"), "rank", "score", (F.col("own") == F.col("label")).alias("relevant"),
    ).where("id <> query_id"), asked


_GRID = (
    f"WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT query_id, vec_id, label = ql AS relevant, {COS.format('embedding', 'qe')} AS distance FROM embeddings, q), "
    "r AS (SELECT *, round(1 - distance, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS n FROM c), g AS (SELECT CAST(k AS INT) AS top_k, CAST(s AS DOUBLE) AS min_score FROM (SELECT unnest([5, 10, 15]) AS k), (SELECT unnest([0.1, 0.2]) AS s)), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY query_id, top_k, min_score ORDER BY score DESC, n) AS place FROM r, g WHERE n <= greatest(2 * top_k, 25) AND score >= min_score AND vec_id <> query_id), "
    "h AS (SELECT query_id, top_k, min_score, min(place) AS first FROM p WHERE place <= top_k AND relevant GROUP BY ALL), "
    "e AS (SELECT g.top_k, g.min_score, round(100.0 * count(h.first) / (SELECT count(*) FROM q), 6) AS recall, round(coalesce(sum(1.0 / h.first), 0) / (SELECT count(*) FROM q), 6) AS mrr FROM g LEFT JOIN h ON h.top_k = g.top_k AND h.min_score = g.min_score GROUP BY ALL) "
)


@query(_GRID + "SELECT top_k, min_score, recall, mrr FROM e")
def eval_grid(spark, d):
    c, asked = _candidates(spark, d)
    return evaluate.grid(c, asked, min_score=(0.1, 0.2))


@query(_GRID + "SELECT top_k, min_score, recall, mrr FROM e ORDER BY mrr DESC, top_k, min_score LIMIT 1")
def eval_best_config(spark, d):
    return evaluate.best(eval_grid(spark, d))


# for each source: its documents in order of doc_id, and the keywords of its language
_CASES = "SELECT source AS query_id, doc_id, text AS content, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, CASE min(lang) OVER (PARTITION BY source) WHEN 'de' THEN ['heit', 'UNG'] ELSE ['tion', 'MENT'] END AS keywords FROM documents"
_FIRST = f"SELECT query_id, min(rank) FILTER (WHERE len(list_filter(keywords, lambda k: contains(lower(content), lower(k)))) > 0) AS first_rank FROM ({_CASES}) GROUP BY query_id"


def _cases(spark, d):
    docs = _docs(spark, d)
    words = F.when(F.col("l") == "de", F.array(F.lit("heit"), F.lit("UNG"))).otherwise(F.array(F.lit("tion"), F.lit("MENT")))
    cases = docs.groupBy(F.col("source").alias("query_id")).agg(F.min("lang").alias("l")).select("query_id", words.alias("keywords"))
    ranked = docs.select(
        F.col("source").alias("query_id"), F.col("text").alias("content"),
        F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"),
    )
    return ranked, cases


@query(f"SELECT query_id, coalesce(first_rank, 0) AS first_rank FROM ({_FIRST})")
def eval_first_hit_rank(spark, d):
    return evaluate.first_hits(*_cases(spark, d)).withColumn("first_rank", F.col("first_rank").cast("long"))


@query(f"SELECT round(100.0 * count(first_rank) / count(*), 6) AS recall, round(coalesce(sum(1.0 / first_rank), 0) / count(*), 6) AS mrr FROM ({_FIRST})")
def eval_recall_mrr(spark, d):
    return evaluate.recall_mrr(evaluate.first_hits(*_cases(spark, d)))


@query("SELECT doc_id, contains(lower(text), 'thhe') OR contains(lower(text), 'ouion') AS hit FROM documents")
def keyword_hit(spark, d):
    return _docs(spark, d).select("doc_id", evaluate.has_keyword(F.col("text"), F.array(F.lit("THHE"), F.lit("ouion"))).alias("hit"))


@query("SELECT CAST(event_id % 2 AS DOUBLE) AS temperature, round(avg(CAST(event_id % 5 AS DOUBLE)), 6) AS relevansi, round(avg(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 4.0 END), 6) AS factuality, 5.0::DOUBLE AS completeness, count(*) AS n_valid FROM events WHERE event_id % 11 <> 0 GROUP BY 1")
def judge_averages(spark, d):
    v = F.format_string(
        '{"relevansi": {"skor": %d, "alasan": "a"}, "factuality": {%s}, "completeness": {"skor": 5}}', F.col("event_id") % 5,
        F.when(F.col("event_id") % 3 == 0, '"alasan": "b"').otherwise('"skor": 4'),
    )
    e = table(spark, d, "events").select(
        (F.col("event_id") % 2).cast("double").alias("temperature"),
        F.when(F.col("event_id") % 11 == 0, "rate limited").otherwise(v).alias("json"),
    )
    return evaluate.judge_averages(e)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return retrieve_one(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id").select("rank", "doc_id", "distance", "score", "source").orderBy("rank")

