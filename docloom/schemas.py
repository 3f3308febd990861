"""Fixed schemas (SNK18, D1-D18)."""

CHUNK = "chunk_id STRING, source_file STRING, document_id STRING, chunk_index INT, content STRING, char_count INT"
VECTOR = CHUNK + ", embedding ARRAY<FLOAT>"
PAGE = "page_num INT, page_type STRING, psm_used INT, char_count INT"
MESSAGES = "id BIGINT, session_id STRING, role STRING, content STRING, sources STRING, timestamp TIMESTAMP"
SESSIONS = "session_id STRING, title STRING, updated_at TIMESTAMP, username STRING"
USERS = "id BIGINT, username STRING, password STRING, role STRING"
SOURCES = "ARRAY<STRUCT<title STRING, file STRING>>"
LOG = "filename STRING, seq BIGINT, ts TIMESTAMP, level STRING, message STRING"
BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
_VERDICT = "STRUCT<skor: INT, alasan: STRING>"
JUDGE = f"relevansi {_VERDICT}, factuality {_VERDICT}, completeness {_VERDICT}"
EVAL_CASE = "query STRING, expected_keywords ARRAY<STRING>, category STRING"


def migrated(df, schema: str):
    """A table with all columns of a schema: missing ones are null (the ALTER TABLE ADD COLUMN of a relational store)."""
    return df.sparkSession.createDataFrame([], schema).unionByName(df, allowMissingColumns=True)
