"""Chat tables (JN4-JN7, AGG1-AGG3, AGG6, AGG7, WIN1, SNK9-SNK15, TOP3-TOP5, FLT3-FLT6): functions from tables to tables; the caller writes the result.

Messages: id, session_id, role, content, sources, timestamp. Sessions: session_id, title, updated_at, username.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import password_hash, shortened, u_trim
from ..schemas import SOURCES

OLD_TITLE = "Sesi Riwayat"


def list_sessions(messages: DataFrame, sessions: DataFrame, username: str = "guest") -> DataFrame:
    """GET history: sessions of a user with a user message, newest first by their first message: session_id, title, ts."""
    mine = sessions.where(F.col("username") == username).select("session_id", "title")
    first = messages.where("role = 'user'").groupBy("session_id").agg(
        F.min("timestamp").alias("ts"), F.min_by("content", F.struct("timestamp", "id")).alias("content"),
    )
    return first.join(mine, "session_id").select(
        "session_id", F.coalesce(F.when(F.col("title") != "", F.col("title")), shortened(F.col("content"))).alias("title"), "ts",
    ).orderBy(F.desc("ts"), "session_id")


def decoded_sources(c: Column) -> Column:
    """PRJ17: the sources of an answer, an array of title and file; null if the text isn't valid JSON."""
    return F.from_json(c, SOURCES)


def transcript(messages: DataFrame, session_id, sessions: DataFrame | None = None, username: str | None = None) -> DataFrame:
    """GET history/{id}: role, content and decoded sources, oldest first; sources that aren't valid JSON are null. With sessions and a username, only for its owner."""
    if sessions is not None:
        checked(sessions, session_id, username)
    own = messages.where(F.col("session_id") == session_id).orderBy("timestamp", "id")
    return own.select("id", "role", "content", decoded_sources(F.col("sources")).alias("sources"), "timestamp")


def history_window(messages: DataFrame, n: int = 6, order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """WIN1: the n messages before the latest one of each session."""
    w = Window.partitionBy("session_id").orderBy(*(F.desc(c) for c in order))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back").between(2, n + 1)).drop("back")


def refused(username: str) -> Column:
    """FLT4 as a condition on a session: another's, or no one's."""
    return ~F.col("username").eqNullSafe(F.lit(username))


def existing(ids: DataFrame, sessions: DataFrame) -> DataFrame:
    """JN7: the session ids that sessions hold."""
    return ids.join(sessions.select("session_id"), "session_id", "left_semi")


def checked(sessions: DataFrame, session_id, username: str | None) -> None:
    """FLT4: raises PermissionError unless the user may see and change the session; no user means no check."""
    if username is not None and not allowed(sessions, session_id, username):
        raise PermissionError(f"session {session_id} isn't {username}'s")


def allowed(sessions: DataFrame, session_id, username: str) -> bool:
    """FLT4: a missing session passes; one without an owner, or another's, doesn't."""
    own = sessions.where(F.col("session_id") == session_id)
    return own.where(refused(username)).isEmpty()


def appended(messages: DataFrame, rows: DataFrame) -> DataFrame:
    """SNK9: rows (session_id, role, content, sources, timestamp) get the next ids."""
    top = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = rows.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.row_number().over(Window.orderBy("timestamp", "role")))
    return messages.unionByName(new.select(messages.columns))


def inserted(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """SNK10: only sessions whose id isn't there yet."""
    return sessions.unionByName(rows.dropDuplicates(["session_id"]).join(sessions.select("session_id"), "session_id", "left_anti").select(sessions.columns))


def renamed(sessions: DataFrame, changes: DataFrame, username: str | None = None) -> DataFrame:
    """SNK11: changes (session_id, title, updated_at, username): a known session gets title and time and keeps its owner, an unknown one is made. With a username, only sessions of that owner may be changed."""
    if username is not None and not existing(sessions.where(refused(username)), changes).isEmpty():
        raise PermissionError(f"a session isn't {username}'s")
    new = changes.select("session_id", F.col("title").alias("t"), F.col("updated_at").alias("u"), F.col("username").alias("n"))
    both = sessions.join(new, "session_id", "full")
    known = F.col("t").isNotNull() | F.col("u").isNotNull()
    old = F.col("title").isNotNull() | F.col("updated_at").isNotNull() | F.col("username").isNotNull()
    return both.select(
        "session_id", F.when(known, F.col("t")).otherwise(F.col("title")).alias("title"),
        F.when(known, F.col("u")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(old, F.col("username")).otherwise(F.col("n")).alias("username"),
    )


def deleted(messages: DataFrame, sessions: DataFrame, session_id, username: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK14: both tables without one session; with a username, only for its owner."""
    checked(sessions, session_id, username)
    other = ~F.col("session_id").eqNullSafe(F.lit(session_id))
    return messages.where(other), sessions.where(other)


def orphans(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """JN6: session ids of user messages that NOT IN finds: none if sessions hold a null id; first message and time of each."""
    known = sessions.select("session_id")
    has_null = known.where("session_id IS NULL").limit(1).agg((F.count("*") > 0).alias("has_null"))
    lost = messages.where("role = 'user'").join(known, "session_id", "left_anti").crossJoin(F.broadcast(has_null)).where("NOT has_null").drop("has_null")
    lost = lost.where("session_id IS NOT NULL")
    return first_user_message(lost)


def first_user_message(messages: DataFrame) -> DataFrame:
    """AGG2: session_id, content and ts of each session's first user message."""
    return messages.where("role = 'user'").groupBy("session_id").agg(
        F.min_by("content", F.struct("timestamp", "id")).alias("content"), F.min("timestamp").alias("ts"),
    )


def backfilled(sessions: DataFrame) -> DataFrame:
    """SNK12: sessions without an owner get the first user."""
    return sessions.withColumn("username", F.coalesce("username", F.lit("user")))


def migrated(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """The start-up migration: sessions for orphans (SNK10), owners for sessions without (SNK12), titles for unnamed ones (SNK13)."""
    made = orphans(messages, sessions).select(
        "session_id", shortened(F.col("content")).alias("title"), F.col("ts").alias("updated_at"),
        F.lit(None).cast("string").alias("username"),
    )
    all_ = backfilled(sessions.unionByName(made))
    first = first_user_message(messages).select("session_id", shortened(F.col("content")).alias("named"))
    return all_.join(first, "session_id", "left").withColumn(
        "title", F.when((F.col("title") == OLD_TITLE) & F.col("named").isNotNull(), F.col("named")).otherwise(F.col("title")),
    ).drop("named")


def sources_of(hits: DataFrame, key: str, rank: str = "rank", file: str = "source_file") -> DataFrame:
    """AGG6: (key, sources): each file once, in order of its best rank, with its title."""
    from ..functions.text import file_title

    best = hits.where(F.col(file).isNotNull() & (F.col(file) != "")).groupBy(key, file).agg(F.min(rank).alias("r"))
    rows = F.sort_array(F.collect_list(F.struct("r", F.struct(file_title(F.col(file)).alias("title"), F.col(file).alias("file")).alias("s"))))
    return best.groupBy(key).agg(F.transform(rows, lambda x: x.s).alias("sources"))


def registration_error(username: Column, password: Column) -> Column:
    """FLT5: why a registration is refused, or null."""
    u = u_trim(F.coalesce(username, F.lit("")))
    p = F.coalesce(password, F.lit(""))
    return F.when((u == "") | (p == ""), "username and password are required").when(F.length(u) < 3, "username too short").when(F.length(p) < 6, "password too short")


def registered(users: DataFrame, username: str, password: str, role: str = "user") -> DataFrame:
    """POST register (SNK15): users with a new one; an invalid or taken name is an error."""
    spark = users.sparkSession
    row = spark.createDataFrame([(username, password)], "u string, p string").select(
        registration_error(F.col("u"), F.col("p")).alias("e"), u_trim(F.col("u")).alias("u"), password_hash(F.col("p")).alias("p"),
    ).first()
    if row.e:
        raise ValueError(row.e)
    if not users.where(F.col("username") == row.u).isEmpty():
        raise ValueError("username is taken")
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("t")).first().t
    return users.unionByName(spark.createDataFrame([(top + 1, row.u, row.p, role)], users.schema))


def seeded(users: DataFrame, first: list[tuple[str, str, str]]) -> DataFrame:
    """AGG3, SNK15: the given users (name, password, role), only if there is none yet."""
    if not users.isEmpty():
        return users
    rows = users.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(first, 1)], "id bigint, username string, password string, role string")
    return users.unionByName(rows.withColumn("password", password_hash(F.col("password"))))


def login(users: DataFrame, username: str, password: str) -> DataFrame:
    """FLT6: the matching user, or no row."""
    return users.where((F.col("username") == username) & (F.col("password") == F.sha2(F.lit(password), 256))).select("id", "username", "role")


def ask(spark, store: DataFrame, messages: DataFrame, session_id: str, question: str, embedder, generator, settings=None) -> tuple[str, DataFrame]:
    """POST chat: history, condensing, retrieval, prompt, generation, sources. Returns the answer and messages with both new rows."""
    from ..config import Settings
    from ..operators import prompt as P
    from ..operators.similarity import retrieve
    from ..sources.providers import embed_query

    s = settings or Settings()
    if question == "":
        raise ValueError("the message is empty")
    now = F.current_timestamp()
    said = spark.createDataFrame(
        [(session_id, "user", question, None)], "session_id string, role string, content string, sources string",
    ).withColumn("timestamp", now)
    messages = appended(messages, said)
    past = history_window(messages.where(F.col("session_id") == session_id), s.history_window)
    history = P.history_strings(past, "session_id", ["timestamp", "id"]).first()
    one = spark.createDataFrame([(question, history.history if history else "")], "q string, h string")
    gate = one.select(P.needs_condensing(F.col("q"), F.col("h") != "").alias("g"), P.condensing_prompt(F.col("q"), F.col("h")).alias("p")).first()
    query = question
    if gate.g:
        from ..functions.text import unquote

        try:
            got = spark.createDataFrame([(generator.generate(gate.p, s.temperature, s.max_tokens),)], "t string").select(unquote(F.col("t"))).first()[0]
            query = got or question
        except Exception:  # condensing is a help, not a need
            query = question
    asked = spark.createDataFrame([(1, query, embed_query(embedder, query))], "query_id int, query string, embedding array<float>")
    hits = retrieve(spark, store, asked, s.top_k, s.min_score).join(store.select("chunk_id", "source_file"), "chunk_id")
    context = P.context_blocks(hits, "query_id").first()
    if context is None:
        answer, sources = P.NOT_FOUND, None
    else:
        text = spark.createDataFrame([(query, context.context)], "q string, c string").select(P.prompt(F.col("q"), F.col("c"))).first()[0]
        try:
            answer = generator.generate(text, s.temperature, s.max_tokens)
            found = sources_of(hits, "query_id").select(F.to_json("sources").alias("j")).first()
            sources = found.j if found else None
        except Exception as e:
            from ..functions.text import generation_error

            answer, sources = spark.createDataFrame([(str(e),)], "e string").select(generation_error(F.col("e"))).first()[0], None
    told = spark.createDataFrame(
        [(session_id, "assistant", answer, sources)], "session_id string, role string, content string, sources string",
    ).withColumn("timestamp", now)
    return answer, appended(messages, told)
