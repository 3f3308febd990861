"""Literal cases for rules that the fixture tables don't reach, and the file, store, chat and stream paths."""

import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.config import Settings, load_config
from docloom.functions import text as T
from docloom.operators import chunking, cleaning, images, pages, prompt, store
from docloom.operators.rerank import boost, rescored
from docloom.operators.similarity import cosine, knn, retrieve
from docloom.plans import catalog, chat, evaluate, ingest
from docloom.schemas import MESSAGES, SESSIONS, USERS, VECTOR
from docloom.sources import decoders, providers, tables
from docloom.streaming import ingest as stream


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*(F.col(c) for c in df.columns))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, ""), ("  \n ", ""), ("a\r\nb\rc", "a\nb\nc"), ("a b\x00c", "a bc")],
)
def test_normalize(spark, raw, want):
    assert one(spark, cleaning.normalize, raw) == want


def test_dehyphenate(spark):
    assert one(spark, cleaning.dehyphenate, "café-\nétat a-\nb-\nc") == "caféétat ab-\nc"


@pytest.mark.parametrize(
    ("line", "kept"),
    [
        ("", True), ("   ", True), ("ab", False), ("abc", True), ("Logout", True), ("my DASHBOARD", False), ("go Back", False), ("Back to it", True), ("x DEV AREALogout", False),
        ("ab+++", False), ("ab++", True), ("abcdefg%%%", True), ("abcdef%%%%", False), ("1234567890123456789012345678901", False), ("123456789012345678901234567890", True),
        ("aa bb cc long longer", True), ("aa bb cc dd longer", False), ("aa bb cc dd", True),
    ],
)
def test_lines(spark, line, kept):
    assert one(spark, cleaning.keeps_line, line) is kept


def test_split_ui_words(spark):
    assert one(spark, lambda c: cleaning.keeps_line(c, strict=False), "Logout") is False


def test_artifacts(spark):
    t = "- 12 -\nSALINAN\nsalinan\nttd.\nSalinan sesuai dengan aslinya\nx\n\nrest"
    assert one(spark, cleaning.drop_artifacts, t) == "\nsalinan\n\n\n\nrest"
    assert one(spark, cleaning.drop_artifacts, "a Salinan sesuai dengan aslinya b\n") == "a "


@pytest.mark.parametrize(
    ("raw", "want"),
    [("BAB I ....... 5", "BAB I  5"), ("BAB I ..oooo.. 7", "BAB I  7"), ("x .. abc", "x "), ("x .. 12 st", "x .. 12 st"), ("x ..oooo", "x "), ("a .... b", "a "), ("plain", "plain")],
)
def test_leaders(spark, raw, want):
    assert one(spark, cleaning.clean_leaders, raw) == want


def test_whitespace(spark):
    assert one(spark, cleaning.collapse, "a\n\n\n\nb   c") == "a\n\nb c"
    assert one(spark, cleaning.trim_lines, " a \n \n \nb ") == "a\n\n\nb"
    assert one(spark, cleaning.clean, "a line of text-\nmore\n\n\n\n  end here ") == "a line of textmore\n\nend here"


def test_metrics_of_nothing(spark):
    for c, v in {"char_count": 0, "word_count": 0, "line_count": 0, "noise_ratio": 0.0}.items():
        assert one(spark, lambda t, c=c: cleaning.text_metrics(t)[c], None) == v


def test_split_text():
    assert [len(c) for c in chunking.split_text("a" * 2500)] == [1000, 1000, 800]
    assert chunking.split_text("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert chunking.split_text("one\n\ntwo", 100, 10) == ["one\n\ntwo"]
    assert chunking.split_text("x" * 999) == ["x" * 999] and [len(c) for c in chunking.split_text("x" * 1001)] == [1000, 151]
    assert chunking.chunk_rows(" \n", 10, 2, ("",)) == [] and chunking.chunk_rows(None, 10, 2, ("",)) == []
    assert all(len(c) <= 50 for c in chunking.split_text("é, ü. ß\n" * 90, 50, 10))
    with pytest.raises(ValueError):
        chunking.split_text("abc", 3, 4)


def test_chunk_ids_and_table_function(spark):
    docs = spark.createDataFrame([("f.pdf", "d", "x" * 2500), ("g.pdf", "e", None)], "source_file string, document_id string, text string")
    a, b = (sorted(r.chunk_id for r in chunking.chunk_documents(docs.repartition(n)).collect()) for n in (1, 3))
    assert a == b and len(a) == 3
    assert len({r.chunk_id for r in chunking.chunk_documents(docs, random_ids=True).collect()} & set(a)) == 0
    chunking.register(spark)
    docs.createOrReplaceTempView("docs_for_chunks")
    assert spark.sql("SELECT c.* FROM docs_for_chunks, LATERAL chunk(text) c").count() == 3


def test_rerank_rules(spark):
    q, c = "Jadwal herregistrasi kapan", "JADWAL tanggal kalender herregistrasi mei"
    assert one(spark, lambda a, b: F.round(boost(a, b), 6), q, c) == round(0.15 + 0.05 * 5 + 0.02 * 2, 6)
    assert one(spark, lambda a, b: F.round(boost(a, b), 6), "go go the the a", "the go") == 0.04
    assert one(spark, lambda a, b: rescored(a, b, F.lit(0.58)), "word", "a word") == 0.6
    assert one(spark, lambda a, b: F.round(boost(a, b), 6), "herregistrasi update", "herregistrasi") == 0.12


def test_small_functions(spark):
    assert one(spark, T.shortened, "x" * 30) == "x" * 30 and one(spark, T.shortened, "x" * 31) == "x" * 30 + "..."
    assert one(spark, T.unquote, ' "a b" ') == "a b" and one(spark, T.unquote, '"') == "" and one(spark, T.unquote, '"x') == '"x'
    assert one(spark, T.file_title, "a.pdf.pdf") == "a"
    assert one(spark, lambda q: prompt.needs_condensing(q, F.lit(True)), "a b c d") and not one(spark, lambda q: prompt.needs_condensing(q, F.lit(False)), "a")
    assert not one(spark, lambda q: prompt.needs_condensing(q, F.lit(True)), "one two three four 5 123456") and one(spark, lambda q: prompt.needs_condensing(q, F.lit(True)), "aa bb cc dd ee ff gg hh i")


def test_config(tmp_path):
    assert load_config(roots=(str(tmp_path),)) == Settings()
    (tmp_path / "config.yaml").write_text("retrieval:\n  top_k: 0\n  min_score: 0.0\nchat: {history_window: 2}\n")
    s = load_config(roots=(str(tmp_path),))
    assert (s.top_k, s.min_score, s.history_window, s.chunk_size) == (0, 0.0, 2, 1000)
    assert s.given(top_k=None).top_k == 0


def vectors(spark, rows):
    return spark.createDataFrame([(f"c{i}", f"f{i % 2}.pdf", f"d{i % 2}", i, f"text {i}", 6, [float(x) for x in v]) for i, v in rows], VECTOR)


def test_knn(spark):
    s = vectors(spark, [(0, [1, 0]), (1, [0, 1]), (2, [1, 1]), (3, [0, 0]), (4, [2, 0])]).unionByName(spark.createDataFrame([("n", None, None, None, None, None, None)], VECTOR))
    q = spark.createDataFrame([(1, "q", [1.0, 0.0]), (2, "q", [0.0, 3.0])], "query_id int, query string, embedding array<float>")
    for block in (1, 1024):
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.distance) for r in knn(spark, s, q, 3, block_bytes=block).collect()}
        assert got[1, 1] == ("c0", 0.0) and got[1, 2] == ("c4", 0.0) and got[2, 1] == ("c1", 0.0) and got[1, 3][0] == "c2" and len(got) == 6
    assert knn(spark, s.limit(0), q, 3).count() == 0 and knn(spark, s, q.limit(0), 3).count() == 0
    assert retrieve(spark, s, q, 2, 0.9).count() == 3
    d = s.where("chunk_id = 'c2'").select(F.round(cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))), 6)).first()[0]
    assert d == 0.707107


def searched(spark, keys, vectors, asked, k):
    """(query, key, distance) rows of the search's first stage for one batch, and the most bytes that Python's and numpy's allocations came to."""
    runs = []

    class Store:
        dtypes = [("chunk_id", "bigint"), ("embedding", "array<float>")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            runs.append(run)
            return spark.createDataFrame([], schema)

    knn(spark, Store(), asked, k)
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.FixedSizeListArray.from_arrays(vectors.ravel(), vectors.shape[1]).cast(pa.list_(pa.float32()))], names=["chunk_id", "embedding"])
    list(runs[0](iter([batch.slice(0, 10)])))
    tracemalloc.start()
    try:
        found = list(runs[0](iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    return [tuple(r.values()) for b in found for r in b.to_pylist()], most


def test_knn_memory(spark):
    r = np.random.default_rng(5)
    asked = lambda n, width: spark.createDataFrame([(i, r.normal(size=width).tolist()) for i in range(n)], "query_id int, embedding array<float>")
    q = asked(260, 16)
    used = {n: searched(spark, np.arange(n), r.normal(size=(n, 16)).astype("f4"), q, 30)[1] for n in (2_000, 20_000)}
    assert used[20_000] < 2 * used[2_000], used
    q = asked(3, 2048)
    used = {n: searched(spark, np.arange(n), r.normal(size=(n, 2048)).astype("f4"), q, 5)[1] for n in (500, 4_000)}
    assert used[4_000] < 2 * used[500], used


@pytest.mark.parametrize("k", [1, 30, 1500, 5000])
def test_knn_slices(spark, k):
    """Rows of several slices, equal ones in different slices, in no order of their keys; a zero vector."""
    r = np.random.default_rng(6)
    m = np.tile(r.integers(-2, 3, (900, 6)), (4, 1)).astype("f4")
    m[7] = 0
    keys = r.permutation(len(m))
    q = r.integers(-2, 3, (300, 6)) + 0.5
    got, _ = searched(spark, keys, m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<float>"), k)
    want = []
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    fine = m.any(1)
    for i, d in enumerate(np.round(1 - unit(q) @ unit(m[fine].astype(float)).T, 6)):
        want += [(i, key, x) for x, key in sorted(zip((d + 0.0).tolist(), keys[fine].tolist()))[:k]]
    assert sorted(got) == sorted(want)


def test_store(spark, tmp_path):
    st = store.VectorStore(spark, str(tmp_path))
    assert st.read().count() == 0 and store.documents_of(st.read()).count() == 0
    st.upsert(vectors(spark, [(0, [1, 0]), (1, [0, 1])]))
    st.upsert(vectors(spark, [(2, [1, 1])]))  # of f0.pdf: replaces c0
    assert sorted(r.chunk_id for r in st.read().collect()) == ["c1", "c2"]
    st.upsert(vectors(spark, [(4, [1, 1])]), replace=None)
    st.upsert(vectors(spark, []))
    assert st.stats().first().total_chunks == 3
    st.delete_by_document("d1")
    assert sorted(r.chunk_id for r in st.read().collect()) == ["c2", "c4"]
    with pytest.raises(ValueError):
        st.upsert(vectors(spark, [(9, [1])]).withColumn("embedding", F.lit(None).cast("array<float>")))
    st.clear()
    st.vacuum(1)
    assert st.read().count() == 0 and len(st._versions()) == 1


def test_embedding_batches():
    e, slept = providers.HashEmbedder(8), []

    class Flaky:
        calls = 0

        def embed(self, texts, task):
            Flaky.calls += 1
            if Flaky.calls < 3:
                raise OSError("busy")
            return e.embed(texts)

    assert len(providers.embed_all(Flaky(), ["a"] * 5, sleep=slept.append)) == 5 and slept == [2.0, 4.0]
    assert providers.embed_all(e, []) == []
    with pytest.raises(ValueError):
        providers.embed_all(e, ["a"], batch=0)
    with pytest.raises(ValueError):
        providers.embed_query(e, " ")

    class Short:
        def embed(self, texts, task):
            return []

    with pytest.raises(ValueError):
        providers.embed_all(Short(), ["a"])


def test_hash_embedder_is_the_expression(spark):
    t = "Ein Wort ein wort über alles"
    a = providers.HashEmbedder(16).embed([t])[0]
    b = one(spark, lambda c: providers.hash_embedding(c, 16), t)
    assert a == pytest.approx(b)


class TextPages:
    """A decoder for tests: a file is text, form feeds part its pages; a page's first letter says how many lines it has."""

    def pages(self, content, dpi):
        if content.startswith(b"bad"):
            raise ValueError("not a document")
        return content.split(b"\f")

    def ruled_share(self, image):
        return {b"T": 0.01, b"M": 0.003}.get(image[:1], 0.0)

    def text(self, image, language, psm):
        if image == b"fail":
            raise OSError("no text")
        return image.decode()


def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_bytes(b"Table one\fMixed two\f\ffail")
    (src / "b.pdf").write_bytes(b"bad")
    (src / "c.PDF").write_bytes(b"not matched")
    return str(src)


def test_ingestion(spark, tmp_path):
    src = folder(tmp_path)
    files = tables.documents_in(spark, src)
    texts = ingest.to_texts(files, TextPages).cache()
    a = texts.where("source_file = 'a.pdf'").first()
    assert a.text == "Table one\n\nMixed two" and a.page_count == 4
    assert [(p.page_num, p.page_type, p.psm_used, p.char_count) for p in a.pages] == [(1, "table", 6, 9), (2, "mixed", 3, 9), (3, "text", 6, 0), (4, "text", 6, 0)]
    assert "not a document" in texts.where("source_file = 'b.pdf'").first().error
    chunks = ingest.to_chunks(texts)
    docs = ingest.summary(texts, chunks)
    assert ingest.rollup(docs).first().asDict() == {"total_documents": 2, "successful": 1, "failed": 1, "total_chunks": 1}
    for f, name in ((ingest.write_markdown, "md"), (ingest.write_chunks, "json")):
        f(texts if name == "md" else chunks, str(tmp_path / name))
    ingest.write_summary(docs, str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    (tmp_path / "chunks_a.json").write_text(json.dumps([r.asDict() for r in chunks.collect()], indent=2))
    assert tables.chunk_files(spark, str(tmp_path)).drop("chunk_id").collect() == chunks.drop("chunk_id").collect()
    with pytest.raises(FileNotFoundError):
        tables.chunk_files(spark, src)
    with pytest.raises(ValueError):
        tables.one_document(spark, src + "/x.txt")
    with pytest.raises(FileNotFoundError):
        tables.one_document(spark, src + "/x.pdf")
    assert tables.one_document(spark, src + "/c.PDF").count() == 1
    st = store.VectorStore(spark, str(tmp_path / "store"))
    ingest.rebuild(st, files, TextPages, providers.HashEmbedder, str(tmp_path / "work"))
    assert st.read().count() == 1 and "a.pdf" in ingest.sample_markdown(st.read())
    ingest.export(st.read(), str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export")).first().vector_dimension == 64


def test_stream(spark, tmp_path):
    src, st = folder(tmp_path), store.VectorStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        stream.ingest(spark, src, st, TextPages, providers.HashEmbedder, str(tmp_path / "work")).awaitTermination()
        assert st.read().count() == 1
    log = stream.read_log(spark, str(tmp_path / "work"))
    lines = [r.message for r in stream.log_of(log, "a.pdf").collect()]
    assert lines[0] == "Memulai pemrosesan dokumen: a.pdf" and lines[1] == "Halaman 1: table (PSM 6), 9 karakter" and len(lines) == 8
    assert lines[5] == "Ekstraksi selesai: 20 karakter." and lines[-1] == "SUCCESS: a.pdf siap dicari."
    assert stream.log_of(log, "b.pdf").collect()[-1].message.startswith("CRITICAL ERROR: ValueError") and stream.log_of(log, "zz").first().message == stream.WAITING
    assert stream.safe_name("../../etc/x y.pdf") == "x y.pdf"


class Choosy(providers.HashEmbedder):
    """Fails for a text with the word poison."""

    def embed(self, texts, task=""):
        if any("poison" in t for t in texts):
            raise OSError("refused")
        return super().embed(texts)


def test_stream_isolates_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(providers.time, "sleep", lambda _: None)
    src = str(tmp_path / "in")
    for name, text in (("../up/good.pdf", b"Good text"), ("sick.pdf", b"poison"), ("none.pdf", b" ")):
        stream.land(spark, src, name, text)
    stream.land(spark, src, "good.pdf", b"Better text")  # replaces the older one
    assert [r.path.rsplit("/", 1)[1] for r in tables.document_names(tables.documents_in(spark, src)).collect()] == ["good.pdf", "none.pdf", "sick.pdf"]
    st = store.VectorStore(spark, str(tmp_path / "store"))
    stream.ingest(spark, src, st, TextPages, Choosy, str(tmp_path / "work")).awaitTermination()
    assert [r.content for r in st.read().collect()] == ["Better text"]
    log = stream.read_log(spark, str(tmp_path / "work"))
    last = {f: stream.log_of(log, f).collect()[-1].message for f in ("good.pdf", "sick.pdf", "none.pdf")}
    assert last["good.pdf"].startswith("SUCCESS") and last["sick.pdf"].startswith("CRITICAL ERROR: ") and last["none.pdf"].startswith("ERROR: ")
    assert "warning" in {r.level for r in log.where("filename = 'none.pdf'").collect()}


def test_live_messages(spark, tmp_path):
    folder, schema = str(tmp_path / "m"), "id bigint, content string"
    spark.createDataFrame([(1, "a")], schema).write.parquet(folder)
    q = stream.live_messages(spark, folder, schema).writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("live").collect()] == [(1, "a")]


def test_images():
    white = np.full((60, 90), 255, np.uint8)
    assert images.crop_border(white, 0.02).shape == (58, 88) and images.crop_border(white, 0).shape == (60, 90)
    assert images.gray(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8)).tolist() == [[76, 150, 29, 9]]
    assert (images.smooth(white) == 255).all() and (images.threshold(white) == 255).all()
    dot = white.copy()
    dot[30, 40] = 0
    assert images.threshold(dot)[30, 40] == 0 and (images.threshold(dot) == 0).sum() == 1
    gap = np.zeros((6, 6), np.uint8)
    gap[:, 0:2] = gap[:, 3:] = 255
    assert (images.closed(gap) == 255).all()
    wide = np.zeros((6, 6), np.uint8)
    wide[:, 0:2] = wide[:, 5:] = 255
    assert (images.closed(wide) == wide).all()
    # edges of a step and runs of 40
    step = np.zeros((50, 80), np.uint8)
    step[25:] = 255
    assert images._long_runs(images.edges(step) > 0, 40) == 80 and images.ruled_share(step) == 80 / 4000
    assert images.ruled_share(step[:, :39]) == 0 and images.ruled_share(white) == 0
    assert images._long_runs(np.array([[1, 1, 0, 1, 1, 1]], bool), 3) == 3


@pytest.mark.parametrize("degrees", [-12.0, -0.2, 0.0, 3.0, 20.0])
def test_deskew(degrees):
    page = np.full((300, 400), 255, np.uint8)
    for r in range(60, 240, 20):
        page[r : r + 6, 80:320] = 0
    askew = np.where(images.turned(page, -degrees) > 128, 255, 0).astype(np.uint8)
    assert images.skew(askew) == pytest.approx(degrees, abs=0.3)
    level = images.deskewed(askew)
    assert abs(images.skew(np.where(level > 128, 255, 0))) < 0.5
    if abs(degrees) < 0.5:
        assert level is askew
    assert images.skew(np.full((50, 50), 255, np.uint8)) == 0.0 and images.prepared(page).shape == (288, 384)


def test_decoders_and_clients(spark, monkeypatch):
    """Against stand-ins of the libraries."""
    import sys
    import types

    page = np.full((120, 200, 3), 255, np.uint8)
    page[30:34, 20:180] = 0
    seen = {}

    class Document(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            seen["closed"] = True

    class Page:
        def get_pixmap(self, dpi):
            seen["dpi"] = dpi
            return types.SimpleNamespace(samples=page.tobytes(), height=120, width=200)

    pil = types.ModuleType("PIL.Image")
    pil.fromarray = lambda a: a
    fakes = {"fitz": types.SimpleNamespace(open=lambda stream, filetype: Document([Page(), Page()])), "PIL": types.ModuleType("PIL"), "PIL.Image": pil, "pytesseract": types.SimpleNamespace(image_to_string=lambda img, lang, config: f"{img.shape} {lang} {config}")}
    for k, v in fakes.items():
        monkeypatch.setitem(sys.modules, k, v)
    d = decoders.OcrDecoder()
    got = d.pages(b"%PDF", 150)
    assert len(got) == 2 and seen == {"dpi": 150, "closed": True} and (decoders.unpack_image(got[0]) == page).all()
    assert d.ruled_share(got[0]) > 0.005 and d.text(got[0], "ind", 6) == "(116, 192) ind --psm 6 --oem 3"
    gray = page[..., 0]
    assert (decoders.unpack_image(decoders.pack_image(gray)) == gray).all()

    class Models:
        def embed_content(self, model, contents, config):
            return types.SimpleNamespace(embeddings=[types.SimpleNamespace(values=(float(len(c)), 1.0)) for c in contents])

        def generate_content(self, model, contents, config):
            return types.SimpleNamespace(text=f"{model}: {contents} {config}")

    t = types.SimpleNamespace(Content=lambda parts: parts[0], Part=types.SimpleNamespace(from_text=lambda text: text), EmbedContentConfig=lambda task_type: task_type, GenerateContentConfig=lambda temperature, max_output_tokens: (temperature, max_output_tokens))
    genai = types.ModuleType("google.genai")
    genai.Client, genai.types = (lambda api_key: types.SimpleNamespace(models=Models(), key=api_key)), t
    monkeypatch.setitem(sys.modules, "google.genai", genai)
    monkeypatch.setenv("GEMINI_API_KEY", "k")
    assert providers.embed_all(decoders.HostedEmbedder(), ["abc", "d"]) == [[3.0, 1.0], [1.0, 1.0]]
    assert decoders.HostedGenerator("m").generate("p", 0.5, 9) == "m: p (0.5, 9)"
    monkeypatch.setenv("GEMINI_API_KEY", "")
    with pytest.raises(ValueError):
        decoders.HostedGenerator()
    found = decoders.ocr_resources(spark, ("ind",), 2).collect()
    assert {r.what for r in found} == {"program tesseract", "library fitz", "library pytesseract", "library PIL", "language ind"}


class Judge:
    """Answers with the question's first word; judges by the answer's length."""

    def generate(self, prompt, temperature=0.2, max_tokens=4096):
        if "Balas dengan JSON" in prompt:
            n = len(prompt.split("JAWABAN:\n", 1)[1].split("\n", 1)[0]) % 6
            return f'{{"relevansi": {{"skor": {n}, "alasan": "x"}}, "factuality": {{"skor": 4}}, "completeness": {{"skor": {round(temperature * 10) + 2}}}}}'
        word = prompt.split("PERTANYAAN:\n", 1)[1].split()[0]
        if word == "busy":
            raise OSError("429")
        return word


def test_judge_run(spark):
    asked = spark.createDataFrame([(1, "four words", "c"), (2, "busy now", "c"), (3, "rate limit", None)], "query_id int, query string, context string").fillna("")
    got = evaluate.judged(asked, Judge, pause=0.0, sleep=lambda _: None).cache()
    assert got.count() == 6 and got.where("json IS NULL").count() == 2
    avg = {r.temperature: r.asDict() for r in evaluate.judge_averages(got).collect()}
    assert avg[0.1] == {"temperature": 0.1, "relevansi": 4.0, "factuality": 4.0, "completeness": 2.0, "n_valid": 2} and set(avg) == {0.1, 0.8}
    pages = spark.createDataFrame([("a", 3, b"text 1"), ("a", 4, b"")], "path string, page_num int, image binary")
    m = {(r.page_num, r.psm): (r.char_count, r.word_count) for r in evaluate.layout_metrics(pages, TextPages).collect()}
    assert m == {(3, 3): (6, 2), (3, 6): (6, 2), (4, 3): (0, 0), (4, 6): (0, 0)}


def test_owner_checks(spark):
    s = spark.createDataFrame([("a", "t", None, "ann"), ("b", "t", None, None)], "session_id string, title string, updated_at timestamp, username string")
    m = spark.createDataFrame([(1, "a", "user", "x", None, None)], "id bigint, session_id string, role string, content string, sources string, timestamp timestamp")
    new = s.where("session_id = 'a'").withColumn("title", F.lit("new"))
    assert chat.deleted(m, s, "a", "ann")[0].count() == 0 and chat.transcript(m, "a", s, "ann").count() == 1 and chat.renamed(s, new, "ann").where("title = 'new'").count() == 1
    for call in (lambda: chat.deleted(m, s, "a", "bob"), lambda: chat.transcript(m, "b", s, "ann"), lambda: chat.renamed(s, new, "bob")):
        with pytest.raises(PermissionError):
            call()


def test_single_page(spark, tmp_path):
    files = tables.documents_in(spark, folder(tmp_path))
    assert [(r.page_num, r.image) for r in pages.decode(files.where("path LIKE '%a.pdf'"), TextPages, page=2).collect()] == [(2, b"Mixed two")]


def test_chat_tables(spark):
    at = lambda n: F.timestamp_seconds(F.lit(n))
    raw = [(1, "s", "user", "first question of this session here", None, 5), (2, "s", "assistant", "answer", '[{"title":"t","file":"t.pdf"}]', 5), (3, "s", "user", "second", "not json", 6), (4, None, "user", "lost", None, 7), (5, "o", "user", "orphan", None, 8)]
    m = spark.createDataFrame(raw, "id bigint, session_id string, role string, content string, sources string, ts int").withColumn("timestamp", F.timestamp_seconds("ts")).drop("ts")
    s = spark.createDataFrame([("s", chat.OLD_TITLE, None, "ann"), ("e", "T", None, None)], SESSIONS)
    assert [(r.role, r.sources) for r in chat.transcript(m, "s").collect()][1][1][0].file == "t.pdf" and chat.transcript(m, "s").collect()[2].sources is None
    assert [r.session_id for r in chat.orphans(m, s).collect()] == ["o"]
    assert chat.orphans(m, s.unionByName(s.limit(1).withColumn("session_id", F.lit(None).cast("string")))).count() == 0
    assert {r.session_id: (r.title, r.username) for r in chat.migrated(m, s).collect()} == {"s": ("first question of this session...", "ann"), "e": ("T", "user"), "o": ("orphan", "user")}
    assert sorted(r.id for r in chat.history_window(m.where("session_id = 's'"), 1).collect()) == [2]
    assert chat.allowed(s, "s", "ann") and not chat.allowed(s, "s", "bob") and not chat.allowed(s, "e", "ann") and chat.allowed(s, "none", "x")
    left, rest = chat.deleted(m, s, "s")
    assert left.count() == 2 and rest.count() == 1
    r = chat.renamed(s, spark.createDataFrame([("s", "N", None, "bob"), ("x", "N", None, "bob")], SESSIONS).withColumn("updated_at", at(1)))
    assert {x.session_id: (x.title, x.username) for x in r.collect()} == {"s": ("N", "ann"), "e": ("T", None), "x": ("N", "bob")}
    assert chat.inserted(s.limit(0), s).count() == 2
    assert chat.list_sessions(m, s, "ann").first().title == chat.OLD_TITLE


def test_users(spark):
    u = spark.createDataFrame([], USERS)
    u = chat.seeded(u, [("admin", "secret1", "admin")])
    assert chat.seeded(u, [("x", "y", "z")]).count() == 1
    u = chat.registered(u, " ann ", "secret")
    assert chat.login(u, "ann", "secret").first().id == 2 and chat.login(u, "ann", "Secret").count() == 0
    for name, pw in (("ann", "secret"), ("an", "secret"), ("bob", "short"), ("", "secret")):
        with pytest.raises(ValueError):
            chat.registered(u, name, pw)


def test_ask(spark):
    e = providers.HashEmbedder(64)
    texts = ["the exam schedule begins in june", "library opening hours"]
    s = spark.createDataFrame([(f"c{i}", f"f{i}.pdf", "d", i, t, len(t), e.embed([t])[0]) for i, t in enumerate(texts)], VECTOR)
    m = spark.createDataFrame([], MESSAGES)
    answer, m = chat.ask(spark, s, m, "s1", "when does the exam schedule begin", e, providers.ExtractiveGenerator(), Settings(min_score=0.3))
    assert answer == texts[0] and m.count() == 2
    assert json.loads(m.where("role = 'assistant'").first().sources)[0] == {"title": "f0", "file": "f0.pdf"}

    class Broken:
        def generate(self, *a):
            raise RuntimeError("429 slow down")

    answer, m = chat.ask(spark, s, m, "s1", "exam schedule", e, Broken(), Settings(min_score=0.3))
    assert "rate limit" in answer and m.count() == 4
    assert chat.ask(spark, s, m, "s2", "zzz unknown words that nothing has", e, Broken(), Settings(min_score=0.9))[0] == prompt.NOT_FOUND


def test_catalog(spark):
    f = spark.createDataFrame([("a.pdf.pdf",), ("b.pdf",)], "file string").withColumn("modified", F.lit(None).cast("timestamp"))
    d = spark.createDataFrame([("1", "b.pdf"), ("2", "b.pdf"), ("3", "gone.pdf")], "document_id string, source_file string")
    got = {r.title: (r.date, r.status) for r in catalog.catalog(f, d).collect()}
    assert got == {"a": ("-", "Proses"), "b": ("-", "Ready")}
    assert catalog.search(catalog.catalog(f, d), "A.PDF").count() == 1


def test_evaluation(spark):
    c = spark.createDataFrame([(1, 10, 1, 0.9, False), (1, 11, 2, 0.95, True), (2, 12, 1, 0.2, True)], "query_id int, id int, rank int, score double, relevant boolean")
    cases = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {(r.top_k, r.min_score): (r.recall, r.mrr) for r in evaluate.grid(c, cases).collect()}
    assert got[5, 0.3] == (50.0, 0.5) and len(got) == 6
    assert evaluate.best(evaluate.grid(c, cases)).first().top_k == 5
    assert evaluate.grid(c.limit(0), cases).first().mrr == 0.0


def test_grid_without_python_rows(spark):
    c = spark.range(3).selectExpr("id AS query_id", "id", "1 AS rank", "0.4D AS score", "id = 1 AS relevant")
    cells = evaluate.grid(c, c.select("query_id"))
    assert "LogicalRDD" not in cells._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.top_k, r.min_score): r.recall for r in cells.collect()} == {(k, x): 33.333333 if x == 0.3 else 0.0 for k in (5, 10, 15) for x in (0.3, 0.5)}
    assert evaluate.grid(c, c.select("query_id"), top_k=()).count() == 0


def test_pages_fold_keeps_empty(spark):
    p = spark.createDataFrame([("d", 2, " b "), ("d", 1, "a"), ("d", 3, None)], "k string, page_num int, text string")
    assert pages.fold(p, "k").first().asDict() == {"k": "d", "text": "a\n\nb", "page_count": 3}
