import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quern.functions import models
from quern.operators import catalog, chunking, intervals
from quern.sources import ingest, office, providers
from quern.streaming import jobs

DOCS = "doc_id bigint, text string, handler string, step string, body int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, h, "s", 1) for i, t, h in rows], DOCS)


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_steps_cover_every_unit_once(spark):
    rows = [(1, "a" * 4100, "txt"), (2, "r\n\n" * 1200, "csv"), (3, None, "txt"), (4, "", "csv"), (5, "x", None), (6, "one\n\ntwo\n \nthree", "markdown"), (7, "-", "nothing"), (8, "  ", "csv")]
    got = ingest.steps(docs(spark, rows)).orderBy("key", "step").collect()
    assert [(r.key, r.step, r.cursor, r.next_cursor, r.is_last, r.publishes, r.n_units) for r in got] == [
        (1, 0, 0, 1, False, "txt", 2000), (1, 1, 1, 2, False, "txt", 2000), (1, 2, 2, 3, True, "completed", 100),
        (2, 0, 0, 500, False, "csv", 500), (2, 1, 500, 1000, False, "csv", 500), (2, 2, 1000, 1200, True, "completed", 200), (6, 0, 0, 1, True, "completed", 3)]
    assert "".join(r.body for r in got if r.key == 1) == "a" * 4100
    assert ingest.steps(docs(spark, [])).count() == 0
    chunks = ingest.chunks_of_steps(ingest.steps(docs(spark, [(1, "Word number. " * 300, "txt")])))
    assert chunks.agg(F.max(F.length("text"))).collect()[0][0] <= ingest.CHUNK_SIZE and chunks.where("size(terms) = 0").count() == 0


def test_ingestion_goes_on_after_a_restart(spark, tmp_path):
    """What a stopped job has written stays; a second run with its folder reads only what is new."""
    source, folder = tmp_path / "in", str(tmp_path / "job")
    docs(spark, [(i, f"text {i} " * 400, "txt") for i in range(5)]).coalesce(1).write.parquet(str(source / "a.parquet"))
    stream = lambda: spark.readStream.schema(DOCS).option("recursiveFileLookup", "true").parquet(str(source))
    states, points = jobs.ingest(stream(), spark, folder)
    first = {tuple(r) for r in states.collect()}
    assert {r[0] for r in first} == set(range(5))
    docs(spark, [(9, "new " * 10, "txt")]).coalesce(1).write.parquet(str(source / "b.parquet"))
    states, points = jobs.ingest(stream(), spark, folder)
    assert first < {tuple(r) for r in states.collect()} and states.count() == len(first) + 1
    assert points.groupBy("key", "step", "chunk").count().where("count > 1").count() == 0 and points.where("key = 9").count() == 1


def test_buffers_of_one_batch_follow_the_order_column(spark, tmp_path):
    spark.range(30_000).select(F.lit(1).alias("k"), (30_000 - F.col("id")).alias("o")).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    out = jobs.drain(jobs.advance_buffers(spark.readStream.schema("k int, o bigint").parquet(str(tmp_path / "t.parquet")), "k", "o"), spark)
    assert [(r.first, r.last) for r in out.orderBy("buffer").collect()] == [(50 * i + 1, 50 * i + 50) for i in range(600)]


def test_dispatch(spark):
    df = spark.createDataFrame([(" PDF", None, None), ("text", None, None), ("text", "m", 1), ("pdf", None, 3), ("odd", None, None), (None, None, None), ("Doc", None, None)], "t string, m string, p int")
    assert [r[0] for r in df.select(ingest.dispatch(F.col("t"), F.col("m"), F.col("p"))).collect()] == ["pdf", "txt", "markdown", "ocr", None, None, "docx"]
    turns = ingest.page_turns(spark.createDataFrame([("a", 5), ("b", 0), ("c", None)], "id string, pages int"), "id", "pages", F.lit(2)).orderBy("turn").collect()
    assert [(r.stage, r.page_start, r.page_end) for r in turns] == [("ocr", 0, 2), ("markdown", 0, 2), ("ocr", 2, 4), ("markdown", 2, 4), ("ocr", 4, 5), ("markdown", 4, 5)]


def test_parts(spark):
    parts = [("a", 1, 10, "x"), ("a", 2, 3, "y"), ("b", 1, 10, "x"), ("b", 3, 10, "z"), ("c", 1, 2, "x"), ("c", 2, 10, "y"), ("d", 1, 1, "w"), ("a", 1, 10, "x"), (None, 1, 1, "q"), ("e", None, 1, "q")]
    got = {r.object_id: (r.parts, r.complete) for r in ingest.multipart_objects(spark.createDataFrame(parts, "o string, n int, s bigint, d string"), "o", "n", "s", "d", 5).collect()}
    assert got == {"a": (2, True), "b": (2, False), "c": (2, False), "d": (1, True)}


def test_office_files(spark):
    w, a, p = office.WORDS[1:-1], office.DRAWING[1:-1], office.SLIDES[1:-1]
    docx = zipped(word__document_xml=f'<w:document xmlns:w="{w}"><w:p><w:t>One</w:t><w:tab/><w:t>two</w:t></w:p><w:p/><w:p><w:t>Three</w:t></w:p></w:document>')
    shape = lambda kind, t: f'<p:sp><p:nvPr>{kind}</p:nvPr><a:p><a:t>{t}</a:t></a:p></p:sp>'
    slide = lambda *s: f'<p:sld xmlns:p="{p}" xmlns:a="{a}">{"".join(s)}</p:sld>'
    pptx = zipped(**{"ppt__slides__slide2_xml": slide(shape("", "later")), "ppt__slides__slide1_xml": slide(shape("", "body"), shape('<p:ph type="title"/>', "Head"))})
    book = office.write_workbook([["h", "k"], ["", " "], ["a&b", "2"]])
    flat = zlib.compress(b"BT (Hello \\(you\\)) Tj T* [(wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 3 0 R>> endobj\n2 0 obj <</Type /Pages>> endobj\n3 0 obj <</Filter /FlateDecode>> stream\n" + flat + b"\nendstream endobj\n"
    frame = lambda content: spark.createDataFrame([("f", bytearray(content), 1), ("null", None, 1), ("bad", bytearray(b"no such thing"), 1)], "path string, content binary, row int")
    assert [(r.number, r.text) for r in office.read_documents(frame(docx)).collect()] == [(0, "One\ttwo"), (1, "Three")]
    assert [(r.slide, r.title, r.shapes) for r in office.read_slides(frame(pptx)).collect()] == [(1, "Head", ["body"]), (2, None, ["later"])]
    assert [(r.row, r.cells) for r in office.read_workbooks(frame(book)).collect()] == [(0, ["h", "k"]), (2, ["a&b", "2"])]
    assert [(r.page, r.text) for r in office.read_pdf_pages(frame(pdf)).collect()] == [(0, "Hello (you)\nworld")]
    assert office.read_pdf_pages(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_responses(spark):
    said = [
        ("a", "assemblyai", 10.0, json.dumps({"utterances": [{"speaker": "A", "text": "hi", "start": 1500, "end": 2500, "confidence": 0.9, "words": []}]})),
        ("g", "groq", None, json.dumps({"segments": [{"text": "x", "start": 0.5, "end": 1, "no_speech_prob": 0.25}]})),
        ("e", "elevenlabs", 0.0, json.dumps({"words": [{"text": "w", "start": 0, "end": 1, "type": "word", "speaker_id": "speaker_1", "logprob": 0.0}, {"text": " ", "type": "spacing"}]})),
        ("bad", "gladia", 0.0, "no json"), ("null", "deepgram", 0.0, None), ("odd", "other", 0.0, "{}"),
    ]
    got = {r.key: (r.speaker, r.start_sec, r.end_sec, r.text, r.confidence) for r in providers.parse_transcripts(spark.createDataFrame(said, "key string, provider string, offset_s double, r string"), "key", "r").collect()}
    assert got == {"a": ("A", 11.5, 12.5, "hi", 0.9), "g": (None, 0.5, 1.0, "x", 0.75), "e": ("1", 0.0, 1.0, "w", 1.0)}
    pages = [("m", "mistral", 4, json.dumps({"pages": [{"index": 0, "markdown": " a "}]})), ("d", "datalab", 0, json.dumps({"markdown": "x\n\n{1}" + "-" * 48 + "\n\ny"})), ("n", "mistral", 0, None)]
    got = {(r.key, r.page, r.markdown) for r in providers.parse_pages(spark.createDataFrame(pages, "key string, provider string, first_page int, r string"), "key", "r").collect()}
    assert got == {("m", 4, "a"), ("d", 0, "x"), ("d", 1, "y")}


def test_sentence_pieces(spark):
    text = " ".join(f"Sentence number {i} says something." for i in range(100))
    pieces = chunking.sentence_pieces(text)
    assert max(map(len, pieces)) <= 1000 and all(p.endswith(".") and p.startswith("Sentence") for p in pieces)
    assert all(a.rsplit("Sentence", 1)[1].strip() in b for a, b in zip(pieces, pieces[1:], strict=False))
    assert chunking.sentence_pieces("x" * 2500) == ["x" * 1000, "x" * 1000, "x" * 500] and chunking.sentence_pieces("") == []
    df = spark.createDataFrame([(1, "One. Two.", "Head"), (2, "Head is here.", "Head"), (3, None, "h"), (4, "text", None)], "k int, t string, h string")
    assert {r.key: r.text for r in chunking.sentence_chunks(df, "k", "t", "h").collect()} == {1: "Head\nOne. Two.", 2: "Head is here.", 4: "text"}


def test_model_catalog(spark):
    every = spark.createDataFrame([("llm", 1, "a", "p"), ("llm", 2, "b", "q"), ("ocr", 1, "o", "p")], "kind string, id bigint, name string, provider string")
    change = spark.createDataFrame([("llm", 2, None, "r"), ("llm", 9, "no", "r"), ("ocr", 1, "z", "z")], every.schema)
    new = spark.createDataFrame([("llm", 1, "taken", "x"), ("llm", 3, "c", "p")], every.schema)
    c = catalog.ModelCatalog("llm", every).create(new).update(change).delete(every.where("id = 1"))
    assert {tuple(r) for r in c.rows.collect()} == {("llm", 2, "b", "r"), ("llm", 3, "c", "p")}
    assert c.get(3).count() == 1 and [r.name for r in c.by_provider("r").collect()] == ["b"] and {(r.provider, r.models) for r in c.providers().collect()} == {("r", 1), ("p", 1)}


def test_expansion_falls_back(spark):
    df = spark.createDataFrame([(" q ",)], "q string")
    assert [tuple(r) for r in df.select(models.expanded(F.col("q")), models.expanded(F.col("q"), lambda q: F.lit(None).cast("string")), models.expanded(F.col("q"), lambda q: F.concat(q, F.lit("more")))).collect()] == [("q", "q", "q more")]


def test_times_beyond_the_bound_are_counted(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 1e12), ("a", 5.0, 4.0), ("a", None, 1.0)], "e string, s double, t double")
    assert intervals.beyond_bounds(df, "s", "t").collect()[0].rows == 1
    assert intervals.continuous_periods(df, "e", "s", "t").count() == 1


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from quern import runtime

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        runtime.checkpoint_folder(Cluster)
