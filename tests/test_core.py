import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quern import runtime
from quern.functions import lexicon, models, names
from quern.operators import catalog, chunking, graph, lexical
from quern.operators import vector_search as vs
from quern.plans import registry, retrieval
from quern.sources import structured, tabular


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).collect()[0][0]


def test_registry_names_match():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.queries().values()


def test_file_types(spark):
    df = spark.createDataFrame([(n,) for n in ("report.docx", "a.tsv", "b.PHP", "c.ndjson", "noext", "x.JPeG", " y.Pdf ", ".bashrc", None)], "n string")
    assert [r[0] for r in df.select(names.file_type(F.col("n"))).collect()] == ["doc", "csv", "code", None, None, "image", "pdf", None, None]
    assert [r[0] for r in df.select(names.code_language(F.col("n"))).collect()][2] is None
    assert one(spark, names.processor_route(F.lit("p"), F.lit("x.bin"))) is None
    assert one(spark, names.processor_route(F.lit(None).cast("string"), F.lit("d/x.py"))) == "code"


def test_point_ids_are_uuid5(spark):
    for text in ("a", "doc_chunk_1", "ü"):
        assert one(spark, names.point_id(F.lit(text))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, text))


def test_scans_in_two_levels(spark):
    df = spark.createDataFrame([(i % 3, i, i // 7, (i * 37) % 11) for i in range(200)], "k int, o int, s int, v int")
    got = {(r.k, r.o): r.before for r in runtime.exclusive_scan(df, ["k"], ["o"], "s", F.col("v"), "before").collect()}
    assert all(got[(i % 3, i)] == sum((j * 37) % 11 for j in range(i) if j % 3 == i % 3) for i in range(200))
    labelled = df.withColumn("x", F.when(F.col("v") > 6, F.col("o").cast("string")))
    for inclusive in (True, False):
        got = {(r.k, r.o): r.last for r in runtime.carry(labelled, ["k"], "s", ["o"], "x", "last", inclusive).collect()}
        for i in range(200):
            seen = [j for j in range(i + inclusive) if j % 3 == i % 3 and (j * 37) % 11 > 6]
            assert got[(i % 3, i)] == (str(seen[-1]) if seen else None)


def test_flatten_and_shapes():
    assert structured.flatten(json.loads('{"user":{"name":"Alice","city":"Mumbai"},"tags":["python","ml"],"a":null,"l":[{"x":1}],"e":[],"t":true}')) == [("user.name", "Alice"), ("user.city", "Mumbai"), ("tags_count", "2"), ("tags_sample", "python"), ("a", ""), ("l_count", "1"), ("e_count", "0"), ("t", "True")]
    assert structured.sniff_json("[1]")[0] == "root_array"
    assert structured.sniff_json('{"data":\n [{},{}]}') == ("root_object", "data.item")
    assert structured.sniff_json('{"a":1}\n{"a":2}')[0] == "ndjson"
    assert structured.sniff_json("nonsense")[0] == "error"


def test_ndjson_keeps_line_numbers(spark, rows):
    df = spark.createDataFrame([(0, '{"a":1}'), (1, " "), (2, '{"a":'), (3, '{"b":null}'), (4, None)], "n int, t string")
    assert [r[0] for r in rows(structured.valid_ndjson(df, "t").select("n"))] == [0, 3]


def test_xml(spark, rows):
    xml = "<catalog><product id='1'><name>A</name><details><category>c</category><stock>5</stock></details></product><product><name>B</name><name>C</name></product></catalog>"
    df = spark.createDataFrame([("x", xml), ("n", None), ("e", "")], "k string, t string")
    assert rows(structured.record_tag(structured.xml_edges(df, "k", "t"), ["key"])) == [("x", "product", 4)]
    assert rows(structured.xml_records(df, "k", "t", "product")) == [("x", 0, "details.category", "c"), ("x", 0, "details.stock", "5"), ("x", 0, "name", "A"), ("x", 1, "name", "C")]


@pytest.mark.parametrize(
    ("text", "n"),
    [("---\na: 1\n---\nb: 2\n", 2), ("- name: x\n- name: y\n", 2), ("database:\n  host: h\napp:\n  p: 1\n", 2), ("services:\n  - a: 1\n  - a: 2\n", 2), ("a: [\n", 0), ("", 0), (None, 0)],
)
def test_yaml(text, n):
    assert len(structured.yaml_objects(text)) == n


def test_html_units():
    html = "<nav><ul><li>short</li></ul></nav><p>A paragraph with <b>bold</b> words that is long enough</p><table><tr><th>Name</th><th>Brand</th></tr><tr><td>n</td><td>b</td><td>x</td></tr></table>"
    units = structured.html_unit_list(html)
    assert [u["kind"] for u in units] == ["content", "row"]
    assert "bold words" in units[0]["text"]
    assert [(c["k"], c["v"]) for c in units[1]["cells"]] == [("Name", "n"), ("Brand", "b"), ("col_2", "x")]
    assert structured.html_unit_list(None) == []


def test_markdown():
    md = "# Head\n\nIntro text.\n\n| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |\n\n## Next\n\n| k | v |\n|---|---|\n" + "".join(f"| r{i} | {i or ''} |\n" for i in range(6))
    chunks = structured.markdown_chunks(md)
    assert [c["kind"] for c in chunks] == ["text", "fragment_table", "text", *["table_row"] * 5]
    assert chunks[-1]["text"] == "Next — r5: v: 5"
    assert structured.parse_table("| x | 12 |\n|---|---|\n| y | 3 |") == ([], [["x", "12"], ["y", "3"]])
    assert structured.table_to_markdown([["a", None], [None, " "], ["b|c", "d  e", "f"]]) == "| a |  |\n| --- | --- |\n| b\\|c | d e |".replace("|  |", "|  |")


def test_recursive_split_invariants():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "x", ". ", "\n", "\n\n", "longerword", "é"]) for _ in range(rng.randint(0, 400)))
        size, overlap = rng.randint(20, 200), rng.randint(0, 15)
        pieces = chunking.recursive_split(text, size, overlap)
        assert all(0 < len(p) <= size for p in pieces)
        at = 0
        for p in pieces:  # every piece occurs, in order
            found = text.find(p, max(0, at - overlap - size))
            assert found >= 0
            at = found
        assert set("".join(text.split())) == set("".join("".join(pieces).split()))
    assert chunking.recursive_split("") == []
    assert chunking.recursive_split("x" * 10_000, 1500, 200)[0] == "x" * 1500


def test_greedy_packs(spark):
    df = spark.createDataFrame([("d", i, w, None) for i, w in enumerate([5.0, 5.0, 1.0, 20.0, 1.0, None, 9.0])] + [("e", 0, 3.0, "t"), ("e", 1, 9.0, "t"), ("e", 2, 9.0, "u")], "k string, i int, w double, g string")
    packed = {(r.k, r.i): r.pack for r in chunking.greedy_packs(df, ["k"], ["i"], {"w": 10}, "g").collect()}
    assert [packed[("d", i)] for i in range(7)] == [0, 0, 1, 2, 3, 3, 3]
    assert [packed[("e", i)] for i in range(3)] == [0, 0, 1]


def test_clusters_are_stable_and_cover():
    texts = [f"red apple fruit {i}" for i in range(10)] + [f"steel bolt metal {i}" for i in range(10)]
    a, b = chunking.row_clusters(texts, 10), chunking.row_clusters(texts, 10)
    assert (a == b).all() and len(set(a)) == 2 and len(set(a[:10])) == 1


def test_clock(spark):
    df = spark.createDataFrame([(None,), (0.0,), (59.9,), (3599.0,), (3600.0,), (86399.0,)], "s double")
    assert [r[0] for r in df.select(chunking.clock(F.col("s"))).collect()] == ["--:--", "00:00", "00:59", "59:59", "01:00:00", "23:59:59"]


def test_repeated_speech(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a b c", "a b c", "b c", None, "a b c d", "new"])], "k string, i int, t string")
    got = [r.fresh for r in chunking.drop_repeated_speech(df, ["k"], ["i"], "t").orderBy("i").collect()]
    assert got == ["a b c", "", "", "", "a b c d", "new"]


def test_lanes(spark):
    q = lambda text: [(x["lane"], round(x["score"], 2)) for x in one(spark, lexicon.lane_scores(F.lit(text)))]
    assert q("RAG")[0] == ("acronym", 3.1)
    assert q("how is quantization measured today")[:2] == [("concept", 1.6), ("keyword", 1.4)]
    assert [x[0] for x in q("")] == list(lexicon.LANES)
    assert one(spark, lexicon.lane_query(F.lit("R.A.G."), "acronym")) == "RAG"
    assert one(spark, lexicon.lane_value(F.lit("neuralNetwork_tuning"), "phrase")) == "neural network tuning"


def test_lexical_ties_keep_one_edge(spark, rows):
    text = "Alpha Beta near Gamma Delta measurement placement"
    df = spark.createDataFrame([("d", 0, "c1", 0, text), ("d", 0, "c2", 1, text), ("e", 0, "c3", 0, text)], "doc string, buf bigint, chunk string, number int, text string")
    best = lexical.strongest_edges(lexical.bridge_edges(df)).collect()
    assert len(best) == 1 and best[0].weight == 1.0 and best[0].type == "entity" and best[0].label == "alpha beta"
    assert rows(lexical.keywords(df)) == []


def test_references(spark, rows):
    chunks = spark.createDataFrame([("d", 0, "c0", 0, "See Table 1 here"), ("d", 0, "c1", 1, "table 1 and more"), ("d", 0, "c2", 2, "x")], "doc string, buf bigint, chunk string, number int, text string")
    hints = spark.createDataFrame([("c1", "Table 1"), ("c0", "previous"), ("c2", "previous")], "chunk string, hint string")
    assert rows(graph.reference_edges(chunks, hints)) == [("c1", "c0", "table 1", 1.0), ("c2", "c1", "previous", 0.6)]


def test_upsert_and_remove(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), (None, 3, "n")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 5, None), ("c", 6, "z")], "k string, v int, w string")
    assert rows(catalog.upsert(old, new, ["k"])) == sorted([("a", 1, "x"), ("b", 5, None), (None, 3, "n"), ("c", 6, "z")], key=repr)
    assert rows(catalog.remove(old, new, ["k"])) == sorted([("a", 1, "x"), (None, 3, "n")], key=repr)


def test_similarity_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vs, "POOL_BLOCK", 7)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((40, 5))
    v[1] = v[0]
    df = spark.createDataFrame([("d" if i < 30 else "e", f"k{i:02d}", v[i].tolist()) for i in range(40)], "doc string, key string, v array<double>")
    got = {(r.src, r.dst) for r in vs.similar_in_document(df, 3, 0.2).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for i in range(40):
        same = [j for j in range(40) if j != i and (i < 30) == (j < 30)]
        for j in sorted(same, key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:3]:
            if u[i] @ u[j] >= 0.2:
                want.add((f"k{i:02d}", f"k{j:02d}"))
    assert got == want


def test_fusion_and_zero_vectors(spark, rows):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.8)], "key string, score double")
    b = spark.createDataFrame([("y", 7.0), ("z", 3.0)], "key string, score double")
    assert rows(vs.fuse([a, b], 3)) == [("x", 0.5), ("y", round(1 / 3 + 1 / 2, 9)), ("z", round(1 / 3, 9))]
    assert one(spark, vs.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_every_query_row_is_asked(spark, rows, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vs, "POOL_BLOCK", 7)
    v = np.random.default_rng(2).standard_normal((40, 5))
    v[1], v[39] = v[0], 0
    points = spark.createDataFrame([(f"k{i:02d}", v[i].tolist()) for i in range(40)], "key string, v array<double>")
    asks = points.where("key < 'k20'").select(F.substring("key", 2, 2).cast("int").alias("query"), "v")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    want = {(q, f"k{i:02d}") for q in range(20) for i in sorted(range(40), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:3]}
    dense = vs.dense_top(points, asks, 3)
    assert {(r.query, r.key) for r in dense.collect()} == want
    assert rows(vs.dense_top(points, asks.where("query = 4"), 3).drop("query")) == rows(vs.dense_top(points, asks.where("query = 4").drop("query"), 3))
    assert vs.dense_top(points.limit(0), asks, 3).count() == vs.dense_top(points, asks.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="need a query id"):
        vs.dense_top(points, asks.drop("query"), 3).collect()
    words = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 3.0), ("c", "z", 1.0)], "key string, term string, weight double")
    terms = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0), (2, "z", 2.0), (3, "none", 1.0)], "query int, term string, weight double")
    assert rows(vs.sparse_top(words, terms, 1)) == [(1, "a", 3.0), (2, "c", 2.0)]
    rng = random.Random(5)
    words = spark.createDataFrame([(f"k{i:02d}", f"t{rng.randrange(9)}", float(rng.randrange(1, 4))) for i in range(40) for _ in range(4)], "key string, term string, weight double")
    terms = words.where("key < 'k20'").select(F.substring("key", 2, 2).cast("int").alias("query"), "term", "weight")
    each = {q: [(r.key, r.score) for r in vs.sparse_dot(words, terms.where(F.col("query") == q).drop("query")).orderBy(F.desc("score"), "key").limit(3).collect()] for q in (0, 7, 19)}
    got = vs.sparse_top(words, terms, 3).orderBy("query", F.desc("score"), "key").collect()
    assert len(got) == 60 and all([(r.key, r.score) for r in got if r.query == q] == x for q, x in each.items())
    legs = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.8), (2, "z", 0.1)], "query int, key string, score double"), spark.createDataFrame([(1, "y", 7.0), (2, "w", 3.0)], "query int, key string, score double")
    assert rows(vs.fuse(list(legs), 2)) == [(1, "x", 0.5), (1, "y", round(1 / 3 + 1 / 2, 9)), (2, "w", 0.5), (2, "z", 0.5)]


def test_neighbours_are_dropped_once(spark):
    df = spark.createDataFrame([("a", 0.9, None, "b"), ("b", 0.8, "a", "c"), ("c", 0.7, "b", None), ("d", 0.6, None, None)], "key string, score double, prev_chunk string, next_chunk string")
    assert [r.key for r in retrieval.drop_neighbours(df, [F.desc("score")]).collect()] == ["a", "c", "d"]


def test_context_islands(spark, rows):
    parts = spark.createDataFrame([("d", n, f"t{n}", p) for n, p in [(3, 0), (9, 0), (2, 1), (4, 1), (8, 1), (10, 1), (5, 2), (20, 2), (3, 2)]], "doc string, number int, text string, priority int")
    assert {(a, b, n) for _, a, b, n, _ in rows(retrieval.context_islands(parts))} == {(2, 5, 4), (8, 10, 3), (20, 20, 1)}


def test_models():
    with pytest.raises(LookupError):
        models.model("dense", "absent")


def test_text_windows_carry(spark):
    text = "".join(chr(97 + i % 26) for i in range(4500))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string")
    got = tabular.text_windows(df, "k", "t", 2000).orderBy("window").collect()
    assert "".join(r.body for r in got) == text and got[1].carry == text[1500:2000] and got[0].carry == ""


def test_empty_tables(spark):
    chunks = spark.createDataFrame([], "doc string, buf bigint, chunk string, number int, text string")
    assert lexical.bridge_edges(chunks).count() == 0
    assert graph.sequential_edges(chunks).count() == 0
    assert chunking.split_texts(chunks, "chunk", "text").count() == 0


def test_engine(spark, tmp_path):
    from datetime import datetime

    from quern.api import Engine

    day = datetime(2025, 1, 1)
    texts = ["Alpha Beta pump gasket measurement", "Alpha Beta pump gasket placement", "nothing of note here", "pump gasket again"]
    chunks = [("o", "p", "d", f"d_chunk_{i}", i, t, 0, day) for i, t in enumerate(texts)] + [("x", "q", "e", "e_chunk_0", 0, "pump gasket elsewhere", 0, day)]
    spark.createDataFrame(chunks, "org_id string, project_id string, document_id string, chunk_id string, chunk_number int, text string, file_chunk_number int, updated_at timestamp").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(c[3], [float(i == j) + 0.1 for j in range(4)]) for i, c in enumerate(chunks[:4])], "chunk_id string, embedding array<float>").write.parquet(f"{tmp_path}/chunk_embeddings.parquet")
    engine = Engine(spark, str(tmp_path), 4)
    assert [r.key for r in engine.search("pump gasket", k=5, org="x").collect()] == ["e_chunk_0"]
    for kind in ("quick", "smart", "expert"):
        rows = engine.query("pump gasket measurement", [1.1, 0.1, 0.1, 0.1], kind, 3, org="o").collect()
        assert rows and all(r.key.startswith("d_") for r in rows)
    assert {r.chunk for r in engine.chunk_ids("entity", "Alpha Beta").collect()} == {"d_chunk_0", "d_chunk_1"}
    with pytest.raises(ValueError):
        engine.query("  ")
