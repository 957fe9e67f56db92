"""Hand-computed cases and invariants of the operators."""

import math
from decimal import Decimal

from pyspark.sql import functions as F

from sparrowdoc.config import Config
from sparrowdoc.functions import fields, text
from sparrowdoc.operators import chunking, edges, evidence, extraction, fusion, lexical, reasoning, vector
from sparrowdoc.sources import office, tables
from sparrowdoc.sources.index import Index
from sparrowdoc.streaming import events


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("o")).first()["o"]


def test_tokens(spark):
    assert one(spark, "Well-known end. A 7 x--y", text.tokens) == ["well-known", "well", "known", "end.", "7", "x--y", "x", "", "y"]
    assert one(spark, None, text.tokens) is None


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta"), (2, 0, "alpha alpha gamma"), (3, 0, "delta")], "doc_id long, chunk_id int, content string")
    q = spark.createDataFrame([(1, "beta")], "query_id long, question string")
    got = lexical.search(chunks, q).collect()
    idf = math.log((3 - 1 + 0.5) / 1.5)
    want = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2))
    assert [(r.doc_id, r.rank) for r in got] == [(1, 1)]
    assert abs(got[0].score - want) < 1e-6
    # A term in two of three chunks has a negative weight: no hit.
    assert lexical.search(chunks, spark.createDataFrame([(1, "alpha")], "query_id long, question string")).count() == 0


def test_boolean_and_phrase(spark):
    chunks = spark.createDataFrame([(1, 0, "red green blue"), (2, 0, "green red")], "doc_id long, chunk_id int, content string")
    assert [r.doc_id for r in lexical.having_all(chunks, ["red", "blue"]).collect()] == [1]
    assert lexical.having_all(chunks, ["red", "missing"]).count() == 0
    assert [r.doc_id for r in lexical.having_none(chunks, ["blue"]).collect()] == [2]
    p = spark.createDataFrame([(1, "red green")], "query_id long, phrase string")
    assert [r.doc_id for r in lexical.phrase_search(chunks, p).collect()] == [1]


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id string, chunk_id int, score double")


def test_fusion(spark):
    s = lists(spark, [(1, "a", 0, 0.9), (1, "b", 0, 0.8), (1, "c", 0, 0.7)])
    k = lists(spark, [(1, "b", 0, 5.0), (1, "d", 0, 4.0)])
    got = {r.doc_id: r.score for r in fusion.fuse(s, k).collect()}
    assert abs(got["b"] - (0.6 / 62 + 0.4 / 61)) < 1e-6
    assert max(got.values()) <= 1 / 61
    borda = {r.doc_id: r.score for r in fusion.fuse(s, k, "borda").collect()}
    assert borda["b"] == round(2 * 0.6 + 2 * 0.4, 6) and borda["a"] == round(3 * 0.6, 6)
    empty = lists(spark, [])
    assert {r.doc_id: r.score for r in fusion.fuse(s, empty).collect()} == {"a": 0.9, "b": 0.8, "c": 0.7}
    same = lists(spark, [(1, "a", 0, 2.0), (1, "b", 0, 2.0)])
    assert {r.unit for r in fusion.minmax(same).collect()} == {1.0}


def test_chunkers(spark):
    a, b = "x" * 99, "y" * 100
    assert one(spark, f"{a}. {b}.", chunking.greedy) == [f"{a} {b}"]
    assert len(one(spark, f"{a}z. {b}z.", chunking.greedy)) == 2
    assert one(spark, "", chunking.greedy) == []
    words = " ".join(f"w{i:03d}" for i in range(400))
    windows = one(spark, words, chunking.sliding)
    assert windows[0].split()[0] == "w000" and set(" ".join(windows).split()) == set(words.split())
    assert one(spark, "one. two. three.", chunking.with_overlap) == ["one two three"]


def test_dates_and_masks(spark):
    got = [one(spark, d, fields.parse_date) for d in ("12/31/2024", "31/12/2024", "March 5, 2024", "05 Mar 2024", "13/40/2024")]
    assert [str(d) if d else None for d in got] == ["2024-12-31", "2024-12-31", "2024-03-05", "2024-03-05", None]
    assert one(spark, "mail a.b@c.de now", lambda c: fields.mask(c, "EMAIL")) == "mail [EMAIL] now"
    assert one(spark, "<b>a & b</b>", fields.escape_html) == "a &amp; b"


def test_consensus_and_conflicts(spark):
    docs = spark.createDataFrame([(1, 1, "paid 50 on 01/02/2024"), (1, 2, "paid 50"), (2, 1, "cost 10"), (2, 2, "cost 20")], "group_id long, doc_id long, content string")
    got = {r.group_id: r.mismatched_pairs for r in evidence.conflicts(docs).collect()}
    assert got == {1: 0, 2: 1}


def test_extraction_types(spark):
    df = spark.createDataFrame([(1, "Invoice #: A-1\nTotal: $1,234.50\nDue Date: 03/05/2024\nwrite Me@X.org")], "doc_id long, content string")
    got = {r.name: r for r in extraction.extract(df, "invoice").collect()}
    assert got["total_amount"].value_num == 1234.5 and str(got["due_date"].value_date) == "2024-03-05" and got["email"].value == "me@x.org"


def test_arithmetic():
    assert reasoning.arithmetic("$1,000 + 10%") == Decimal("1000.1")
    assert reasoning.arithmetic("2 times (3 minus 1)") == 4
    for bad in ("1/0", "__import__('os')", "9**9**9", "", None, "a + 1"):
        assert reasoning.arithmetic(bad) is None


def test_knn_finds_itself(spark, sf):
    v = tables.load(spark, sf, "embeddings")
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    top = vector.knn(v, q, 1).collect()
    assert all(r.score > 0.999999 for r in top)


def test_knn_is_dealt_alike(spark, sf):
    v = tables.load(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    assert sorted(vector.knn(v, q, 5).collect()) == sorted(vector.knn(v, q, 5, query_block=4).collect())


def test_knn_of_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), (None, [1.0, 0.0]), ("e", [1.0, 0.0, 0.0]), ("f", []), ("g", [float("nan"), 1.0]), ("h", [None, 1.0])]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    q = spark.createDataFrame([("x", [3.0, 0.0]), ("y", [0.0, 0.0]), ("z", [0.0, 0.0, 1.0])], "query_id string, embedding array<double>")
    want = [("x", "a", 1.0, 1), ("x", "b", 1.0, 2), ("z", "e", 0.0, 1)]
    assert sorted(map(tuple, vector.knn(v, q).collect())) == want
    assert sorted(map(tuple, vector.knn(v, q, query_block=1).collect())) == want
    assert vector.knn(v.limit(0), q).count() == 0 and vector.knn(v, q.limit(0)).count() == 0


def test_probing_recalls(spark):
    from sparrowdoc.plans import registry

    # Vectors without clusters to speak of, 13 of 64 cells.
    sf = "/root/testdata/sf0.1"
    exact = registry.queries()["knn_exact"](spark, sf).select("query_id", "vec_id")
    probed = registry.queries()["knn_ivf"](spark, sf).select("query_id", "vec_id")
    assert exact.intersect(probed).count() / exact.count() >= 0.9
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vector.in_cells(none, vector.train_cells(none), 3).count() == 0


def test_edges_and_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    docs = tables.read_text_files(spark, str(tmp_path))
    assert docs.first().doc_id == "doc_a"
    got = tables.read_binary(spark, str(tmp_path), lambda p, b: (b.decode(), 0.9)).first()
    assert got.content == "hello\nworld" and got.error is None
    bad = tables.read_binary(spark, str(tmp_path), lambda p, b: 1 / 0).first()
    assert bad.error.startswith("ZeroDivisionError")
    e = edges.embed(spark.createDataFrame([("x",), (None,)], "text string"), lambda ts: [[1.0] for _ in ts]).collect()
    assert [r.embedding for r in e] == [[1.0], None]


def test_config():
    assert Config().checked() == []
    assert Config().changed({"rrf_k": "0", "unknown": "1"}).checked() == ["rrf_k and embedding_dims are positive"]


def test_stream_equals_batch(spark, sf, tmp_path):
    q = events.run_to_table(events.windowed(events.read_events(spark, sf)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    streamed = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.start, r.event_type): r.n for r in events.windowed(tables.load(spark, sf, "events")).collect()}
    assert streamed and all(batch[k] == n for k, n in streamed.items())


def test_merge_boxes(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 5.0, 5.0, 15.0, 15.0), (1, 100.0, 100.0, 110.0, 110.0)], "page long, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.n for r in chunking.merge_boxes(b).collect()) == [1, 2]


def test_metadata_keys_that_become_equal(spark):
    row = spark.sql("SELECT map('k' || repeat('x', 120), 'a', 'k' || repeat('x', 130), '<b>b', 'n', NULL) AS m, map('l', transform(sequence(1, 12), x -> '<i>' || x)) AS l, CAST(NULL AS map<string, string>) AS z")
    got = row.select(tables.clean_metadata(F.col("m")).alias("m"), tables.clean_metadata(F.col("l"), lists=True).alias("l"), tables.clean_metadata(F.col("z")).alias("z")).first()
    assert got.m == {"k" + "x" * 99: "b", "n": None}
    assert got.l == {"l": [str(i) for i in range(1, 11)]} and got.z is None


def test_pairs_of_hot_and_cold_values(spark, monkeypatch):
    import itertools
    import random

    rng = random.Random(5)
    docs = [(g, i, {rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5))} | ({"hot"} if g and rng.random() < 0.6 else set())) for g in range(3) for i in range(25)]
    held = spark.createDataFrame([(g, i, v) for g, i, vs in docs for v in vs], "group_id int, doc_id int, value string")
    shared = {(g, a, b): len(x & y) for (g, a, x), (h, b, y) in itertools.combinations(docs, 2) if g == h and x & y}
    for hot, lane in ((0, 1024), (2, 3), (8, 1024), (20, 2)):
        monkeypatch.setattr(evidence, "HOT", hot)
        monkeypatch.setattr(evidence, "LANE", lane)
        assert {r.group_id: r.s for r in evidence._sharing(held).collect()} == {g: sum(k[0] == g for k in shared) for g in range(3)}
    met = evidence._met(held, "value").groupBy("group_id", "a", "b").count().collect()
    assert {(r.group_id, r.a, r.b): r["count"] for r in met} == shared


def test_index_by_batches(spark, tmp_path):
    schema = "doc_id string, chunk_id int, content string, extra string"
    chunks = lambda *rows: spark.createDataFrame([(d, c, t, "x") for d, c, t in rows], schema)
    vectors = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(1, "beta")], "query_id long, question string")
    at = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    hits = lambda i: [(r.doc_id, r.chunk_id) for r in i.search(q).orderBy("rank").collect()]
    path = str(tmp_path / "index")
    index = Index.create(spark, path, chunks(("a", 0, "alpha beta"), ("b", 0, "gamma"), ("c#1", 2, "delta"), (None, 0, "epsilon"), ("e", 0, None)), vectors(("a", 0, [1.0, 0.0]), ("c#1", 2, [1.0, 1.0])))
    assert hits(index) == [("a", 0)]
    assert [(r.doc_id, r.chunk_id) for r in index.nearest(at).orderBy("rank").collect()] == [("a", 0), ("c#1", 2)]
    assert [r.doc_id for r in index.nearest(at, only=spark.createDataFrame([("c#1",)], "doc_id string")).collect()] == ["c#1"]
    # A batch that failed before its log: not read, and written over by the next.
    spark.createDataFrame([("beta", "z", 0, 1, 1)], "term string, doc_id string, chunk_id int, dl long, tf long").write.parquet(f"{path}/postings/batch=1")
    assert hits(index) == [("a", 0)]
    index.add(chunks(("d", 0, "delta delta")))
    assert hits(index) == [("a", 0)]
    index.upsert(chunks(("a", 0, "zeta"), ("b", 1, "beta eta")), vectors(("b", 1, [0.0, 1.0])))
    assert hits(Index(spark, path)) == [("b", 1)]
    assert [(r.doc_id, r.score) for r in index.nearest(at).orderBy("rank").collect()] == [("c#1", 0.707107), ("b", 0.0)]
    index.delete(spark.createDataFrame([("b",), ("unknown",), (None,)], "doc_id string"))
    assert hits(index) == []
    index.add(chunks(("b", 0, "beta")))
    assert hits(index) == [("b", 0)]
    small = index.compact(str(tmp_path / "compact"))
    assert hits(small) == [("b", 0)] and small.history().count() == 1
    s = index.stats().first()
    assert (s.n_documents, s.n_chunks, s.n_vectors, s.n_batches) == (5, 6, 1, 5)
    try:
        Index.create(spark, path, chunks())
        raise AssertionError("an index was written over")
    except ValueError:
        pass
    none = Index.create(spark, str(tmp_path / "none"), chunks())
    assert none.search(q).count() == 0 and none.nearest(at).count() == 0


def word_file(body, styles=None):
    import io
    import zipfile

    out, ns = io.BytesIO(), 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>")
    return out.getvalue()


def test_word_files(spark, tmp_path):
    p = lambda t, style="": f"<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>"
    c = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{c('a', '<w:gridSpan w:val=\"2\"/>')}{c('b', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{c('1')}{c('2')}{c('', '<w:vMerge/>')}</w:tr></w:tbl>"
    body = table + p("Intro", '<w:pPr><w:pStyle w:val="H"/></w:pPr>') + p("TOTALS") + p("- item") + p("  ") + "<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p>"
    data = word_file(body, '<w:style w:styleId="H"><w:name w:val="heading 1"/></w:style>')
    files = spark.createDataFrame([("a", data), ("b", b"no zip"), ("c", word_file("")), ("d", word_file("").replace(b"w:body", b"w:bodx"))], "path string, content binary")
    got = [tuple(r) for r in office.word_layout(files).orderBy("path", "position").collect()]
    assert [r[1:4] for r in got if r[0] == "a"] == [(0, "header", "Intro"), (1, "header", "TOTALS"), (2, "list", "- item"), (3, "paragraph", "one\ttwo"), (4, "table", "a\ta\tb\n1\t2\tb")]
    assert got[4][6:8] == (2, 3) and got[0][5] == "heading 1"
    assert [r[0] for r in got[5:] if r[8]] == ["b", "d"] and not [r for r in got if r[0] == "c"]
    (tmp_path / "x.docx").write_bytes(data)
    assert tables.read_binary(spark, str(tmp_path), office.word_text).first().content.startswith("Intro\nTOTALS")


def test_engines_in_order():
    bad, poor, good = lambda p, b: 1 / 0, lambda p, b: ("?!" * 20, 0.9), lambda p, b: ("some readable text", 0.8)
    assert office.first_good(bad, poor, good)("x", b"") == ("some readable text", 0.8)
    for engines in ((bad, poor), ()):
        try:
            office.first_good(*engines)("x", b"")
            raise AssertionError("no engine was good enough")
        except ValueError as e:
            assert "quality too low" in str(e) or str(e) == "no engine"
