"""Engine queries against their SQL on small tables of odd texts."""

import pandas as pd
import pytest

from sparrowdoc.operators import lexical
from sparrowdoc.plans import engine, registry
from tests.test_oracles import rows

duckdb = pytest.importorskip("duckdb")

#: Item 4 asks '"and en" AND scum', 9 '"rend, st" AND off', 14 '"is haed" AND reinon', 19 '"of the" AND scum'.
ITEMS = {4: "x y and en z u scum", 9: "x y rend, st z u off", 14: "x y is haed z u reinon", 19: "x y of the z u scum", 0: "x y scum reinon off tail"}
TEXTS = [
    "esstea and enndea scum", "hand en scum", "and en scum", "scum band enough of the", "en and scum", "ourend, stwh off", "rend, st off tail", "rend st off",
    "This haed reinon", "is haedble reinon", "is  haed reinon", None, "", "Thand entail", None, *[f"filler {i} words here" for i in range(30)],
]


@pytest.fixture
def small(tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 'src', ?)", [(i, t, len(t or "")) for i, t in enumerate(TEXTS)])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(ITEMS.items()))
    for t in ("documents", "benchmark"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    return con, str(tmp_path)


def same(spark, small, name):
    con, path = small
    ours, theirs = rows(registry.queries()[name](spark, path).toPandas()), rows(con.execute(registry.oracle_sql()[name]).df())
    assert ours == theirs
    return ours


def test_search_of_phrases_within_longer_words(spark, small):
    same(spark, small, "engine_search")
    found = {(r.query_id, r.doc_id) for r in registry.queries()["engine_search"](spark, small[1]).collect()}
    assert {(4, 0), (4, 1), (4, 2), (4, 3), (9, 5), (9, 6), (14, 8), (14, 9)} <= found
    assert not found & {(4, 4), (9, 7), (14, 10)} and 19 not in {q for q, _ in found}


def test_phrases_by_each_anchor(spark):
    chunks = spark.createDataFrame([(1, 0, "a hand engine ran"), (2, 0, "and, en"), (3, 0, "red hand engine x"), (4, 0, None)], "doc_id long, chunk_id int, content string")
    find = lambda *p: sorted((r.query_id, r.doc_id) for r in lexical.phrase_search(chunks, spark.createDataFrame(p, "query_id long, phrase string")).collect())
    # Without inner words, with one, with one that isn't whole where the phrase stands; of stop words only.
    assert find((1, "And en")) == [(1, 1), (1, 3)]
    assert find((1, "d hand en"), (2, "hand engine ra"), (3, "gin"), (4, "of the")) == [(1, 3), (2, 1), (3, 1), (3, 3)]
    # Two phrases of one question and no other term: every scored word is an anchor, a chunk counts once.
    q = spark.createDataFrame([(1, '"hand eng" AND "ran"'), (2, '"d eng" AND red')], "query_id long, question string")
    more = chunks.unionByName(spark.createDataFrame([(i, 0, "filler") for i in range(10, 20)], chunks.schema))
    assert sorted((r.query_id, r.doc_id) for r in lexical.boolean_search(more, q).collect()) == [(1, 1), (2, 3)]


def test_results_of_phrases_within_longer_words(spark, small):
    names, found = same(spark, small, "engine_results")
    assert {("4", "Document 1"), ("9", "Document 5"), ("14", "Document 9")} <= {(r[names.index("query_id")], r[names.index("title")]) for r in found}


def test_rerank_score_is_rounded_once(spark, small, monkeypatch):
    # Products that end in a five at the fifth place, or nearly so.
    scores = [i / 1e6 for i in range(1_000_003, 1_400_003, 97)] + [9.012125, 2.528375]
    made = spark.createDataFrame([(i, i, "aa bb cc dd ee", "aa bb cc dd ee"[: 2 + 3 * (i % 5)], s) for i, s in enumerate(scores)], "query_id long, doc_id long, question string, content string, score double")
    monkeypatch.setattr(engine, "found", lambda s, d: made)
    ours = registry.queries()["engine_post_process"](spark, small[1]).select("query_id", "rerank_score").toPandas().set_index("query_id")["rerank_score"]
    small[0].register("given", pd.DataFrame({"id": range(len(scores)), "score": scores}))
    theirs = small[0].execute("SELECT id, round(score * (1 + 0.2 * ((id % 5 + 1) / 5)), 4) AS r FROM given").df().set_index("id")["r"]
    assert [i for i in theirs.index if ours[i] != theirs[i]] == []


@pytest.mark.parametrize("name", ["engine_search", "engine_results"])
def test_odd_rows(spark, small, name):
    """Nulls in the metadata, documents and items without an id, ids below 0, letters that are lowered by what stands beside them."""
    con, path = small
    con.execute("UPDATE documents SET lang = CASE WHEN doc_id % 2 = 0 THEN lang END, source = CASE WHEN doc_id % 3 = 0 THEN source END")
    con.execute("INSERT INTO documents VALUES (NULL, 'and en scum', 'en', 's', 11), (NULL, 'en and scum', 'en', 's', 11), (-8, 'rend, st off', NULL, NULL, 12), (90, 'ΤΗΣ ΟΔΟΣΑ İLK', 'el', 's', 13), (91, 'οδος της', 'el', NULL, 8)")
    con.execute("INSERT INTO benchmark VALUES (-1, 'x y and en z u scum'), (-3, 'x y rend, st z u off'), (NULL, 'x y and en z u scum'), (24, 'x y ΤΗΣ ΟΔΟΣ z u İlk'), (25, 'x y ΤΗΣ ilk z u'), (30, NULL)")
    for t in ("documents", "benchmark"):
        con.execute(f"COPY {t} TO '{path}/{t}.parquet'")
    names, found = same(spark, small, name)
    ids = {(r[names.index("query_id")], r[names.index("doc_id")]) for r in found}
    assert {("-1", "2"), ("-3", "-8"), ("24", "90"), ("25", "90")} <= ids and not [d for _, d in ids if d == "null"]
    if name == "engine_results":
        kinds = {(r[names.index("doc_type")], r[names.index("source")], r[names.index("title")]) for r in found}
        assert ("null", "null", "Document -8") in kinds and ("en", "src", "Document 6") in kinds
