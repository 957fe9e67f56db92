"""Toxicity by held-out accuracy, chat formatting by hand, the pipeline by its stages."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrowdoc.llm import tool_calls, toxicity
from sparrowdoc.llm.queries import op9_toxicity, op10_tool_calls

from .test_lines_and_licenses import deduped
from .test_similarity import joined


@pytest.fixture(scope="module")
def scored(spark):
    return op9_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id", "left").toPandas()


def area(y, score):
    from pandas import Series

    rank = Series(score).rank().to_numpy()
    ones = y == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_rows_are_told_apart(scored):
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(scored.doc_id, scored.held_out, strict=True))
    held = scored[scored.held_out & scored.toxic.notna()]
    assert area(held.toxic.to_numpy(), held.score.to_numpy()) > 0.95
    assert (held.predicted == held.toxic).mean() > 0.97
    clean = held[held.toxic == 0]
    assert clean.predicted.mean() < 0.01
    # Calibrated: the mean score is about the share of toxic rows.
    assert abs(held.score.mean() - held.toxic.mean()) < 0.03
    assert scored.score.between(0, 1).all()


def test_held_out_labels_change_nothing(spark, docs):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score(docs, toxicity.fit(rows, x)).collect())) for x in (labels, turned))
    assert a == b


def test_no_labels_and_edge_cases(spark, docs, nothing, nulls):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(nothing, model).count() == 0 and toxicity.score(nulls, model).count() == 3
    odd = spark.createDataFrame([(None, 1), (9, None), (9, 1), (9, 0), (999, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, odd)).count() == docs.count()


def test_features():
    traits = toxicity.WordTraits({b"zork": 2.0, b"flim*": 1.0})
    x = dict(zip(toxicity.FEATURES, toxicity.features_of("You are an IDIOT, zork! flimsy 1d10t", traits), strict=True))
    assert x["seed_rate"] == pytest.approx(100 * 2 / 7) and x["hidden_rate"] == pytest.approx(100 / 7)
    assert x["lexicon_rate"] == pytest.approx(100 / 7) and x["beginning_rate"] == pytest.approx(100 / 7)
    assert x["near_second"] > 0 and x["capitals"] > 0 and x["marks"] > 0
    assert toxicity.features_of("", traits) == [0.0] * len(toxicity.FEATURES)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    m = rng.normal(size=500)
    knots, values = toxicity.isotonic(m, (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all() and 0 <= values.min() and values.max() <= 1


def test_isotonic_by_definition():
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 50):
        m = rng.integers(0, max(2, size // 2), size).astype(float)  # with ties
        y = (rng.random(size) < (m + 1) / (m.max() + 2)).astype(float)
        knots, values = toxicity.isotonic(m, y)
        at = np.unique(m)
        sums, counts = np.array([y[m == v].sum() for v in at]), np.array([(m == v).sum() for v in at])
        # The fit: the largest, over starts before, of the smallest mean of a run to an end behind.
        fit = [max(min(sums[a : b + 1].sum() / counts[a : b + 1].sum() for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
        # Points of equal fit are one block; half a row of each label is added to it.
        blocks = {f: counts[np.isclose(fit, f)].sum() for f in fit}
        want = np.maximum.accumulate([(f * blocks[f] + 0.5) / (blocks[f] + 1) for f in fit])
        assert np.allclose(np.interp(at, knots, values), want)


def test_trees_against_exhaustive_search():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, (50, 3)).astype(float), (rng.random(50) < 0.4).astype(float)
    y[x[:, 1] > 6] = 1
    base, trees = toxicity.fit_trees(x, y)
    margin = np.full(50, base)
    assert np.isclose(base, np.log(y.mean() / (1 - y.mean()))) and len(trees) == toxicity.TREES
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, toxicity.BINS + 1)[1:-1])) for f in range(3)]
    for feature, edge, leaf in trees[:12]:
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        value = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
        reach = {0: np.arange(50)}
        for node in range(2**toxicity.DEPTH - 1):
            rows = reach[node]
            gains = [value(rows[x[rows, f] <= e]) + value(rows[x[rows, f] > e]) - value(rows) for f in range(3) for e in edges[f] if 4 <= (x[rows, f] <= e).sum() <= len(rows) - 4]
            best = max(gains, default=0.0)
            left, right = rows[x[rows, feature[node]] <= edge[node]], rows[x[rows, feature[node]] > edge[node]]
            if np.isfinite(edge[node]):
                assert np.isclose(value(left) + value(right) - value(rows), best) and min(len(left), len(right)) >= 4
            else:
                assert best <= 1e-6 + 1e-9
            reach[2 * node + 1], reach[2 * node + 2] = left, right
        for i in range(2**toxicity.DEPTH):
            rows = reach[2**toxicity.DEPTH - 1 + i]
            assert np.isclose(leaf[i], -toxicity.RATE * g[rows].sum() / (h[rows].sum() + 1))
            margin[rows] += leaf[i]


def test_sample_holds_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", -1.0) for i in range(40)] + [(7, "again", -1.0)] * 30, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(-500, 40)], "doc_id long, toxic int")
    held = []
    was = toxicity.materialise
    monkeypatch.setattr(toxicity, "materialise", lambda df, name: held.append(was(df, name)) or held[-1])
    model = toxicity.fit(docs, labels, sample_rows=20)
    ids = [r.doc_id for r in held[0].collect()]
    assert len(ids) == len(set(ids)) == 20 and all(0 <= i < 40 and zlib.crc32(str(i).encode()) % 5 for i in ids)
    got = toxicity.score(docs, model, "doc_id score")
    assert got.columns == ["doc_id", "score"] and all(r.score >= 0 for r in got.collect())


# ---- chats


def test_schema_checks():
    p = lambda v: tool_calls.problems(v, tool_calls.SCHEMAS["reply"])
    assert p({"prompt": "x", "turn": 0}) == []
    assert p({"prompt": "", "turn": -1, "more": 1}) == ["$.more: unknown", "$.prompt: length 0", "$.turn: out of range"]
    assert p({"prompt": 3}) == ["$.turn: missing", "$.prompt: not of type string"]
    assert p([]) == ["$: not of type object"] and p({"prompt": "x", "turn": True}) == ["$.turn: not of type integer"]


def test_linking_order_and_canonical_json(spark):
    calls = spark.createDataFrame(
        [(1, 3, "c", "add", '{"b": 2, "a": 1}', ["b"]), (1, 1, "b", "add", "no json", ["a", "zzz"]), (1, 2, "a", "add", '{"a": 1}', []), (1, 9, "x", "other", "{}", ["y"]), (1, 8, "y", "other", "{}", ["x"]), (2, None, None, None, None, None)],
        "conv_id long, turn long, call_id string, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, 5, "a", "late"), (1, 4, "a", "early"), (1, 6, "lost", "é"), (3, 1, "a", None)], "conv_id long, turn long, call_id string, content string")
    got = {r.conv_id: r for r in tool_calls.format_chats(calls, results, {"add": {"type": "object", "required": ["b"]}}).collect()}
    one = got[1]
    assert one.call_order == "a,b,c,y,x" and not one.acyclic
    assert (one.n_calls, one.n_linked, one.n_orphan_calls, one.n_orphan_results, one.n_invalid) == (5, 1, 4, 1, 4)
    chat = json.loads(one.chat)
    assert chat["calls"][0]["results"] == ["early", "late"] and chat["orphan_results"] == [["lost", "é"]]
    assert one.chat == json.dumps(chat, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[2].n_invalid == 1 and got[3].n_orphan_results == 1


def workload(conv, rows):
    """Calls in order, results, and counts of one conversation's turns, in plain Python."""
    calls, results = [], {}
    for r in sorted(rows, key=lambda r: r.turn):
        text, m = r.text or "", r.turn + len(r.text or "")
        if r.role == "assistant":
            results.setdefault(f"{conv}:{r.turn + 1000 if m % 17 == 2 else r.turn - 1}", []).append(r.text)
        if r.role != "user":
            continue
        name = ("reply", "search", "lookup", "translate")[m % 4]
        if m % 11 == 5:
            arguments = text
        elif name == "reply":
            arguments = {"prompt": text, "turn": r.turn}
        elif name == "search":
            arguments = {"query": text, "limit": str(m % 60) if m % 7 == 3 else m % 60, "filters": {"exact": m % 2 == 1, "order": "best" if m % 3 == 0 else "new"}}
        else:
            arguments = {"keys": text.split(" "), "depth": m % 14} if name == "lookup" else {"text": text}
        bad = isinstance(arguments, str) or name == "translate" or (name != "lookup" and not text)
        bad = bad or (name == "search" and (m % 7 == 3 or not 1 <= m % 60 <= 50)) or (name == "lookup" and m % 14 > 10)
        after = {f"{conv}:{r.turn - 2}"} | ({f"{conv}:{r.turn + 2}"} if m % 13 == 1 else set())
        calls.append({"id": f"{conv}:{r.turn}", "turn": r.turn, "name": name, "arguments": arguments, "bad": bad, "after": after})
    ids = {c["id"] for c in calls}
    done, order = set(), []
    while ready := [c for c in calls if c["id"] not in done and not (c["after"] & ids) - done]:
        order.append(min(ready, key=lambda c: c["turn"]))
        done.add(order[-1]["id"])
    rest = [c for c in calls if c["id"] not in done]
    return order + rest, results, not rest


def test_conversations_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    c = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    got = {r.conv_id: r for r in op10_tool_calls(spark, sf).collect()}
    seen = dict.fromkeys(("invalid", "orphans", "lost", "cyclic"), 0)
    for conv, rows in c.groupby("conv_id"):
        calls, results, acyclic = workload(conv, list(rows.itertuples()))
        r = got.pop(conv)
        linked = sum(x["id"] in results for x in calls)
        lost = sum(len(v) for k, v in results.items() if k not in {x["id"] for x in calls})
        assert (r.n_calls, r.n_linked, r.n_orphan_calls, r.n_orphan_results, r.acyclic) == (len(calls), linked, len(calls) - linked, lost, acyclic)
        assert r.n_invalid == sum(x["bad"] for x in calls) and r.call_order == ",".join(x["id"] for x in calls)
        want = [{"id": x["id"], "name": x["name"], "arguments": x["arguments"], "results": results.get(x["id"], [])} for x in calls]
        chat = json.loads(r.chat)
        assert [{k: v for k, v in x.items() if k != "errors"} for x in chat["calls"]] == want
        assert [bool(x["errors"]) for x in chat["calls"]] == [x["bad"] for x in calls]
        assert r.chat == json.dumps(chat, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        seen["invalid"] += r.n_invalid
        seen["orphans"] += r.n_orphan_calls
        seen["lost"] += r.n_orphan_results
        seen["cyclic"] += not r.acyclic
    assert not got and all(n >= 3 for n in seen.values()), seen


COUNTS_SQL = """WITH t AS (SELECT conv_id, turn, role, turn + coalesce(length(text), 0) AS m, coalesce(text, '') AS text FROM '{sf}/conversations.parquet'),
calls AS (SELECT conv_id, conv_id || ':' || turn AS id, m % 11 = 5 OR m % 4 = 3 OR (m % 4 = 0 AND text = '') OR (m % 4 = 1 AND (text = '' OR m % 7 = 3 OR m % 60 NOT BETWEEN 1 AND 50)) OR (m % 4 = 2 AND m % 14 > 10) AS bad FROM t WHERE role = 'user'),
results AS (SELECT conv_id, conv_id || ':' || CASE WHEN m % 17 = 2 THEN turn + 1000 ELSE turn - 1 END AS id FROM t WHERE role = 'assistant'),
c AS (SELECT conv_id, count(*) AS n_calls, count(*) FILTER (WHERE id IN (SELECT id FROM results)) AS n_linked, count(*) FILTER (WHERE bad) AS n_invalid FROM calls GROUP BY conv_id),
r AS (SELECT conv_id, count(*) FILTER (WHERE id NOT IN (SELECT id FROM calls)) AS n_orphan_results FROM results GROUP BY conv_id),
o AS (SELECT conv_id, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS n_messages FROM t GROUP BY conv_id)
SELECT conv_id, coalesce(n_calls, 0), coalesce(n_linked, 0), coalesce(n_calls - n_linked, 0), coalesce(n_orphan_results, 0), coalesce(n_invalid, 0), n_messages FROM o LEFT JOIN c USING (conv_id) LEFT JOIN r USING (conv_id)"""


def test_counts_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.1"
    got = op10_tool_calls(spark, sf).select("conv_id", "n_calls", "n_linked", "n_orphan_calls", "n_orphan_results", "n_invalid", "n_messages")
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(COUNTS_SQL.format(sf=sf)).fetchall())


def test_arguments_that_are_hard_to_read(spark):
    deep = "[" * 100_000 + "]" * 100_000
    given = [deep, '{"a":' * 900 + "1" + "}" * 900, "NaN", '{"b": Infinity}', "[1e999]", "-Infinity", '"\\ud800"', '{"b": "\\udc00x", "\\ud83d\\ude00": 1}', "9" * 5000, "", None, '{"b": 1, "b": 2}']
    calls = spark.createDataFrame([(i, 1, "c", "add", a, None) for i, a in enumerate(given)], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = {r.conv_id: r for r in tool_calls.format_chats(calls, results, {"add": {}}).collect()}
    assert [got[i].n_invalid for i in range(len(given))] == [1, got[1].n_invalid, 1, 1, 1, 1, 0, 0, 1, 1, 1, 0]
    for i, a in enumerate(given):
        chat = json.loads(got[i].chat, parse_constant=lambda c: 1 / 0)
        call = chat["calls"][0]
        if got[i].n_invalid:
            assert call["arguments"] == a and call["errors"] == ["$: nested too deep" if i < 2 else "$: not JSON"]
    assert json.loads(got[7].chat)["calls"][0]["arguments"] == {"b": "\udc00x", "\U0001f600": 1}


def test_repeated_calls_stay_separate(spark):
    calls = spark.createDataFrame([(1, 1, "a", "add", "{}", ["z"])] * 2 + [(1, 2, "b", "add", "{}", ["a"])], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>").repartition(3)
    results = spark.createDataFrame([(1, 2, "a", "one"), (1, 3, "a", "two")], "conv_id long, turn long, call_id string, content string")
    got = tool_calls.format_chats(calls, results, {"add": {"type": "object"}}).first()
    assert (got.n_calls, got.n_linked, got.n_orphan_calls, got.call_order, got.acyclic) == (3, 2, 1, "a,a,b", True)
    assert [c["results"] for c in json.loads(got.chat)["calls"]] == [["one", "two"], ["one", "two"], []]


def test_every_turn_is_in_its_chat(spark, tmp_path):
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    only = spark.createDataFrame([(-1, 2, "tool", "b"), (-1, 1, "system", "é"), (-1, 2, "tool", "b"), (-2, 1, None, None)], "conv_id long, turn long, role string, text string")
    c.select(only.columns).unionByName(only).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = spark.read.parquet(f"{tmp_path}/conversations.parquet").toPandas().astype(object)
    got = {r.conv_id: r for r in op10_tool_calls(spark, str(tmp_path)).collect()}
    assert set(got) == set(rows.conv_id)
    for conv, turns in rows.groupby("conv_id"):
        others = [{"turn": r.turn, "role": r.role, "content": r.text} for r in turns.itertuples() if r.role not in ("user", "assistant")]
        others.sort(key=lambda m: m["turn"])
        assert json.loads(got[conv].chat)["messages"] == others and got[conv].n_messages == len(others)
        assert got[conv].n_calls + got[conv].n_messages + sum(r.role == "assistant" for r in turns.itertuples()) == len(turns)
    assert got[-1].n_messages == 3 and got[-2].n_messages == 1


def test_empty_chats(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_calls.format_chats(*tool_calls.turns_as_calls(none), {}).count() == 0


# ---- pipeline


def test_pipeline_stages(spark):
    from sparrowdoc.llm.common import materialise

    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    read = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    kept = materialise(corpus_pipeline.drop_toxic(spark, docs, sf), "t")
    assert kept.columns == columns and 150 <= kept.count() <= 200
    lines = materialise(corpus_pipeline.drop_shared_lines(spark, kept, sf), "t")
    import hashlib

    want = {d: sha for d, _, _, sha in deduped(read(kept))}
    assert lines.columns == columns and {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    single = materialise(corpus_pipeline.drop_near_copies(spark, lines, sf), "t")
    assert single.columns == columns and {d for d, _ in read(single)} == {c for _, _, c in joined(read(lines), 5, 80, 100)}
    packed = corpus_pipeline.pack(spark, single, sf)
    assert packed.select("doc_id").distinct().count() == single.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == {d for d, _ in read(single)}
