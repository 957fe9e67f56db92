"""Line dedup, cuckoo filters and the license scan against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest

from sparrowdoc.llm import license_scan, line_dedup

from .conftest import LICENSED

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def key(line):
    return line.strip(WHITE).translate(LOWER)


def deduped(rows, least=40, docs=5):
    held = collections.defaultdict(list)
    rows = [(-1 if i is None else i, t) for i, t in rows]  # rows without an id are one document, the first
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least and i not in held[k]:
                held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(held[key(x)]) >= docs and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_dedupe(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, line_dedup.dedupe_lines(docs, texts=False).collect()))
    assert got == deduped(rows) and sum(r[2] for r in got) == 5


@pytest.mark.parametrize(("keys", "rows"), [(3, 250_000), (100_000, 4), (2, 2)])
def test_small_shards_and_groups(spark, monkeypatch, keys, rows):
    monkeypatch.setattr(line_dedup, "KEYS_A_SHARD", keys)
    monkeypatch.setattr(line_dedup, "ROWS_A_GROUP", rows)
    given = lines_of(0, 9, 40, 0) + lines_of(5, 3, 4, 100) + [(7, None), (200, "")]
    got = line_dedup.dedupe_lines(spark.createDataFrame(given, "doc_id long, text string").repartition(3), texts=False)
    assert sorted(map(tuple, got.collect())) == deduped(given)


def test_documents_count_and_not_rows(spark):
    line = "this line of forty characters and more is all there is"
    rows = [(1, line)] * 4 + [(2, line)] + [(3, f"{line}\nshort\n{line}")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.dedupe_lines(df, texts=False).collect())) == deduped(rows)
    more = rows + [(4, line), (9, line), (9, line)]
    got = line_dedup.dedupe_lines(spark.createDataFrame(more, "doc_id long, text string"), texts=False)
    want = deduped(more)
    assert sorted(map(tuple, got.collect())) == want and {d: n for d, _, n, _ in want} == {1: 1, 2: 1, 3: 2, 4: 1, 9: 0}
    words = [(f"id{d}", t) for d, t in more]
    got = line_dedup.dedupe_lines(spark.createDataFrame(words, "doc_id string, text string"), texts=False)
    assert sorted((r.doc_id, r.n_dropped) for r in got.collect()) == [(f"id{d}", n) for d, _, n, _ in want]


def test_carried_columns_of_clashing_names(spark):
    line = "this line of forty characters and more is all there is"
    df = spark.createDataFrame([(i, line, 5, "x", "y") for i in range(6)], "doc_id long, text string, n_lines int, _drops string, `a b` string")
    got = line_dedup.dedupe_lines(df, carry=("n_lines", "_drops", "a b"))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept", "_drops", "a b"]
    assert sorted((r.n_lines, r.n_dropped, r._drops, r["a b"]) for r in got.collect()) == [(1, 0, "x", "y")] + [(1, 1, "x", "y")] * 5


def test_insert_and_delete_undo_each_other(docs):
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = line_dedup.LineIndex.create(first, min_docs=3)
    both = index.insert(second)
    whole = line_dedup.LineIndex.create(docs, min_docs=3)
    cols = ["k1", "k2", "n_docs", "max_doc"]
    rows = lambda x: sorted(map(tuple, x.counts.select(cols).collect()))
    assert rows(both) == rows(whole)
    assert sorted(map(tuple, both.dedupe(docs, texts=False).collect())) == sorted(map(tuple, whole.dedupe(docs, texts=False).collect()))
    back = both.delete(second)
    assert rows(back) == rows(index)
    assert sorted(map(tuple, back.dedupe(first, texts=False).collect())) == sorted(map(tuple, index.dedupe(first, texts=False).collect()))


def lines_of(start, n, docs, first):
    text = "\n".join(f"line number {i} that is long enough to be a key" for i in range(start, start + n))
    return [(first + d, text) for d in range(docs)]


def checked_filters(index):
    """Every shared key passes the filter of its shard, and each shard has one that isn't empty."""
    filters = {r.shard: line_dedup.CuckooFilter.from_bytes(bytes(r.filter)) for r in index.filters.collect() if len(r.filter)}
    assert len(filters) == index.filters.count()
    keys = index.counts.where(f"n_docs >= {index.min_docs}").toPandas()
    k1, k2 = keys.k1.to_numpy(), keys.k2.to_numpy()
    for s in np.unique(k1 % index.shards):
        at = k1 % index.shards == s
        assert filters[s].contains(k1[at] >> 8, k2[at]).all()


def test_filters_that_overflow_are_made_anew(spark, monkeypatch):
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    few, many, more = lines_of(0, 10, 5, 0), lines_of(100, 600, 5, 100), lines_of(1000, 30, 5, 200)
    for keys_a_shard in (line_dedup.KEYS_A_SHARD, 100):
        monkeypatch.setattr(line_dedup, "KEYS_A_SHARD", keys_a_shard)
        index = line_dedup.LineIndex.create(table(few))
        for change, given, rows in (("insert", many, few + many), ("insert", more, few + many + more), ("delete", many, few + more)):
            index = getattr(index, change)(table(given))
            checked_filters(index)
            assert sorted(map(tuple, index.dedupe(table(rows), texts=False).collect())) == deduped(rows)
        assert index.shards == (7 if keys_a_shard == 100 else 1)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    k1, k2 = rng.integers(-(2**63), 2**63, (2, 5000))
    f = line_dedup.CuckooFilter.planned(5000)
    assert f.insert(k1, k2) and f.contains(k1, k2).all()
    other = rng.integers(-(2**63), 2**63, (2, 5000))
    assert f.contains(*other).mean() < 0.01
    f.delete(k1[:2500], k2[:2500])
    assert f.contains(k1[2500:], k2[2500:]).all() and f.contains(k1[:2500], k2[:2500]).mean() < 0.01
    assert line_dedup.CuckooFilter.from_bytes(f.to_bytes()).contains(k1[2500:], k2[2500:]).all()


def test_null_ids_and_empty_tables(spark, nothing, nulls):
    assert line_dedup.dedupe_lines(nothing).count() == 0
    got = line_dedup.dedupe_lines(nulls).collect()
    assert sorted(r.n_lines for r in got) == [1, 1, 1] and all(r.n_dropped == 0 for r in got)
    line = "this line of forty characters and more is all there is"
    same = spark.createDataFrame([(None, line)] * 4 + [(2, line)], "doc_id long, text string")
    # Rows without an id are one document, so here are two.
    assert {r.n_dropped for r in line_dedup.dedupe_lines(same).collect()} == {0}
    got = line_dedup.dedupe_lines(same, min_docs=2).collect()
    assert sorted((r.doc_id or -1, r.n_dropped) for r in got) == [(-1, 1)] * 4 + [(2, 0)]
    assert {r.n_dropped for r in line_dedup.dedupe_lines(spark.createDataFrame([(1, line), (2, "short")], same.schema), min_docs=1).collect()} == {0}


def test_many_changes_leave_what_their_sum_leaves(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PARTS", 3)
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    held = lines_of(0, 4, 5, 0)
    index = line_dedup.LineIndex.create(table(held))
    for i in range(1, 5):
        new = lines_of(2 * i, 5, 3, 10 * i)
        index = index.insert(table(new))
        held += new
        if i % 2:
            # One that is there and one that never was.
            index = index.delete(table([(10 * i, ""), (777, "")]))
            held = [x for x in held if x[0] != 10 * i]
    assert len(index.ref_parts) <= 4
    checked_filters(index)
    assert sorted(map(tuple, index.dedupe(table(held), texts=False).collect())) == deduped(held)
    again = index.insert(table(held))  # what is there already changes nothing
    assert sorted(map(tuple, again.counts.collect())) == sorted(map(tuple, index.counts.collect()))


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def scanned(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for j in range(len(words) - len(p) + 1):
            if words[j : j + len(p)] == p:
                at.append(j)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_scan(docs, nothing, nulls):
    got = license_scan.scan(docs).collect()
    want = sorted((r.doc_id, *scanned(r.text)) for r in docs.select("doc_id", "text").collect())
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    full = next(r for r in got if r.n_base)
    assert full.labels == "cc-by,gpl,mit,reserved" and full.score == 1.0 and len(full.spans) == 4
    assert license_scan.scan(nothing).count() == 0 and license_scan.scan(nulls).count() == 3


def test_scan_merges_neighbouring_diagonals(spark):
    text = "permission is hereby granted free of any charge to every person obtaining a copy of this software"
    got = license_scan.scan(spark.createDataFrame([(1, text), (2, "permission is granted"), (3, "cc by cc by")], "doc_id long, text string"))
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].labels == "mit" and len(by[1].spans) == 1 and 0.6 <= by[1].score < 1
    assert by[2].labels == "" and by[2].score == 0
    assert (by[3].n_base, by[3].first_word, by[3].last_word) == (2, 0, 2)


def spans_by_hand(text, k=2, near=3, cover=0.6):
    """The method's spans, from the words themselves: every diagonal of every pair of equal k-grams."""
    words = license_scan.words_of(text)
    out = []
    for number, template in enumerate(license_scan.TEMPLATES, 1):
        own = license_scan.words_of(template.text)
        at = {}
        for p in range(len(words) - k + 1):
            for q in range(len(own) - k + 1):
                if words[p : p + k] == own[q : q + k]:
                    at.setdefault(p - q, []).append((p, q))
        grams = len(own) - k + 1
        if template.base:
            out += [(number, d, d + len(own) - 1, 1.0) for d, x in at.items() if len(x) == grams]
            continue
        groups = []
        for d in sorted(at):
            if groups and d - groups[-1][-1] <= near and d - groups[-1][0] <= len(own):
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            hits = [x for d in g for x in at[d]]
            part = len({q for _, q in hits}) / grams
            if part >= cover:
                out.append((number, min(p for p, _ in hits), max(p for p, _ in hits) + k - 1, part))
    return sorted(out)


def test_spans_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(1, 4)):
            own = rnd.choice(license_scan.TEMPLATES).text.split() * rnd.randint(1, 2)
            for _ in range(rnd.randint(0, 3)):
                own.insert(rnd.randrange(len(own)), "word") if rnd.random() < 0.5 else own.pop(rnd.randrange(len(own)))
            words += own + ["filler"] * rnd.randint(0, 5)
        rows.append((i, " ".join(words)))
    rows += [(500, "licensed under the " * 40 + "mit license"), (501, None), (502, "")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, text in rows:
        assert [tuple(s) for s in got[i].spans] == spans_by_hand(text), text
        assert got[i].n_words == len((text or "").split())


def test_texts_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, LICENSED)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    plan = license_scan.scan(spark.read.parquet(f"{tmp_path}/d"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("hashpartitioning(row") == 1
