"""The n-gram join, components and SpotSigs against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowdoc.llm import components as comps
from sparrowdoc.llm import ngram_join, spotsigs
from sparrowdoc.llm.license_scan import WordHash


def ngrams(t, k):
    w = (t or "").encode().lower().split()
    return frozenset({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else ()))


def joined(rows, k, num, den):
    sets = [ngrams(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
def test_components_of_documents(docs, k, num):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngram_join.ngram_components(docs, k, num, 100).collect())) == joined(rows, k, num, 100)


def chain(n, seed, length=60):
    """Texts each a little other than one before: similar ones, and some just not similar enough."""
    rnd = random.Random(seed)
    out = [[f"w{rnd.randint(0, 5000)}" for _ in range(length)]]
    while len(out) < n:
        t = list(rnd.choice(out))
        for _ in range(rnd.randint(1, 4)):
            t[rnd.randrange(len(t))] = f"w{rnd.randint(0, 5000)}"
        out.append(t)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_large_group_of_near_copies(spark, monkeypatch, k, num):
    rows = list(enumerate(chain(250, 1) + chain(100, 2, 9) + chain(40, 3, 400) + chain(25, 4, 1500)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = joined(rows, k, num, 100)
    assert sorted(map(tuple, ngram_join.ngram_components(df, k, num, 100).collect())) == want
    # Neither sending points and ids to all tasks nor joining links in one task changes anything.
    for name, value in (("SEND_POINTS", -1), ("SEND_IDS", -1), ("BLOCK", 7), ("HOT", 5), ("HELD_BYTES", 1000)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "components", lambda links: comps.components(links, one_task=-1))
    assert sorted(map(tuple, ngram_join.ngram_components(df, k, num, 100).collect())) == want


def test_sets_that_share_a_name_stay_apart(docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    # Four bits: nearly every name is one of several sets.
    assert len(ngram_join._named(docs.select("doc_id", "text"), 3, 4)[1]) > 8
    assert sorted(map(tuple, ngram_join._components(docs, 3, 90, 100, bits=4).collect())) == joined(rows, 3, 90, 100)


def test_tree_skips_leaves():
    rnd = np.random.default_rng(8)
    new = lambda n: rnd.integers(0, 2**63, n).astype(np.uint64)
    for n, a_group in ((200, 8), (600, 1), (3000, 1)):
        # Groups of near copies, as files hold them, and a tree over all.
        sets = []
        for _ in range(20):
            base = new(n)
            sets += [np.r_[base[3:], new(3)] for _ in range(32)]
        points, sizes = np.stack([ngram_join.point(s, a_group) for s in sets]), np.array([len(s) for s in sets])
        tree = ngram_join.CountRTree(points, sizes, 90, 100)
        for i in range(0, 640, 32):
            assert set(range(i, i + 32)) <= set(tree.near(points[i], n).tolist())
        assert tree.visited < 20 * len(tree.levels[0][0]) / 4, (n, tree.visited)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_kinds_of_id(spark, docs, kind):
    want = {(int(r.doc_id), r.n_shingles) for r in ngram_join.ngram_components(docs).collect()}
    cast = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    got = ngram_join.ngram_components(cast)
    assert got.schema["component_id"].dataType.simpleString() == kind
    assert {(int(r.doc_id), r.n_shingles) for r in got.collect()} == want
    assert {int(r.doc_id) for r in ngram_join.keep_one(cast).collect()} >= {0, 3, 6}
    links = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int").select(F.col("a").cast(kind), F.col("b").cast(kind))
    assert {r.label for r in comps.components(links).collect()} == {1 if kind == "int" else "1"}


def test_rows_of_one_doc_id_or_none(spark):
    words = [f"w{i}" for i in range(100)]
    text = lambda a, b: " ".join(words[a:b])
    # 3-shingles: each text is linked with the next one of its line only; 7 stands on texts of two lines.
    rows = [(5, text(0, 60)), (None, text(3, 63)), (6, text(6, 66)), (7, "x " + text(70, 100)), (8, text(70, 100)), (7, "y " + text(40, 70)), (9, text(40, 70)), (None, "z " + text(20, 40)), (None, text(0, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.ngram_components(df).collect()))
    sizes = [len(ngrams(t, 3)) for _, t in rows]
    want = [(5, 5), (0, 5), (6, 5), (7, 7), (8, 7), (7, 7), (9, 7), (0, 0), (0, 0)]
    assert got == sorted((d, n, c) for (d, c), n in zip(want, sizes, strict=True))


def test_linked_sets_share_a_file():
    memo, rnd = WordHash(), random.Random(7)
    for num in (90, 80, 50):
        for n in (1, 2, 5, 9, 10, 19, 40, 200, 900):
            a = np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64)
            for _ in range(20):
                b = a.copy()
                for _ in range(rnd.randint(0, max(1, n // 4))):
                    b[rnd.randrange(n)] = rnd.getrandbits(64)
                b = np.unique(b[: rnd.randint(max(1, int(n * num / 100)), n)])
                x = np.unique(a)
                both = len(np.intersect1d(x, b))
                if 100 * both >= num * (len(x) + len(b) - both):
                    assert np.intersect1d(ngram_join.file_keys(x, num, 100), ngram_join.file_keys(b, num, 100)).size
    assert memo == {}


def test_bound_and_tree_lose_nothing():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 2**63, 500).astype(np.uint64)
    sets = [np.unique(np.r_[rnd.choice(base, rnd.integers(50, 450), replace=False), rnd.integers(0, 2**63, rnd.integers(0, 60)).astype(np.uint64)]) for _ in range(150)]
    points, sizes = np.stack([ngram_join.folded(ngram_join.point(s)) for s in sets]), np.array([len(s) for s in sets])
    tree = ngram_join.CountRTree(points, sizes, 50, 100)
    for i, s in enumerate(sets):
        found = set(tree.near(points[i], len(s)).tolist())
        for j, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            assert ngram_join.bound(points[i], len(s), points[j : j + 1], sizes[j : j + 1])[0] >= both
            if 100 * both >= 50 * (len(s) + len(t) - both):
                assert j in found


@pytest.mark.parametrize("num", [90, 80])
def test_tree_finds_boundary_pairs_in_leaves_of_mixed_sizes(num):
    rnd = np.random.default_rng(num)
    new = lambda n: rnd.integers(0, 2**63, n).astype(np.uint64)
    for n in range(5, 128):
        swapped = n - ngram_join.needed(n, n, num, 100)
        a = new(n)
        b = np.r_[a[swapped:], new(swapped)]
        # One leaf of several: b, and sets of b and one more n-gram.
        sets = [b, *(np.r_[b, new(1)] for _ in range(4 * ngram_join.FAN - 1))]
        points, sizes = np.stack([ngram_join.point(s) for s in sets]), np.array([len(s) for s in sets])
        tree, p = ngram_join.CountRTree(points, sizes, num, 100), ngram_join.point(a)
        passed = np.flatnonzero(ngram_join.bound(p, n, points, sizes) >= ngram_join.needed(n, sizes, num, 100))
        assert 0 in passed and sorted(tree.near(p, n).tolist()) == passed.tolist()


def test_shared_files(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PACKED", 50)
    rows = list(enumerate(chain(30, 5, 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    memo, held = WordHash(), {}
    for _, t in rows:
        s = ngram_join.ngram_set(t, 3, memo)
        for f in ngram_join.file_keys(s, 90, 100).tolist():
            held.setdefault(f, set()).add(s.tobytes())
    got = ngram_join.shared_files(ngram_join.filed(df, 3, 90, 100, 16), 3).collect()
    assert all(r.size == sum(o.file == r.file for o in got) for r in got[:20])
    files = {}
    for r in got:
        files.setdefault(r.file, []).append(r)
    assert sorted(map(len, files.values())) == sorted(len(x) for x in held.values() if len(x) > 1)
    assert all({r.head for r in x} == {min(r.set for r in x)} for x in files.values())


@pytest.mark.parametrize("one_task", [-1, 1000])
def test_components(spark, one_task):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (7, 7), (20, 19), (19, 18), (18, 17), (17, 4), (None, 5)]
    got = {r.node: r.label for r in comps.components(spark.createDataFrame(links, "a long, b long"), one_task).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 17: 1, 18: 1, 19: 1, 20: 1, 8: 8, 9: 8, 7: 7}


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and 9 in ids and not ids & {12, 15, 18} and 21 in ids and 24 not in ids and {0, 3, 6} <= ids


def test_edge_cases(nothing, nulls):
    assert ngram_join.ngram_components(nothing).count() == 0
    assert len(ngram_join.ngram_components(nulls).collect()) == 3


# ---- SpotSigs


def test_edited_and_next(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()))
    got = sorted(spotsigs.compare_edited(docs).collect(), key=lambda r: (r.doc_id, r.n_chars))
    sets = [set(r.fingerprint.split(",")) for r in got]
    for i, ((d, t), r) in enumerate(zip(rows, got, strict=True)):
        nxt, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(edited.encode()).hexdigest())
        e, n = set(r.edited_fingerprint.split(",")), sets[(i + 1) % len(rows)]
        assert abs(r.near_edited - len(sets[i] & e) / len(sets[i] | e)) < 1e-12
        assert abs(r.near_next - len(sets[i] & n) / len(sets[i] | n)) < 1e-12
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[9] == by[12] and by[21] == by[24]
    assert max(len(x) for s in sets for x in s) == 16  # 64 bits


def test_windows_join_up(spark):
    rows = [(i * i, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in spotsigs.with_next(df, "doc_id", ["text"], window_rows=9).collect()}
    assert got == {i * i: f"t{(i + 1) % 200}" for i in range(200)}
    one = spark.createDataFrame([(5, "only")], "doc_id long, text string")
    assert spotsigs.with_next(one, "doc_id", ["text"]).first().next_text == "only"


def test_spotsigs_edge_cases(nothing, nulls):
    assert spotsigs.near_duplicates(nothing).count() == 0 == spotsigs.near_duplicates(nulls).count()
    assert spotsigs.compare_edited(nothing).count() == 0
    assert len(spotsigs.compare_edited(nulls).collect()) == 3


def test_spotsigs_pairs(spark):
    rnd = random.Random(3)
    words = ["the", "of", "and", *[f"word{i}" for i in range(60)]]
    base = " ".join(rnd.choice(words) if i % 4 else "the" for i in range(200))
    texts = [base, base, base.replace("word1 ", "word99 "), " ".join(rnd.choice(words) for _ in range(200)), " ".join(rnd.choice(words) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = {r.doc_id: set(r.sig) for r in spotsigs.with_signatures(df, "text", "sig").collect()}
    assert sigs[0] == sigs[1]
    want = {frozenset((a, b)) for a, b in itertools.combinations([0, 2, 3, 4], 2) if len(sigs[a] & sigs[b]) / len(sigs[a] | sigs[b]) >= 0.6}
    assert {frozenset((r.a, r.b)) for r in spotsigs.near_duplicates(df, 0.6).collect()} == want
