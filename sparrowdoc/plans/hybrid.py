"""Query expansion, multi-query and hybrid retrieval, reranking and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.operators import expansion as E
from sparrowdoc.operators import fusion, lexical, vector
from sparrowdoc.plans import lexical as L
from sparrowdoc.plans import sql
from sparrowdoc.plans.registry import register
from sparrowdoc.sources.tables import load

ASKED = [
    (1, "what is the total amount of the invoice"),
    (2, "how to list skills and experience"),
    (3, "when is the due date of a contract"),
    (4, "plain words und une reation"),
    (5, "company vendor clause education"),
]
asked = lambda s: s.createDataFrame(ASKED, "query_id long, question string")
ASKED_SQL = L.values(ASKED, "query_id, question")

_SYN = "{" + ", ".join(f"'{w}': {x!r}" for w, x in E.SYNONYMS.items()) + "}"
_SYN_CASE = "CASE " + " ".join(f"WHEN w = '{w}' THEN {x!r}" for w, x in E.SYNONYMS.items()) + " ELSE []::VARCHAR[] END"
_SYN_LIST = f"list_slice(flatten(list_transform(string_split_regex(lower(question), '\\s+'), lambda w: {_SYN_CASE})), 1, 3)"
_HYP = "CASE " + " ".join(f"WHEN starts_with(lower(question), '{w}') THEN '{t}' || trim(replace(question, '{w}', ''))" for w, t in E.TEMPLATES.items()) + " END"
_REF = "question"
for _a, _b in E.REFORMULATIONS:
    _REF = f"regexp_replace({_REF}, '{_a}', '{_b}', 'gi')"

register("expand_synonyms", lambda s, d: asked(s).select("query_id", F.array_join(E.synonyms(F.col("question")), " ").alias("synonyms")), f"SELECT query_id, array_to_string({_SYN_LIST}, ' ') AS synonyms FROM {ASKED_SQL}")
register("expand_hypothetical", lambda s, d: asked(s).select("query_id", E.hypothetical(F.col("question")).alias("hypothetical")), f"SELECT query_id, {_HYP} AS hypothetical FROM {ASKED_SQL}")
register("expand_reformulate", lambda s, d: asked(s).select("query_id", E.reformulated(F.col("question")).alias("reformulated")), f"SELECT query_id, nullif({_REF}, question) AS reformulated FROM {ASKED_SQL}")
VARIANTS = f"""(SELECT query_id, 'original' AS variant, question FROM {ASKED_SQL} UNION ALL
 SELECT query_id, 'synonyms', question || ' ' || array_to_string({_SYN_LIST}, ' ') FROM {ASKED_SQL} WHERE len({_SYN_LIST}) > 0 UNION ALL
 SELECT query_id, 'hypothetical', {_HYP} FROM {ASKED_SQL} WHERE {_HYP} IS NOT NULL UNION ALL
 SELECT query_id, 'reformulated', {_REF} FROM {ASKED_SQL} WHERE {_REF} <> question)"""
register("expand_all", lambda s, d: E.variants(asked(s)), f"SELECT query_id, variant, question FROM {VARIANTS}")


def keyword(s, d, k=10):
    return E.multiquery(E.keyword_hits(L.chunks(s, d), asked(s), k), k, 0.8, k)


def _bm25_variants(k: int) -> str:
    inner = L.ranked_sql(f"(SELECT query_id || '/' || variant AS query_id, question FROM {VARIANTS})", L.BM25, k)
    return f"(SELECT split_part(query_id, '/', 1)::BIGINT AS query_id, split_part(query_id, '/', 2) AS variant, doc_id, score, rank FROM ({inner}))"


def _best(hits: str, others: float, others_k: int, k: int) -> str:
    return f"""SELECT query_id, doc_id, 0 AS chunk_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT query_id, doc_id, max(round(CASE WHEN variant = 'original' THEN score ELSE score * {others} END, 6)) AS score FROM {hits} AS h WHERE variant = 'original' OR rank <= {others_k} GROUP BY query_id, doc_id)) WHERE rank <= {k}"""


KEYWORD_SQL = _best(_bm25_variants(10), 0.8, 10, 10)
register("keyword_multiquery", lambda s, d: keyword(s, d).withColumn("rank", F.col("rank").cast("long")), KEYWORD_SQL)

DIMS = 16


def semantic(s, d, k=10):
    """Stand-in embeddings of documents and of every variant of a question."""
    docs = load(s, d, "documents").select(F.col("doc_id").alias("vec_id"), vector.hash_embedding(F.col("text"), DIMS).alias("embedding"))
    v = E.variants(asked(s)).withColumn("n", F.when(F.col("variant") == "original", 0).when(F.col("variant") == "synonyms", 1).when(F.col("variant") == "hypothetical", 2).otherwise(3))
    q = v.select((F.col("query_id") * 10 + F.col("n")).alias("query_id"), vector.hash_embedding(F.col("question"), DIMS).alias("embedding"))
    hits = vector.knn(docs, q, k).select(F.floor(F.col("query_id") / 10).alias("query_id"), F.when(F.col("query_id") % 10 == 0, "original").otherwise("other").alias("variant"), F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_id"), "score", "rank")
    return E.multiquery(hits, k, 0.9, k // 2)


def _hashed(c: str) -> str:
    return f"list_transform(range({DIMS}), lambda i: ((('0x' || substr(md5({c}), 1, 8))::BIGINT % 1000000 + i) % 1000) / 1000.0::DOUBLE)"


_KNN = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT query_id, variant, doc_id, round(list_cosine_similarity(q.e::DOUBLE[], v.e::DOUBLE[]), 6) AS score FROM (SELECT query_id, variant, {_hashed("question")} AS e FROM {VARIANTS}) AS q, (SELECT doc_id, {_hashed("text")} AS e FROM documents) AS v)) WHERE rank <= 10)"""
SEMANTIC_SQL = _best(_KNN, 0.9, 5, 10)
register("semantic_multiquery", lambda s, d: semantic(s, d).withColumn("rank", F.col("rank").cast("long")), SEMANTIC_SQL)


def hybrid(s, d, k=10):
    """Expansion, both searches, reciprocal ranks, best ten."""
    fused = fusion.fuse(semantic(s, d).drop("rank"), keyword(s, d).drop("rank"))
    return lexical.rank(fused, k)


HYBRID_SQL = f"""SELECT query_id, doc_id, 0 AS chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT query_id, doc_id, round(CASE WHEN max(kn) = 0 THEN max(ss) WHEN max(sn) = 0 THEN max(ks) ELSE coalesce(max(0.6 / (60 + sr)), 0) + coalesce(max(0.4 / (60 + kr)), 0) END, 6) AS score FROM (
  SELECT query_id, doc_id, score AS ss, rank AS sr, NULL AS ks, NULL AS kr, count(*) OVER (PARTITION BY query_id) AS sn, (SELECT count(*) FROM ({KEYWORD_SQL}) AS k WHERE k.query_id = s.query_id) AS kn FROM ({SEMANTIC_SQL}) AS s
  UNION ALL SELECT query_id, doc_id, NULL, NULL, score, rank, (SELECT count(*) FROM ({SEMANTIC_SQL}) AS s WHERE s.query_id = k.query_id), count(*) OVER (PARTITION BY query_id) FROM ({KEYWORD_SQL}) AS k)
 GROUP BY query_id, doc_id)) WHERE rank <= 10"""
register("hybrid_retrieve", lambda s, d: hybrid(s, d).withColumn("rank", F.col("rank").cast("long")), HYBRID_SQL)


def hits(s, d):
    """BM25 hits with their questions and contents."""
    found = lexical.search(L.chunks(s, d), asked(s), 10)
    return found.join(asked(s), "query_id").join(load(s, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")


HITS_SQL = f"(SELECT query_id, doc_id, score, question, text AS content FROM ({L.ranked_sql(ASKED_SQL, L.BM25, 10)}) JOIN {ASKED_SQL} USING (query_id) JOIN documents USING (doc_id))"
_SET = "list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> ''))"
_Q, _C = _SET.format(c="question"), _SET.format(c="content")
register("rerank_overlap", lambda s, d: E.rerank(hits(s, d)).select("query_id", "doc_id", "score", F.round("rerank_score", 6).alias("rerank_score")), f"SELECT query_id, doc_id, score, round(score * (1 + 0.2 * len(list_intersect({_Q}, {_C})) / len({_Q})), 6) AS rerank_score FROM {HITS_SQL}")
register(
    "highlight",
    lambda s, d: hits(s, d).select("query_id", "doc_id", F.md5(E.highlighted(F.col("content"), F.col("question")).cast("binary")).alias("marked")),
    f"SELECT query_id, doc_id, md5(list_reduce(list_filter(string_split_regex(lower(question), '\\s+'), lambda t: length(t) > 2), lambda acc, t: regexp_replace(acc, t, '**' || t || '**', 'gi'), content)) AS marked FROM {HITS_SQL}",
)
_CL = "lower(content)"
_TERMS = "list_filter(string_split_regex(lower(question), '\\s+'), lambda t: t <> '')"
_LONG = "list_filter(string_split_regex(lower(question), '\\s+'), lambda t: length(t) > 2)"
_N = f"greatest(len(list_filter(string_split_regex({_CL}, '\\s+'), lambda t: t <> '')), 1)"
_FREQ = f"list_sum(list_transform({_LONG}, lambda t: (length({_CL}) - length(replace({_CL}, t, ''))) / length(t) / {_N})) / len({_LONG})"
_FIRST = f"list_min(list_filter(list_transform({_TERMS}, lambda t: instr({_CL}, t)), lambda i: i > 0))"
register(
    "relevance_signals",
    lambda s, d: E.signals(hits(s, d)).select("query_id", "doc_id", "frequency", "position", "penalty", "strength"),
    f"""SELECT query_id, doc_id, round(f, 6) AS frequency, round(p, 6) AS position, penalty, round(round(f, 6) * round(p, 6) * penalty, 6) AS strength FROM (
 SELECT query_id, doc_id, {_FREQ} AS f, coalesce(1 - ({_FIRST} - 1) / length({_CL}), 0.0) AS p, CASE WHEN length(content) < 50 THEN 0.8 WHEN length(content) > 1000 THEN 0.9 ELSE 1.0 END AS penalty FROM {HITS_SQL})""",
)
