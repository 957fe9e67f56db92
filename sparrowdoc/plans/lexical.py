"""Lexical queries over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.functions.text import content_terms, tokens
from sparrowdoc.operators import lexical
from sparrowdoc.plans import sql
from sparrowdoc.plans.registry import register
from sparrowdoc.sources.tables import load

#: Questions of the fixed-query plans.
QUESTIONS = [(1, "the reation of mentoi und tion"), (2, "der auf mit von une du"), (3, "under license general public")]
PARSED = [(1, 'find "payment due" total'), (2, "alpha AND beta-gamma the"), (3, "alpha NOT beta delta"), (4, 'plain words "exact phrase" more')]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return lexical.as_chunks(load(spark, d, "documents"))


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id long, question string")


def benchmark_questions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


BASE = f"base AS (SELECT doc_id, 0 AS chunk_id, {sql.content_terms('text')} AS terms FROM documents)"
HITS = "tok AS (SELECT doc_id, chunk_id, len(terms) AS dl, unnest(terms) AS term FROM base)"


def ranked_sql(q: str, weight: str, k: int, where: str = "TRUE") -> str:
    return f"""
WITH {BASE}, {HITS},
q AS (SELECT query_id, unnest({sql.content_terms("question")}) AS term FROM {q}),
qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY query_id, term),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM base),
hits AS (SELECT term, doc_id, chunk_id, dl, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT query_id, doc_id, chunk_id, round(sum(({weight}) * times), 6) AS score
  FROM hits JOIN dfs USING (term) JOIN qt USING (term) CROSS JOIN stats WHERE {where} GROUP BY query_id, doc_id, chunk_id)
SELECT query_id, doc_id, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k}"""


BM25 = "ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
TFIDF = "tf / dl * ln(n / (df + 1))"
BENCH = "(SELECT item_id AS query_id, text AS question FROM benchmark)"
FIXED = values(QUESTIONS, "query_id, question")

register(
    "tokenize",
    lambda s, d: load(s, d, "documents").select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5")),
    f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)",
)
register(
    "stopword_filter",
    lambda s, d: load(s, d, "documents").select("doc_id", F.size(content_terms(F.col("text"))).cast("long").alias("n_terms")),
    f"SELECT doc_id, len({sql.content_terms('text')}) AS n_terms FROM documents",
)
register(
    "inverted_index",
    lambda s, d: lexical.postings(chunks(s, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")),
    f"WITH {BASE}, {HITS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term",
)
register(
    "corpus_stats",
    lambda s, d: lexical.corpus_stats(chunks(s, d)).withColumn("avgdl", F.round("avgdl", 6)),
    f"WITH {BASE}, {HITS} SELECT (SELECT count(*) FROM base) AS n_chunks, (SELECT round(avg(len(terms)), 6) FROM base) AS avgdl, (SELECT count(DISTINCT term) FROM tok) AS vocabulary",
)
register("bm25_topk", lambda s, d: lexical.search(chunks(s, d), questions(s)).withColumn("rank", F.col("rank").cast("long")), ranked_sql(FIXED, BM25, 10))
register("tfidf_topk", lambda s, d: lexical.search(chunks(s, d), questions(s), weight=lexical.tfidf_weight()).withColumn("rank", F.col("rank").cast("long")), ranked_sql(FIXED, TFIDF, 10))
register("bm25_batch", lambda s, d: lexical.search(chunks(s, d), benchmark_questions(s, d), 5).withColumn("rank", F.col("rank").cast("long")), ranked_sql(BENCH, BM25, 5))
register(
    "search_doc_filter",
    lambda s, d: lexical.search(chunks(s, d), questions(s), only=load(s, d, "documents").where("lang = 'en'")).withColumn("rank", F.col("rank").cast("long")),
    ranked_sql(FIXED, BM25, 10, "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
)
register("boolean_and", lambda s, d: lexical.having_all(chunks(s, d), ["en", "und"]).select("doc_id"), f"WITH {BASE} SELECT doc_id FROM base WHERE list_contains(terms, 'en') AND list_contains(terms, 'und')")
register("boolean_not", lambda s, d: lexical.having_none(lexical.having_all(chunks(s, d), ["en"]), ["les", "un"]).select("doc_id"), f"WITH {BASE} SELECT doc_id FROM base WHERE list_contains(terms, 'en') AND NOT list_contains(terms, 'les') AND NOT list_contains(terms, 'un')")
_PHRASES = "(SELECT item_id AS query_id, array_to_string(list_slice(string_split(text, ' '), 3, 8), ' ') AS phrase FROM benchmark)"
register(
    "phrase_search",
    lambda s, d: lexical.phrase_search(chunks(s, d), load(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 3, 6), " ").alias("phrase"))),
    f"SELECT query_id, doc_id, 0 AS chunk_id FROM documents JOIN {_PHRASES} AS p ON contains(lower(text), lower(phrase))",
)
_REST = "regexp_replace(question, '\"[^\"]+\"', ' ', 'g')"


def _plain(c: str) -> str:
    return f"list_filter({sql.content_terms(c)}, lambda t: t NOT IN ('not', 'and', 'or'))"


register(
    "parse_queries",
    lambda s, d: lexical.parse_queries(s.createDataFrame(PARSED, "query_id long, question string")).select("query_id", *[F.array_join(c, "|").alias(c) for c in ("phrases", "terms", "required", "excluded")]),
    f"""SELECT query_id, array_to_string(regexp_extract_all(question, '"([^"]+)"', 1), '|') AS phrases,
 array_to_string(CASE WHEN NOT contains(question, ' AND ') AND contains(question, ' NOT ') THEN {_plain("split_part(" + _REST + ", ' NOT ', 1)")} ELSE {_plain(_REST)} END, '|') AS terms,
 CASE WHEN contains(question, ' AND ') THEN array_to_string({_plain(_REST)}, '|') ELSE '' END AS required,
 CASE WHEN NOT contains(question, ' AND ') AND contains(question, ' NOT ') THEN array_to_string({_plain("split_part(" + _REST + ", ' NOT ', 2)")}, '|') ELSE '' END AS excluded FROM {values(PARSED, "query_id, question")}""",
)
register(
    "term_suggestions",
    lambda s, d: lexical.suggestions(chunks(s, d), "th"),
    f"WITH {BASE} SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(terms)) AS term FROM base) WHERE starts_with(term, 'th') AND length(term) > 2 GROUP BY term ORDER BY df DESC, term LIMIT 10",
)
