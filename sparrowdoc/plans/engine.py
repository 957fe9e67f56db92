"""The front doors as queries: search, answers, the document path, extraction, reasoning."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.operators import engine, lexical
from sparrowdoc.operators import reasoning as R
from sparrowdoc.plans import evidence, extracts, sql, texts
from sparrowdoc.plans import lexical as L
from sparrowdoc.plans import reasoning as P
from sparrowdoc.plans.registry import register
from sparrowdoc.sources.tables import load


def asked(s, d):
    """A question of every benchmark text: plain words, phrases, AND and NOT in turn."""
    w = F.split("text", " ")
    part = lambda a, n, by=" ": F.array_join(F.slice(w, a, n), by)
    forms = F.array(
        part(3, 4),
        F.concat(F.lit('"'), part(3, 3), F.lit('" '), part(8, 2)),
        part(3, 2, " AND "),
        F.concat(part(3, 2), F.lit(" NOT "), part(6, 1)),
        F.concat(F.lit('"'), part(3, 2), F.lit('" AND '), part(7, 1)),
    )
    turn = F.col("item_id") % 5
    return load(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.element_at(forms, F.when(turn < 0, 5).otherwise(turn + 1).cast("int")).alias("question"))


def _part(a: int, n: int, by: str = " ") -> str:
    return f"array_to_string(list_slice(string_split(text, ' '), {a}, {a + n - 1}), '{by}')"


ASKED = f"""(SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN {_part(3, 4)} WHEN 1 THEN '"' || {_part(3, 3)} || '" ' || {_part(8, 2)} WHEN 2 THEN {_part(3, 2, " AND ")}
 WHEN 3 THEN {_part(3, 2)} || ' NOT ' || {_part(6, 1)} ELSE '"' || {_part(3, 2)} || '" AND ' || {_part(7, 1)} END AS question FROM benchmark)"""
_NOT = "NOT contains(question, ' AND ') AND contains(question, ' NOT ')"
_NONE = "[]::VARCHAR[]"


def _search(k: int) -> str:
    rest = L._REST
    return f"""(WITH base AS (SELECT doc_id, 0 AS chunk_id, text, {sql.content_terms('text')} AS terms FROM documents), {L.HITS},
p AS (SELECT query_id, contains(question, ' AND ') AS all_of, regexp_extract_all(question, '"([^"]+)"', 1) AS phrases,
 CASE WHEN {_NOT} THEN {L._plain("split_part(" + rest + ", ' NOT ', 1)")} ELSE {L._plain(rest)} END AS asks,
 CASE WHEN contains(question, ' AND ') THEN {L._plain(rest)} ELSE {_NONE} END AS required,
 CASE WHEN {_NOT} THEN {L._plain("split_part(" + rest + ", ' NOT ', 2)")} ELSE {_NONE} END AS excluded FROM {ASKED}),
s AS (SELECT query_id, unnest(asks) AS term FROM p UNION ALL SELECT query_id, unnest({sql.content_terms('ph')}) FROM (SELECT query_id, unnest(phrases) AS ph FROM p)),
qt AS (SELECT query_id, term, count(*) AS times FROM s GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM base),
hits AS (SELECT term, doc_id, chunk_id, dl, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT query_id, doc_id, chunk_id, round(sum(({L.BM25}) * times), 6) AS score FROM hits JOIN dfs USING (term) JOIN qt USING (term) CROSS JOIN stats GROUP BY query_id, doc_id, chunk_id),
good AS (SELECT query_id, doc_id, scored.chunk_id, score FROM scored JOIN p USING (query_id) JOIN base USING (doc_id) WHERE score > 0 AND NOT list_has_any(terms, excluded)
 AND (NOT all_of OR (list_has_all(terms, required) AND len(list_filter(phrases, lambda ph: NOT (contains(lower(text), lower(ph)) AND len({sql.content_terms('ph')}) > 0))) = 0)))
SELECT query_id, doc_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM good) WHERE rank <= {k})"""


register("engine_search", lambda s, d: lexical.boolean_search(L.chunks(s, d), asked(s, d), 5).withColumn("rank", F.col("rank").cast("long")), f"SELECT * FROM {_search(5)}")


def documents(s, d):
    """Metadata of the documents; every seventh has no title and no type."""
    known = F.col("doc_id") % 7 != 0
    source = F.create_map(F.lit("source"), F.col("source"))
    more = F.create_map(F.lit("title"), F.concat(F.lit("Document "), F.col("doc_id")), F.lit("doc_type"), F.col("lang"))
    return load(s, d, "documents").select("doc_id", F.when(known, F.map_concat(source, more)).otherwise(source).alias("metadata"))


def found(s, d):
    hits = lexical.boolean_search(L.chunks(s, d), asked(s, d), 5)
    return engine.results(hits, L.chunks(s, d), documents(s, d)).join(asked(s, d), "query_id")


register(
    "engine_results",
    lambda s, d: found(s, d).select("query_id", "doc_id", "title", "source", "doc_type", "search_type", F.char_length("content").cast("long").alias("length")),
    f"SELECT query_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Untitled' ELSE 'Document ' || doc_id END AS title, source, CASE WHEN doc_id % 7 = 0 THEN 'general' ELSE lang END AS doc_type, 'keyword' AS search_type, length(text) AS length FROM {_search(5)} JOIN documents USING (doc_id)",
)
_WORDS = "list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> ''))"
_Q, _C = _WORDS.format(c="question"), _WORDS.format(c="content")
# Rounded once and as the SQL's round does it: the binary product with 10^4, not the decimals shown.
register(
    "engine_post_process",
    lambda s, d: engine.post_process(found(s, d)).select("query_id", "doc_id", (F.round(F.col("rerank_score") * 10000) / 10000).alias("rerank_score"), "penalty", "snippet_length", F.md5(F.col("snippet").cast("binary")).alias("snippet")),
    f"""SELECT query_id, doc_id, round(score * (1 + 0.2 * (len(list_intersect({_Q}, {_C})) / len({_Q}))), 4) AS rerank_score, CASE WHEN length(content) < 50 THEN 0.8 WHEN length(content) > 1000 THEN 0.9 ELSE 1.0 END AS penalty,
 least(length(content), CASE WHEN length(content) > 200 THEN 203 ELSE length(content) END) AS snippet_length, md5(CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END) AS snippet FROM (SELECT query_id, doc_id, score, question, text AS content FROM {_search(5)} JOIN {ASKED} USING (query_id) JOIN documents USING (doc_id))""",
)


def faulty(s, d):
    """The questions, each tenth left blank, each eleventh far too long."""
    q = F.when(F.col("query_id") % 10 == 3, " ").when(F.col("query_id") % 11 == 4, F.repeat("question", 60)).otherwise(F.col("question"))
    return asked(s, d).withColumn("question", q)


_FAULT = f"(SELECT query_id, CASE WHEN query_id % 10 = 3 THEN 'empty' WHEN query_id % 11 = 4 AND length(question) * 60 > 1000 THEN 'too_long' WHEN query_id % 11 = 4 AND len(string_split_regex(trim(repeat(question, 60)), '\\s+')) > 50 THEN 'too_many_words' ELSE 'ok' END AS status FROM {ASKED})"
register(
    "engine_answer",
    lambda s, d: engine.answer(faulty(s, d), L.chunks(s, d), documents(s, d)).withColumn("answer", F.md5(F.col("answer").cast("binary"))),
    f"""SELECT query_id, status, CASE WHEN status = 'ok' THEN md5(coalesce(substr(text, 1, 500) || '...', 'I couldn''t find any relevant information to answer your question.')) END AS answer, CASE WHEN status = 'ok' THEN coalesce(n, 0) END AS n_sources, CASE WHEN status = 'ok' THEN least(9 * coalesce(n, 0), 90) END AS confidence
 FROM {_FAULT} LEFT JOIN (SELECT query_id, count(*) AS n, min(doc_id) FILTER (WHERE rank = 1) AS doc_id FROM {_search(5)} GROUP BY query_id) USING (query_id) LEFT JOIN (SELECT doc_id, text FROM documents) USING (doc_id)""",
)

# ---- the document path

_SECTIONS = f"""l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT *, trim(line) = '' AS blank, {texts._KIND} AS kind FROM l),
t AS (SELECT *, CASE WHEN coalesce(lag(kind) OVER w <> kind OR lag(blank) OVER w OR blank, TRUE) THEN 1 ELSE 0 END AS turn FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM t),
g AS (SELECT doc_id, run, kind, string_agg(line, ' ' ORDER BY i) AS text FROM r WHERE NOT blank GROUP BY doc_id, run, kind),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS section, kind, {sql.clean("text")} AS text FROM g)"""
_SLID = """(SELECT list_transform(range(1, len(w) + 1, greatest(floor(512 / m)::INT - floor(50 / m)::INT, 1)), lambda i: array_to_string(list_slice(w, i, i + greatest(floor(512 / m)::INT, 1) - 1), ' ')) FROM (SELECT w, length(array_to_string(w, '')) / len(w) AS m FROM (SELECT string_split(text, ' ') AS w)))"""
register(
    "text_stage",
    lambda s, d: engine.process_text(load(s, d, "documents")).withColumns({"content": F.md5(F.col("content").cast("binary")), "chunk_id": F.col("chunk_id").cast("long")}),
    f"""WITH {_SECTIONS}, c AS (SELECT doc_id, section, kind, CASE WHEN length(text) <= 512 THEN [text] WHEN kind = 'paragraph' THEN {texts.overlap_sql("text")} ELSE {_SLID} END AS c FROM sections),
u AS (SELECT doc_id, section, kind, unnest(range(len(c))) AS part, unnest(c) AS content FROM c),
n AS (SELECT doc_id, section, kind, content, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS chunk_id, count(*) OVER (PARTITION BY doc_id) AS total, {texts.importance_sql("content", "general")} AS importance FROM u)
SELECT doc_id, chunk_id, section, kind, md5(content) AS content, importance, total FROM n WHERE length(content) >= 100 OR importance >= 0.8""",
)


def layout(s, d):
    li = load(s, d, "lineitem")
    kind = F.element_at(F.array(F.lit("header"), F.lit("table"), F.lit(None)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("position"), kind.alias("kind"), F.when(F.col("l_returnflag") == "R", " ").otherwise(F.concat_ws(" ", "l_linestatus", "l_partkey")).alias("text"),
        F.when(F.col("l_linenumber") != 2, F.col("l_discount") * 10).alias("confidence"), F.col("l_linenumber").alias("page"),
    )


register(
    "sections_layout",
    lambda s, d: engine.sections_of_layout(layout(s, d)).withColumn("importance", F.round("importance", 4)),
    """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS section, coalesce(['header', 'table', NULL][l_linenumber % 3 + 1], 'paragraph') AS kind, l_linestatus || ' ' || l_partkey AS text,
 round(CASE WHEN l_linenumber = 2 THEN 0.5 ELSE l_discount * 10 END, 4) AS importance, l_linenumber::INT AS page FROM lineitem WHERE l_returnflag <> 'R'""",
)


def files(s, d):
    """The documents as files: some of an unknown kind, some that their reader failed on, some blank."""
    suffix = F.element_at(F.array(*map(F.lit, [".txt", ".MD", ".pdf", ".exe"])), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 9 == 2, " \n").otherwise(F.col("text"))
    return load(s, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id"), suffix).alias("name"), text.alias("text"), F.when(F.col("doc_id") % 5 == 1, "unreadable").alias("error"))


register(
    "ingest_files",
    lambda s, d: engine.process_files(files(s, d))[1],
    """SELECT doc_id, name, error FROM (SELECT doc_id, 'f' || doc_id || ['.txt', '.MD', '.pdf', '.exe'][doc_id % 4 + 1] AS name, CASE WHEN doc_id % 4 = 3 THEN 'unsupported format' WHEN doc_id % 5 = 1 THEN 'unreadable'
 WHEN doc_id % 9 = 2 OR NOT regexp_matches(text, '\\S') THEN 'no text' END AS error FROM documents) WHERE error IS NOT NULL""",
)

# ---- extraction


def headers(s, d):
    o = load(s, d, "orders")
    forms = F.array(F.lit("Quarterly Report"), F.concat(F.lit("issued "), F.date_format("o_orderdate", "MM/dd/yyyy")), F.concat(F.lit("Reference: R-"), F.col("o_custkey")))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.element_at(forms, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("text"))


def semantic(s, d):
    """What a model might have found: some of it blank, some of it a guess."""
    o = load(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit("priority").alias("name"), F.when(F.col("o_custkey") % 4 == 0, " ").otherwise(F.col("o_orderpriority")).alias("value"), F.when(F.col("o_orderkey") % 3 == 0, 0.2).otherwise(0.6).alias("confidence"))


_ALL = f"""(SELECT doc_id, name, value, confidence, 'rule' AS method FROM {extracts._FIELDS}
 UNION ALL SELECT o_orderkey, ['header_title', 'header_date', 'header_reference'][o_orderkey % 3 + 1], ['Quarterly Report', strftime(o_orderdate, '%Y-%m-%d'), 'R-' || o_custkey][o_orderkey % 3 + 1], 0.8, 'layout' FROM orders
 UNION ALL SELECT l_orderkey, unnest(['table_line_no', 'table_quantity', 'table_flag']), unnest([l_linenumber::VARCHAR, (l_quantity::BIGINT)::VARCHAR, l_returnflag]), 0.7, 'layout' FROM lineitem
 UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, 0.6, 'semantic' FROM orders WHERE o_custkey % 4 <> 0 AND o_orderkey % 3 <> 0)"""
register(
    "extract_fields",
    lambda s, d: engine.extract_fields(extracts.invoices(s, d), "invoice", headers(s, d), extracts.tables(s, d), semantic(s, d)).drop("bbox"),
    f"""SELECT doc_id, name, value, round(CASE WHEN count(*) OVER (PARTITION BY doc_id, name) > 1 THEN least(c + 0.05, 1.0) ELSE c END, 4) AS confidence, method FROM (SELECT doc_id, name, value, method,
 CASE WHEN name IN ('total_amount', 'invoice_number', 'due_date') THEN least(k + 0.1, 1.0) WHEN starts_with(name, 'header_') OR starts_with(name, 'table_') THEN greatest(k - 0.1, 0.5) ELSE k END AS c FROM (
 SELECT doc_id, name, value, method, max(confidence) AS k FROM {_ALL} GROUP BY ALL))""",
)

# ---- reasoning

QUESTIONS = ["what is the total tax amount", "when is the payment due", "calculate the total of 12 and 30.5", "tell me more"]


def cases(s, d):
    b = P.bills(s, d)
    question = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return b.select(F.col("l_orderkey").alias("query_id"), question.alias("question"), F.col("l_partkey").alias("doc_id"), F.lit("invoice").alias("doc_type"), "content", (F.col("l_linenumber") / 10).alias("score"))


_CASES = f"(SELECT l_orderkey AS query_id, {QUESTIONS!r}[l_orderkey % 4 + 1] AS question, l_partkey AS doc_id, content, l_linenumber / 10 AS score FROM {P.BILLS})"
_DUE = " OR ".join(f"regexp_matches(content, '(?i){p}')" for p in (*R.DUE, *R.METHODS))
_FOUND = P._LIST.replace("content", "whole")
_OVER = f"len(list_intersect({_Q}, {_C})) / greatest(len({_Q}), 1)"
_OUTCOME = f"""(WITH g AS (SELECT query_id, string_agg(content, chr(10) ORDER BY score DESC, doc_id, content) AS whole, count(DISTINCT doc_id) AS n_docs, max(score) AS top, avg(score) AS mean, bool_or({_DUE}) AS due,
 round(greatest(0.0, least(1.0, ((max(score) + avg(score)) / 2 + avg({_OVER}) + CASE WHEN count(*) > 1 THEN 1 - least(stddev_samp(score), 1.0) ELSE 0 END + count(DISTINCT doc_id) / count(*)) / CASE WHEN count(*) > 1 THEN 4 ELSE 3 END)), 6) AS quality FROM {_CASES} GROUP BY query_id),
a AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'total_calculation' WHEN query_id % 4 = 1 AND due THEN 'due_date_reasoning' ELSE 'retrieval' END AS answered_by, CASE query_id % 4 WHEN 0 THEN 2 WHEN 2 THEN 4 ELSE 0 END AS k FROM g),
b AS (SELECT *, (CASE answered_by WHEN 'total_calculation' THEN CASE WHEN len({_FOUND}) > 2 THEN 0.9 ELSE 0.7 END WHEN 'due_date_reasoning' THEN 0.8 ELSE 0.5 END + 0.95 * k) / (k + 1) AS coherence FROM a),
f AS (SELECT query_id, answered_by, round(coherence, 6) AS reasoning_coherence, quality AS retrieval_quality, round(least(1.0, (coherence + least(n_docs / 2, 1.0) / (k + 1) + 0.2) / 3), 6) AS evidence_strength, 0.9 AS source_reliability, CASE WHEN n_docs > 1 THEN round(mean / top, 6) ELSE 0.5 END AS multi_document_consensus, n_docs, k FROM b)
SELECT *, round((reasoning_coherence + retrieval_quality + evidence_strength + source_reliability + multi_document_consensus) / 5, 6) AS confidence FROM f)"""
register("reason_outcome", lambda s, d: engine.reason(cases(s, d), 2025)[1], f"SELECT * EXCLUDE (k) FROM {_OUTCOME}")
register(
    "reason_chain",
    lambda s, d: engine.reason(cases(s, d), 2025)[0].groupBy("query_id", "step_type").agg(F.count("*").alias("n"), F.min("step").cast("long").alias("first")),
    f"SELECT query_id, CASE answered_by WHEN 'retrieval' THEN 'retrieval' ELSE 'rule_application' END AS step_type, 1 AS n, 0 AS first FROM {_OUTCOME} UNION ALL SELECT query_id, 'calculation', k, 1 FROM {_OUTCOME} WHERE k > 0",
)
register(
    "obligations_and_clauses",
    lambda s, d: P.contracts(s, d).select("o_orderkey", F.array_join(R.obligations(F.concat("content", F.lit(". Party A must give notice. It is responsible for care"))), "|").alias("owed")),
    "SELECT o_orderkey, 'deliver order ' || o_orderkey || '|pay ' || o_custkey || ' units|give notice|care|give notice' AS owed FROM orders",
)


def resumes(s, d):
    c = load(s, d, "customer")
    return c.select(
        "c_custkey",
        F.concat(F.lit("Worked 01/"), 2001 + F.col("c_nationkey") % 5, F.lit(" - 07/"), 2008 + F.col("c_nationkey") % 5, F.lit("; 1990-1995; "), F.col("c_custkey") % 12 + 1, F.lit(" years of experience\nSkills: SQL, Python ,"), F.lower("c_mktsegment"), F.lit("\nPay by: wire\nMaster of Arts, BSc in law")).alias("content"),
    )


register(
    "resume_rules",
    lambda s, d: resumes(s, d).select(
        "c_custkey", R.experience_years(F.col("content"), 2025).alias("years"), F.array_join(R.skills_offered(F.col("content")), "|").alias("skills"), R.payment_method(F.col("content")).alias("method"),
        F.size(R.skills_matched(R.skills_asked(F.lit("Which skill in python, building and law?")), R.skills_offered(F.col("content")))).cast("long").alias("matched"),
    ),
    "SELECT c_custkey, 7 + 5 + c_custkey % 12 + 1 AS years, 'SQL|Python|' || lower(c_mktsegment) AS skills, 'wire' AS method, 1 + CASE WHEN contains('building and law', lower(c_mktsegment)) THEN 1 ELSE 0 END AS matched FROM customer",
)
register(
    "relationships",
    lambda s, d: engine.relationships(evidence.groups(s, d)).select("group_id", "n_docs", "repeated_dates", "consensus", "level", "mismatched_pairs", "date_conflict"),
    f"""SELECT group_id, n_docs, coalesce(n_repeated, 0) AS repeated_dates, score AS consensus, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level, mismatched_pairs, date_conflict
 FROM (SELECT * FROM {evidence.CONFLICTS}) LEFT JOIN (SELECT group_id, score FROM {evidence.CONSENSUS}) USING (group_id) LEFT JOIN (SELECT group_id, count(*) FILTER (WHERE n > 1) AS n_repeated FROM (SELECT group_id, value, count(*) AS n FROM {evidence.vals('date')} GROUP BY ALL) GROUP BY group_id) USING (group_id) WHERE n_docs > 1""",
)


def boosted(s, d):
    kinds = load(s, d, "documents").select("doc_id", F.lit(0).alias("chunk_id"), F.when(F.col("doc_id") % 3 == 0, "header").otherwise("paragraph").alias("kind"))
    return lexical.header_boost(lexical.search(L.chunks(s, d), L.questions(s), 20), kinds)


register(
    "header_boost",
    lambda s, d: boosted(s, d).withColumn("rank", F.col("rank").cast("long")),
    f"SELECT query_id, doc_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM (SELECT query_id, doc_id, chunk_id, score * CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS score FROM ({L.ranked_sql(L.FIXED, L.BM25, 20)}))",
)

