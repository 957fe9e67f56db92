"""Cross-document queries: each customer's orders, written out as invoices, are a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.functions import fields as X
from sparrowdoc.operators import evidence as V
from sparrowdoc.plans import hybrid
from sparrowdoc.plans.extracts import INVOICES, invoices
from sparrowdoc.plans.registry import register
from sparrowdoc.sources.tables import load


def groups(s, d):
    owner = load(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("group_id"))
    return invoices(s, d).join(owner, "doc_id")


G = f"(SELECT o_custkey AS group_id, doc_id, content FROM {INVOICES} AS i JOIN orders ON o_orderkey = doc_id)"


def vals(kind: str) -> str:
    return f"(SELECT group_id, doc_id, unnest(regexp_extract_all(content, '{V.PATTERNS[kind]}')) AS value FROM {G})"


N_DOCS = f"(SELECT group_id, count(DISTINCT doc_id) AS n_docs FROM {G} GROUP BY group_id)"
_X = "TRY_CAST(regexp_replace(value, '[₹$€£¥,\\s]', '', 'g') AS DOUBLE)"
_REFS = "(SELECT DISTINCT group_id, doc_id, upper(unnest(list_concat(" + ", ".join(f"regexp_extract_all(content, '(?i){p}')" for p in V.REFERENCES) + f"))) AS ref FROM {G})"
_REFS = _REFS.replace("list_concat(", "flatten([").replace("))) AS ref", "]))) AS ref")

register(
    "common_entities",
    lambda s, d: V.shared_entities(groups(s, d)),
    f"SELECT group_id, value, n_docs, n_docs = t.of AS in_all FROM (SELECT group_id, value, count(DISTINCT doc_id) AS n_docs FROM {vals('entity')} GROUP BY ALL) JOIN (SELECT group_id, n_docs AS of FROM {N_DOCS}) AS t USING (group_id) WHERE n_docs > 1",
)
register(
    "date_overlaps",
    lambda s, d: V.date_overlaps(groups(s, d)),
    f"SELECT group_id, count(*) AS n_dates, count(*) FILTER (WHERE n > 1) AS n_repeated FROM (SELECT group_id, value, count(*) AS n FROM {vals('date')} GROUP BY ALL) GROUP BY group_id",
)
register(
    "numeric_patterns",
    lambda s, d: V.numeric_patterns(groups(s, d)),
    f"SELECT group_id, n, least, most, sign(s) * ((2 * abs(s) + 100 * n) // (200 * n))::DOUBLE / 10000 AS mean FROM (SELECT group_id, count(x) AS n, round(min(x), 4) AS least, round(max(x), 4) AS most, sum((x::DECIMAL(20, 6) * 1000000)::HUGEINT) AS s FROM (SELECT group_id, {_X} AS x FROM {vals('number')}) GROUP BY group_id)",
)
register(
    "cross_references",
    lambda s, d: V.cross_references(groups(s, d).withColumn("content", F.concat("content", F.lit("REF"), F.col("doc_id") % 3, F.lit("\n")))),
    f"SELECT a.group_id AS group_id, a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared FROM {_REFS.replace('content,', chr(39) + chr(39) + ' || content,')} AS a JOIN {_REFS} AS b ON a.group_id = b.group_id AND a.ref = b.ref AND a.doc_id < b.doc_id GROUP BY ALL".replace("content FROM " + INVOICES, "content || 'REF' || doc_id % 3 || chr(10) AS content FROM " + INVOICES),
)
register(
    "multi_doc_context",
    lambda s, d: load(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("timeline")).where("n > 1"),
    "SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS timeline FROM orders GROUP BY o_custkey HAVING count(*) > 1",
)
register(
    "key_information",
    lambda s, d: load(s, d, "documents").select(
        "doc_id",
        F.size(X.find_all(F.col("text"), X.AMOUNT)).cast("long").alias("n_numbers"),
        F.size(X.find_all(F.col("text"), f"(?i){X.DATE}")).cast("long").alias("n_dates"),
        F.array_join(F.slice(X.find_all(F.col("text"), X.ENTITY), 1, 10), "|").alias("entities"),
        F.array_join(F.filter(F.array(*map(F.lit, ["reation", "pour", "under"])), lambda w: F.contains(F.lower("text"), w)), ",").alias("key_terms"),
    ),
    f"SELECT doc_id, len(regexp_extract_all(text, '{X.AMOUNT}')) AS n_numbers, len(regexp_extract_all(text, '(?i){X.DATE}')) AS n_dates, array_to_string(list_slice(regexp_extract_all(text, '{X.ENTITY}'), 1, 10), '|') AS entities, array_to_string(list_filter(['reation', 'pour', 'under'], lambda w: contains(lower(text), w)), ',') AS key_terms FROM documents",
)
_SET = "list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> ''))"
register(
    "doc_evidence",
    lambda s, d: V.document_evidence(hybrid.hits(s, d)),
    f"SELECT query_id, doc_id, round(len(list_intersect({_SET.format(c='question')}, {_SET.format(c='content')})) / len({_SET.format(c='question')}), 6) AS relevance, round(score, 6) AS quality, 1 AS n_chunks, length(content) AS length FROM {hybrid.HITS_SQL}",
)


def _agree(kind: str) -> str:
    return f"(SELECT group_id, coalesce(max(n), 0) / max(n_docs) AS a FROM {N_DOCS} LEFT JOIN (SELECT group_id, value, count(*) AS n FROM {vals(kind)} GROUP BY ALL) USING (group_id) GROUP BY group_id)"


CONSENSUS = f"(SELECT n.group_id AS group_id, round((n.a + d.a + coalesce(spread, 0)) / 3, 6) AS score FROM {_agree('number')} AS n JOIN {_agree('date')} AS d ON n.group_id = d.group_id LEFT JOIN (SELECT group_id, count(DISTINCT value) / count(*) AS spread FROM {vals('entity')} GROUP BY group_id) AS e ON e.group_id = n.group_id)"
register("consensus", lambda s, d: V.consensus(groups(s, d)), f"SELECT group_id, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM {CONSENSUS}")
CONFLICTS = f"""(WITH nums AS (SELECT DISTINCT * FROM {vals("number")}), have AS (SELECT DISTINCT group_id, doc_id FROM nums),
mis AS (SELECT a.group_id, count(*) AS n FROM have a JOIN have b ON a.group_id = b.group_id AND a.doc_id < b.doc_id WHERE NOT EXISTS (SELECT 1 FROM nums x JOIN nums y ON x.group_id = y.group_id AND x.value = y.value WHERE x.group_id = a.group_id AND x.doc_id = a.doc_id AND y.doc_id = b.doc_id) GROUP BY a.group_id)
SELECT group_id, n_docs, coalesce(n, 0) AS mismatched_pairs, coalesce(dc, FALSE) AS date_conflict FROM {N_DOCS} LEFT JOIN mis USING (group_id) LEFT JOIN (SELECT group_id, count(DISTINCT value) > count(DISTINCT doc_id) AS dc FROM {vals("date")} GROUP BY group_id) USING (group_id))"""
register("conflicts", lambda s, d: V.conflicts(groups(s, d)), f"SELECT * FROM {CONFLICTS}")
register(
    "conflict_resolution",
    lambda s, d: load(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.max("o_totalprice").alias("quality")),
    "SELECT o_custkey, o_orderkey AS best, o_totalprice AS quality FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
)
register(
    "synthesis_confidence",
    lambda s, d: V.consensus(groups(s, d)).join(V.conflicts(groups(s, d)), "group_id").select("group_id", F.round(V.synthesis_confidence(F.col("score"), F.lit(0.8), F.col("n_docs"), F.col("date_conflict").cast("int")), 6).alias("confidence")),
    f"SELECT group_id, round(greatest(0.0, least(1.0, score + 0.06 + least(0.05 * n_docs, 0.15) - 0.1 * date_conflict::INT)), 6) AS confidence FROM {CONSENSUS} JOIN {CONFLICTS} USING (group_id)",
)
