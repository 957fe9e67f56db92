"""The operators' queries: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, license_scan, line_dedup, ngram_join, orc_tokens, packing, spotsigs, telephony, tool_calls, toxicity
from .common import documents


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.store_and_decode(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir), k=3, num=90, den=100)


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(documents(spark, sf_dir))


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.store_and_catalogue(documents(spark, sf_dir))


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), ids=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe_lines(documents(spark, sf_dir), texts=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).withColumn("spans", F.to_json("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    calls, results = tool_calls.turns_as_calls(turns)
    return tool_calls.format_chats(calls, results, tool_calls.SCHEMAS, tool_calls.other_turns(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_telephony": op1_telephony,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_ngram_join": op3_ngram_join,
        "op4_spotsigs": op4_spotsigs,
        "op5_orc_tokens": op5_orc_tokens,
        "op6_prefix_bpe": op6_prefix_bpe,
        "op7_line_dedup": op7_line_dedup,
        "op8_license_scan": op8_license_scan,
        "op9_toxicity": op9_toxicity,
        "op10_tool_calls": op10_tool_calls,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs by shared n-grams, then reachability: quadratic, for small tables.
OP3_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM g),
e AS (SELECT doc_id, unnest(s) AS x FROM g),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT n.doc_id AS doc_id, n AS n_shingles, min(b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n"""

_KEY = f"translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}')"
OP7_SQL = f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, {_KEY} AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, hot.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    """The learned, encoded and hashed results of the other operators are beyond SQL."""
    return {"op3_ngram_join": OP3_SQL, "op7_line_dedup": OP7_SQL}
