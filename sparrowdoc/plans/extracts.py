"""Extraction, masking and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.functions import fields as X
from sparrowdoc.operators import extraction as E
from sparrowdoc.operators.reasoning import question_fault
from sparrowdoc.plans.registry import register
from sparrowdoc.sources.tables import clean_metadata, load, upload_problem

docs = lambda s, d: load(s, d, "documents")


def invoices(s, d):
    """Orders written out as invoices."""
    o = load(s, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(
            F.lit("Invoice #: INV-"), F.col("o_orderkey"), F.lit("\nDate: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nTotal: $"), F.format_number("o_totalprice", 2),
            F.lit("\nDue Date: "), F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "MM/dd/yyyy"), F.lit("\nContact: cust"), F.col("o_custkey"), F.lit("@Example.com or 555-010-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("\n"),
        ).alias("content"),
    )


INVOICES = """(SELECT o_orderkey AS doc_id, 'Invoice #: INV-' || o_orderkey || chr(10) || 'Date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'Total: $' || format('{:,.2f}', o_totalprice) || chr(10)
 || 'Due Date: ' || strftime(o_orderdate + INTERVAL 30 DAY, '%m/%d/%Y') || chr(10) || 'Contact: cust' || o_custkey || '@Example.com or 555-010-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || chr(10) AS content FROM orders)"""

register(
    "extract_invoice_fields",
    lambda s, d: E.extract(invoices(s, d), "invoice", ["invoice_number", "total_amount", "due_date"]).select("doc_id", "name", "value", "value_num", F.col("value_date").cast("string").alias("value_date"), "confidence"),
    f"""SELECT doc_id, 'invoice_number' AS name, unnest(regexp_extract_all(content, '(?im)Invoice\\s*#?\\s*:?\\s*([A-Za-z0-9-]+)', 1)) AS value, NULL::DOUBLE AS value_num, NULL::VARCHAR AS value_date, 1.1 AS confidence FROM {INVOICES}
 UNION ALL SELECT doc_id, 'total_amount', v, replace(v, ',', '')::DOUBLE, NULL, 1.25 FROM (SELECT doc_id, unnest(regexp_extract_all(content, '(?im)Total\\s*:?\\s*\\$?\\s*([0-9,]+\\.?\\d*)', 1)) AS v FROM {INVOICES})
 UNION ALL SELECT doc_id, 'due_date', strftime(t, '%Y-%m-%d'), NULL, strftime(t, '%Y-%m-%d'), 1.1 FROM (SELECT doc_id, try_strptime(unnest(regexp_extract_all(content, '(?im)Due\\s*Date\\s*:?\\s*(\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}})', 1)), ['%m/%d/%Y', '%d/%m/%Y']) AS t FROM {INVOICES})""",
)
register(
    "extract_email",
    lambda s, d: E.extract(docs(s, d).select("doc_id", F.col("text").alias("content")), wanted=["email"]).select("doc_id", F.col("ord").cast("long").alias("ord"), "value"),
    f"SELECT doc_id, ord, lower(value) AS value FROM (SELECT doc_id, unnest(range(len(m))) AS ord, unnest(m) AS value FROM (SELECT doc_id, regexp_extract_all(text, '({X.EMAIL})', 1) AS m FROM documents))",
)
register(
    "extract_phone",
    lambda s, d: E.extract(invoices(s, d), wanted=["phone"]).select("doc_id", "value"),
    f"SELECT doc_id, regexp_replace(v, '\\D', '', 'g') AS value FROM (SELECT doc_id, unnest(regexp_extract_all(content, '({X.PHONE})', 1)) AS v FROM {INVOICES}) WHERE length(regexp_replace(v, '\\D', '', 'g')) BETWEEN 7 AND 15",
)
register(
    "extract_dates",
    lambda s, d: invoices(s, d).select("doc_id", F.array_join(X.find_all(F.col("content"), r"\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{1,2}-\d{1,2}"), ",").alias("dates")),
    f"SELECT doc_id, array_to_string(regexp_extract_all(content, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}|\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}'), ',') AS dates FROM {INVOICES}",
)
register(
    "extract_numbers",
    lambda s, d: invoices(s, d).select("doc_id", X.numbers(F.col("content")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 4).alias("total")),
    f"SELECT doc_id, len(x) AS n, round(list_sum(x), 4) AS total FROM (SELECT doc_id, list_transform(regexp_extract_all(content, '{X.NUMBER}'), lambda v: v::DOUBLE) AS x FROM {INVOICES})",
)
_WHEN = {"M/d/yyyy": "%-m/%-d/%Y", "d-M-yyyy": "%-d-%-m-%Y", "yyyy-M-d": "%Y-%-m-%-d", "MMMM d, yyyy": "%B %-d, %Y", "d MMM yyyy": "%-d %b %Y"}


def _written(s, d):
    o = load(s, d, "orders")
    forms = [*[F.date_format("o_orderdate", f) for f in _WHEN], F.lit("13/40/2024")]
    return o.select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("written"))


register(
    "parse_dates",
    lambda s, d: _written(s, d).select("o_orderkey", X.parse_date(F.col("written")).cast("string").alias("day")),
    f"SELECT o_orderkey, strftime(try_strptime(w, ['%m/%d/%Y', '%d/%m/%Y', '%Y-%m-%d', '%m-%d-%Y', '%d-%m-%Y', '%B %d, %Y', '%d %B %Y', '%b %d, %Y', '%d %b %Y']), '%Y-%m-%d') AS day FROM (SELECT o_orderkey, CASE o_orderkey % 6 {' '.join(f'WHEN {i} THEN strftime(o_orderdate, {f!r})' for i, f in enumerate(_WHEN.values()))} ELSE '13/40/2024' END AS w FROM orders)",
)
register(
    "parse_json_fields",
    lambda s, d: E.json_fields(load(s, d, "events").select("event_id", F.concat(F.lit("model says "), F.col("props"), F.lit(" done")).alias("props")), "props"),
    "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
)


def tables(s, d):
    """Order lines as tab-separated tables."""
    li = load(s, d, "lineitem")
    row = F.concat_ws("\t", F.col("l_linenumber"), F.col("l_quantity").cast("long"), F.col("l_returnflag"))
    body = F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r"))))
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("Line No\tQuantity\tFlag\n"), F.array_join(F.transform(body, lambda x: x["r"]), "\n")).alias("content"))


register(
    "extract_table_fields",
    lambda s, d: E.table_fields(tables(s, d)).select("doc_id", "name", "value", "value_num"),
    "SELECT l_orderkey AS doc_id, unnest(['table_line_no', 'table_quantity', 'table_flag']) AS name, unnest([l_linenumber::VARCHAR, (l_quantity::BIGINT)::VARCHAR, l_returnflag]) AS value, unnest([l_linenumber::DOUBLE, l_quantity, NULL]) AS value_num FROM lineitem",
)


def all_fields(s, d):
    return E.extract(invoices(s, d), "invoice").select("doc_id", "ord", "name", "value", "confidence")


_FIELDS = f"""(SELECT doc_id, 'invoice_number' AS name, regexp_extract(content, 'Invoice #: ([A-Za-z0-9-]+)', 1) AS value, 1.1 AS confidence FROM {INVOICES}
 UNION ALL SELECT doc_id, 'total_amount', regexp_extract(content, 'Total: \\$([0-9,.]+)', 1), 1.25 FROM {INVOICES}
 UNION ALL SELECT doc_id, 'due_date', strftime(strptime(regexp_extract(content, 'Due Date: ([0-9/]+)', 1), '%m/%d/%Y'), '%Y-%m-%d'), 1.1 FROM {INVOICES}
 UNION ALL SELECT doc_id, 'email', lower(regexp_extract(content, 'cust[0-9]+@Example.com')), 0.95 FROM {INVOICES}
 UNION ALL SELECT doc_id, 'phone', regexp_replace(unnest(regexp_extract_all(content, '({X.PHONE})', 1)), '\\D', '', 'g'), 0.9 FROM {INVOICES}
 UNION ALL SELECT doc_id, 'date', strftime(strptime(regexp_extract(content, 'Due Date: ([0-9/]+)', 1), '%m/%d/%Y'), '%Y-%m-%d'), 0.9 FROM {INVOICES}
 UNION ALL SELECT doc_id, 'date', regexp_extract(content, 'Date: (\\d{{4}}-\\d\\d-\\d\\d)', 1), 0.9 FROM {INVOICES})"""
_DEDUPED = f"(SELECT doc_id, name, value, max(confidence) AS confidence FROM {_FIELDS} GROUP BY ALL)"
register("fields_dedupe", lambda s, d: E.deduped(all_fields(s, d)).select("doc_id", "name", "value", "confidence"), f"SELECT * FROM {_DEDUPED}")
register(
    "fields_confidence",
    lambda s, d: E.with_confidence(E.deduped(all_fields(s, d)), "invoice").groupBy("doc_id").agg(F.count("*").alias("n_fields"), F.round(F.avg("confidence"), 6).alias("field_confidence"), F.round(0.4 * 0.9 + 0.6 * F.avg("confidence"), 6).alias("overall")),
    f"""SELECT doc_id, count(*) AS n_fields, round(avg(c), 6) AS field_confidence, round(0.36 + 0.6 * avg(c), 6) AS overall FROM (SELECT doc_id, round(CASE WHEN count(*) OVER (PARTITION BY doc_id, name) > 1 THEN least(k + 0.05, 1.0) ELSE k END, 4) AS c FROM (
 SELECT doc_id, name, CASE WHEN name IN ('total_amount', 'invoice_number', 'due_date') THEN least(confidence + 0.1, 1.0) ELSE confidence END AS k FROM {_DEDUPED})) GROUP BY doc_id""",
)
register(
    "validate_contacts",
    lambda s, d: load(s, d, "customer").select("c_custkey", X.is_email(F.concat("c_name", F.lit("@mail.org"))).alias("email"), X.is_phone(F.concat_ws("-", "c_custkey", "c_nationkey", F.lit("555"))).alias("phone")),
    f"SELECT c_custkey, regexp_matches(c_name || '@mail.org', '^{X.EMAIL}$') AS email, length(regexp_replace(c_custkey || '-' || c_nationkey || '-555', '\\D', '', 'g')) BETWEEN 7 AND 15 AS phone FROM customer",
)
_MASKED = "text"
for _k in ("EMAIL", "CREDIT_CARD"):
    _MASKED = f"regexp_replace({_MASKED}, '{X.MASKS[_k][0]}', '{X.MASKS[_k][1]}', 'g')"
register(
    "mask_pii",
    lambda s, d: docs(s, d).select("doc_id", F.md5(X.mask(X.mask(F.col("text"), "EMAIL"), "CREDIT_CARD").cast("binary")).alias("masked")),
    f"SELECT doc_id, md5({_MASKED}) AS masked FROM documents",
)
_DANGER = " OR ".join(f"regexp_matches(html, '(?is){p}')" for p in X.DANGEROUS)
_ESC = "regexp_replace(html, '<[^>]+>', '', 'g')"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _ESC = f"replace({_ESC}, '{_a}', '{_b}')"
register(
    "sanitize_html",
    lambda s, d: load(s, d, "pages").select("page_id", X.dangerous(F.col("html")).alias("rejected"), F.md5(X.escape_html(F.col("html")).cast("binary")).alias("escaped")),
    f"SELECT page_id, {_DANGER} AS rejected, md5({_ESC}) AS escaped FROM pages",
)
register(
    "validate_queries",
    lambda s, d: load(s, d, "benchmark").select("item_id", question_fault(F.col("text")).alias("code")),
    "SELECT item_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 1000 THEN 'too_long' WHEN len(string_split_regex(trim(text), '\\s+')) > 50 THEN 'too_many_words' ELSE 'ok' END AS code FROM benchmark",
)
register(
    "validate_ranges",
    lambda s, d: load(s, d, "lineitem").select((F.col("l_discount").between(0, 1)).alias("confidence_ok"), F.col("l_linenumber").between(1, 7).alias("page_ok"), F.col("l_quantity").between(1, 100).alias("batch_ok")).groupBy("confidence_ok", "page_ok", "batch_ok").agg(F.count("*").alias("n")),
    "SELECT l_discount BETWEEN 0 AND 1 AS confidence_ok, l_linenumber BETWEEN 1 AND 7 AS page_ok, l_quantity BETWEEN 1 AND 100 AS batch_ok, count(*) AS n FROM lineitem GROUP BY ALL",
)
register(
    "ingest_quarantine",
    lambda s, d: docs(s, d).select("doc_id", F.expr("try_cast(regexp_extract(text, '([0-9]{2,})', 1) AS int)").alias("parsed")).select("doc_id", "parsed", F.when(F.col("parsed").isNull(), "no number").alias("error")),
    "SELECT doc_id, TRY_CAST(regexp_extract(text, '([0-9]{2,})', 1) AS INT) AS parsed, CASE WHEN TRY_CAST(regexp_extract(text, '([0-9]{2,})', 1) AS INT) IS NULL THEN 'no number' END AS error FROM documents",
)
register(
    "audit_summary",
    lambda s, d: load(s, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total")),
    "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
register(
    "weighted_average",
    lambda s, d: load(s, d, "lineitem").groupBy("l_orderkey").agg(F.coalesce(F.try_divide(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")), 4), F.sum("l_quantity")), F.lit(0.0)).alias("mean")),
    "SELECT l_orderkey, coalesce(round(sum(l_discount * l_quantity), 4) / nullif(sum(l_quantity), 0), 0) AS mean FROM lineitem GROUP BY l_orderkey",
)
register(
    "header_fields",
    lambda s, d: E.header_fields(load(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.element_at(F.array(F.lit("Quarterly Report"), F.concat(F.lit("issued "), F.date_format("o_orderdate", "MM/dd/yyyy")), F.concat(F.lit("Reference: R-"), F.col("o_custkey"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("text"))),
    "SELECT o_orderkey AS doc_id, ['header_title', 'header_date', 'header_reference'][o_orderkey % 3 + 1] AS name, ['Quarterly Report', strftime(o_orderdate, '%Y-%m-%d'), 'R-' || o_custkey][o_orderkey % 3 + 1] AS value, 0.8 AS confidence FROM orders",
)
register(
    "upload_validation",
    lambda s, d: load(s, d, "pages").select("page_id", upload_problem(F.concat(F.lit("a."), F.element_at(F.array(*map(F.lit, ["pdf", "TXT", "exe", "png"])), (F.col("page_id") % 4 + 1).cast("int"))), (F.col("page_id") % 25) * (1 << 20)).alias("problem")),
    "SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'type' WHEN page_id % 25 = 0 THEN 'empty' WHEN page_id % 25 > [100, 10, 0, 20][page_id % 4 + 1] THEN 'size' END AS problem FROM pages",
)
register(
    "clean_metadata",
    lambda s, d: load(s, d, "pages").select("page_id", clean_metadata(F.create_map(F.concat(F.lit("<b>key"), F.col("page_id")), F.col("html"))).alias("m")).select("page_id", F.element_at(F.map_keys("m"), 1).alias("key"), F.md5(F.element_at(F.map_values("m"), 1).cast("binary")).alias("value")),
    "SELECT page_id, 'key' || page_id AS key, md5(substr(regexp_replace(html, '<[^>]+>', '', 'g'), 1, 1000)) AS value FROM pages",
)
