"""Rule, calculation, confidence and answer queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from sparrowdoc.operators import reasoning as R
from sparrowdoc.plans import hybrid

from sparrowdoc.plans.lexical import values
from sparrowdoc.plans.registry import register
from sparrowdoc.sources.tables import load

ASKED = [*hybrid.ASKED, (6, "compare all payments before the date"), (7, "list every clause since then"), (8, "what features can it offer")]
TYPED = [(1, "invoice", "what total tax amount"), (2, "invoice", "when is payment due"), (3, "resume", "skill and degree"), (4, "legal", "duty and duration"), (5, "legal", "nothing fits")]


def table(s, rows, schema):
    return s.createDataFrame(rows, schema)


_I = {n: f"regexp_matches(lower(question), '(^|[^a-z0-9_])({p})([^a-z0-9_]|$)')" for n, p in R.INTENTS.items()}
register(
    "query_intent",
    lambda s, d: table(s, ASKED, "query_id long, question string").select("query_id", *[c.alias(n) for n, c in R.intents(F.col("question")).items()]),
    f"SELECT query_id, {', '.join(f'{c} AS {n}' for n, c in _I.items())}, CASE WHEN {_I['temporal']} AND {_I['aggregation']} THEN 'complex' WHEN {_I['calculation']} OR {_I['comparison']} THEN 'moderate' ELSE 'simple' END AS complexity FROM {values(ASKED, 'query_id, question')}",
)
register(
    "answer_style",
    lambda s, d: table(s, ASKED, "query_id long, question string").select("query_id", R.style(F.col("question")).alias("style")),
    f"SELECT query_id, CASE {' '.join(f'''WHEN regexp_matches(lower(question), '{'|'.join(p)}') THEN '{n}' ''' for n, p in R.STYLES)} ELSE 'contextual' END AS style FROM {values(ASKED, 'query_id, question')}",
)
register(
    "rule_dispatch",
    lambda s, d: R.dispatch(table(s, TYPED, "query_id long, doc_type string, question string")),
    f"SELECT query_id, rule FROM (SELECT query_id, rule, row_number() OVER (PARTITION BY query_id ORDER BY priority, ord) AS n FROM {values(TYPED, 'query_id, doc_type, question')} AS q JOIN {values([(*r, i) for i, r in enumerate(R.RULES)], 'doc_type, rule, priority, trig, ord')} AS r ON q.doc_type = r.doc_type AND regexp_matches(lower(question), trig)) WHERE n = 1",
)
_LIST = "flatten([" + ", ".join(f"regexp_extract_all(content, '(?i){p}', 1)" for p in R.LINE_ITEMS) + "])"


def bills(s, d):
    """Order lines written out as bills."""
    li = load(s, d, "lineitem")
    cents = F.concat(F.floor("l_extendedprice").cast("string"), F.lit(".50"))
    rate = F.round(F.col("l_tax") * 100).cast("int")
    wrong = F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(0)
    amount = F.format_string("%.2f", (F.floor("l_extendedprice") + 0.5) * rate / 100 + wrong)
    due = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("net "), F.col("l_linenumber") * 10, F.lit(" days"))).when(F.col("l_linenumber") % 3 == 1, F.lit("Payment due: 12/31/2024")).otherwise(F.lit("paid"))
    text = F.concat(F.lit("Quantity: "), F.col("l_quantity").cast("long"), F.lit("\nSubtotal: $"), cents, F.lit("\nTax rate: "), rate, F.lit("%\nTax amount: $"), amount, F.lit("\n"), due)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("content"))


BILLS = """(SELECT l_orderkey, l_linenumber, l_partkey, 'Quantity: ' || l_quantity::BIGINT || chr(10) || 'Subtotal: $' || floor(l_extendedprice)::BIGINT || '.50' || chr(10) || 'Tax rate: ' || round(l_tax * 100)::INT || '%' || chr(10) || 'Tax amount: $' ||
 printf('%.2f', (floor(l_extendedprice) + 0.5) * round(l_tax * 100)::INT / 100 + CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) || chr(10) || CASE l_linenumber % 3 WHEN 0 THEN 'net ' || l_linenumber * 10 || ' days' WHEN 1 THEN 'Payment due: 12/31/2024' ELSE 'paid' END AS content FROM lineitem)"""
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _sum(s, d):
    total, sure = R.line_item_sum(F.col("content"))
    return bills(s, d).select(*_KEYS, F.round(total, 2).alias("total"), sure.alias("confidence"))


register("rule_invoice_sum", _sum, f"SELECT l_orderkey, l_linenumber, l_partkey, round(list_sum(list_transform(x, lambda v: v::DOUBLE)), 2) AS total, CASE WHEN len(x) > 2 THEN 0.9 ELSE 0.7 END AS confidence FROM (SELECT *, {_LIST} AS x FROM {BILLS})")


def _num(k: str) -> str:
    return f"nullif(regexp_extract(content, '(?i){R.TAX[k]}', 1), '')::DOUBLE"


register("validate_tax", lambda s, d: bills(s, d).groupBy(R.tax_check(F.col("content")).alias("right")).agg(F.count("*").alias("n")), f"SELECT abs({_num('subtotal')} * {_num('rate')} / 100 - {_num('amount')}) < 0.01 AS \"right\", count(*) AS n FROM {BILLS} GROUP BY 1")
register(
    "payment_terms",
    lambda s, d: bills(s, d).select(*_KEYS, R.payment_terms(F.col("content")).alias("due")),
    f"SELECT l_orderkey, l_linenumber, l_partkey, coalesce({', '.join(f'''nullif(regexp_extract(content, '(?i){p}', 1), '')''' for p in R.DUE)}) AS due FROM {BILLS}",
)


def people(s, d):
    c = load(s, d, "customer")
    return c.select("c_custkey", F.concat(F.lit("Worked "), 1980 + F.col("c_nationkey"), F.lit(" - "), 1990 + F.col("c_nationkey"), F.lit("; then 2015 - present; "), F.col("c_custkey") % 12 + 1, F.lit(" years of experience")).alias("content"))


register(
    "rule_experience",
    lambda s, d: people(s, d).select("c_custkey", R.experience_years(F.col("content"), 2025).alias("years")),
    "SELECT c_custkey, 10 + 10 + c_custkey % 12 + 1 AS years FROM customer",
)
_SKILLS = ["steel", "brass polished", "tin", "copper"]
register(
    "skill_match",
    lambda s, d: R.skill_match(table(s, [(x,) for x in _SKILLS], "skill string"), load(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.split("p_type", " ")).alias("skill"))),
    f"""WITH o AS (SELECT p_partkey AS doc_id, lower(unnest(string_split(p_type, ' '))) AS skill FROM part), w AS (SELECT lower(unnest({_SKILLS!r})) AS a)
SELECT doc_id, count(DISTINCT CASE WHEN contains(a, skill) OR contains(skill, a) THEN a END) AS matched, round(100 * count(DISTINCT CASE WHEN contains(a, skill) OR contains(skill, a) THEN a END) / {len(_SKILLS)}, 4) AS percent FROM o CROSS JOIN w GROUP BY doc_id""",
)


def contracts(s, d):
    o = load(s, d, "orders")
    return o.select("o_orderkey", F.concat(F.lit("The supplier shall deliver order "), F.col("o_orderkey"), F.lit(". The buyer must pay "), F.col("o_custkey"), F.lit(" units.\nTerm: "), F.col("o_custkey") % 9 + 1, F.lit(" years\nGoverning law: "), F.col("o_orderpriority"), F.lit("\nJurisdiction: "), F.col("o_orderstatus")).alias("content"))


CONTRACTS = "(SELECT o_orderkey, 'The supplier shall deliver order ' || o_orderkey || '. The buyer must pay ' || o_custkey || ' units.' || chr(10) || 'Term: ' || (o_custkey % 9 + 1) || ' years' || chr(10) || 'Governing law: ' || o_orderpriority || chr(10) || 'Jurisdiction: ' || o_orderstatus AS content FROM orders)"
register(
    "legal_obligations",
    lambda s, d: contracts(s, d).select("o_orderkey", F.explode(F.regexp_extract_all("content", F.lit(f"(?i){R.OBLIGATIONS}"), F.lit(1))).alias("duty")),
    f"SELECT o_orderkey, unnest(regexp_extract_all(content, '(?i){R.OBLIGATIONS}', 1)) AS duty FROM {CONTRACTS}",
)
register(
    "contract_terms",
    lambda s, d: contracts(s, d).select("o_orderkey", *[F.regexp_extract("content", f"(?i){p}", 1).alias(n) for n, p in R.TERMS.items()]),
    f"SELECT o_orderkey, {', '.join(f'''regexp_extract(content, '(?i){p}', 1) AS {n}''' for n, p in R.TERMS.items())} FROM {CONTRACTS}",
)
# ---- calculation
register(
    "calc_expression",
    lambda s, d: R.calculate(load(s, d, "part").select("p_partkey", F.concat(F.lit("$"), F.col("p_size"), F.lit(" times 3 + 10% - ("), F.col("p_partkey"), F.lit(" / 4)")).alias("e")), "e").select("p_partkey", "result"),
    "SELECT p_partkey, round(p_size * 3 + 0.1::DOUBLE - p_partkey / 4, 6) AS result FROM part",
)
register(
    "calc_financial",
    lambda s, d: load(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_tax").cast("decimal(6,2)")), 2).cast("double").alias("tax")),
    "SELECT l_orderkey, round(sum(l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(6,2)), 2)::DOUBLE AS tax FROM lineitem GROUP BY l_orderkey",
)
register(
    "calc_statistical",
    lambda s, d: load(s, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.median("l_quantity").alias("median"), F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("most"), F.min("l_quantity").alias("least")),
    "SELECT l_partkey, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, sum(l_quantity) AS total, max(l_quantity) AS most, min(l_quantity) AS least FROM lineitem GROUP BY l_partkey",
)
register(
    "invoice_total",
    lambda s, d: R.invoice_totals(load(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").alias("amount"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))),
    "SELECT l_orderkey AS doc_id, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS subtotal, round(sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)) * (1 + l_tax::DECIMAL(4,2))), 2)::DOUBLE AS total FROM lineitem GROUP BY l_orderkey",
)
register(
    "percentage",
    lambda s, d: load(s, d, "part").select("p_partkey", F.round(F.try_divide(F.col("p_size") * 100.0, F.col("p_partkey") % 7), 6).alias("percent")),
    "SELECT p_partkey, round(p_size * 100.0::DOUBLE / nullif(p_partkey % 7, 0), 6) AS percent FROM part",
)
register(
    "validate_calculation",
    lambda s, d: load(s, d, "lineitem").select(*_KEYS, (F.abs(F.col("l_discount") - F.col("l_tax")) <= 0.0101).alias("right"), F.round(F.abs(F.col("l_discount") - F.col("l_tax")) / F.greatest(F.abs("l_discount"), F.lit(0.01)), 6).alias("error")),
    "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - l_tax) <= 0.0101 AS \"right\", round(abs(l_discount - l_tax) / greatest(abs(l_discount), 0.01), 6) AS error FROM lineitem",
)
register(
    "success_rate",
    lambda s, d: load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(100 * F.count_if(F.col("value") > 10) / F.count("*"), 6).alias("rate")),
    "SELECT event_type, count(*) AS n, round(100 * count(*) FILTER (WHERE value > 10) / count(*), 6) AS rate FROM events GROUP BY event_type",
)


# ---- confidence: a line is a factor, an order a question
def factors(s, d):
    names = F.array(*map(F.lit, [*R.WEIGHTS, "other"]))
    li = load(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("query_id"), F.element_at(names, ((F.col("l_linenumber") - 1) % 6 + 1).cast("int")).alias("factor"), (F.col("l_quantity") / 40).alias("value"), F.col("l_discount").alias("spread"), "l_suppkey")


_NAMES = [*R.WEIGHTS, "other"]
_W = "CASE factor " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.WEIGHTS.items()) + " ELSE 0.1 END"
FACTORS = f"(SELECT l_orderkey AS query_id, ({_NAMES!r})[(l_linenumber - 1) % 6 + 1] AS factor, l_quantity / 40 AS value, l_discount AS spread, l_suppkey FROM lineitem)"
_WC = f"sum(least(1.0, value) * {_W}) / greatest(sum({_W}), 0.1)"
register("weighted_confidence", lambda s, d: R.weighted_confidence(factors(s, d)).withColumn("confidence", F.round("confidence", 9)), f"SELECT query_id, round({_WC}, 9) AS confidence FROM {FACTORS} GROUP BY query_id")


def overall(s, d):
    """Weighted confidence moved by evidence, number of sources and spread."""
    f = factors(s, d)
    ev = f.groupBy("query_id").agg(
        (F.least(F.count("*") / 5, F.lit(1.0)) * F.avg(R.clamp(F.col("value"))) * 0.3).alias("evidence"),
        (F.least(F.countDistinct("l_suppkey") / 3, F.lit(1.0)) * 0.2).alias("consensus"),
        (F.coalesce(F.var_samp("spread"), F.lit(0.0)) * 0.1).alias("penalty"),
    )
    out = R.weighted_confidence(f).join(ev, "query_id")
    c = F.round(R.clamp(F.col("confidence") + F.col("evidence") + F.col("consensus") - F.col("penalty")), 9)
    return out.select("query_id", c.alias("confidence")).withColumn("level", R.level(F.col("confidence")))


OVERALL = f"(SELECT query_id, round(greatest(0.0, least(1.0, {_WC} + least(count(*) / 5, 1.0) * avg(least(1.0, value)) * 0.3 + least(count(DISTINCT l_suppkey) / 3, 1.0) * 0.2 - coalesce(var_samp(spread), 0) * 0.1)), 9) AS confidence FROM {FACTORS} GROUP BY query_id)"
register("overall_confidence", overall, f"SELECT query_id, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM {OVERALL}")
register(
    "confidence_histogram",
    lambda s, d: overall(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.8).alias("high"), F.count_if((F.col("confidence") > 0.5) & (F.col("confidence") <= 0.8)).alias("medium"), F.count_if(F.col("confidence") <= 0.5).alias("low"), F.round(F.avg("confidence"), 5).alias("mean")),
    f"SELECT count(*) AS n, count(*) FILTER (WHERE confidence > 0.8) AS high, count(*) FILTER (WHERE confidence > 0.5 AND confidence <= 0.8) AS medium, count(*) FILTER (WHERE confidence <= 0.5) AS low, round(avg(confidence), 5) AS mean FROM {OVERALL}",
)
_SETS = "list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> ''))"
_OV = f"len(list_intersect({_SETS.format(c='question')}, {_SETS.format(c='content')})) / len({_SETS.format(c='question')})"


def unit_hits(s, d):
    h = hybrid.hits(s, d)
    return h.withColumn("score", F.round(F.col("score") / 10, 6))


UNIT = hybrid.HITS_SQL.replace("doc_id, score, question", "doc_id, round(score / 10, 6) AS score, question")
register(
    "retrieval_confidence",
    lambda s, d: R.retrieval_confidence(unit_hits(s, d)),
    f"SELECT query_id, round(greatest(0.0, least(1.0, ((max(score) + avg(score)) / 2 + avg({_OV}) + CASE WHEN count(*) > 1 THEN 1 - least(stddev_samp(score), 1.0) ELSE 0 END + count(DISTINCT doc_id) / count(*)) / CASE WHEN count(*) > 1 THEN 4 ELSE 3 END)), 6) AS confidence FROM {UNIT} GROUP BY query_id",
)
register(
    "uncertainty_level",
    lambda s, d: factors(s, d).groupBy("query_id").agg(F.round(F.least((1 - F.avg(R.clamp(F.col("value"))) + F.coalesce(F.stddev_samp(R.clamp(F.col("value"))), F.lit(0.0))) / 2, F.lit(1.0)), 6).alias("uncertainty"), F.round(F.least(F.countDistinct("l_suppkey") / 5, F.lit(1.0)), 6).alias("diversity")),
    f"SELECT query_id, round(least((1 - avg(least(1.0, value)) + coalesce(stddev_samp(least(1.0, value)), 0)) / 2, 1.0), 6) AS uncertainty, round(least(count(DISTINCT l_suppkey) / 5, 1.0), 6) AS diversity FROM {FACTORS} GROUP BY query_id",
)
_PRIOR = "CASE lang WHEN 'en' THEN 0.9 WHEN 'fr' THEN 0.8 ELSE 0.5 END"
register(
    "source_reliability",
    lambda s, d: load(s, d, "documents").join(load(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("source").agg(F.round(F.avg((F.coalesce(F.col("quality").cast("double"), F.lit(0.5)) + F.least(F.char_length("text") / 500, F.lit(1.0)) + F.when(F.col("lang") == "en", 0.9).when(F.col("lang") == "fr", 0.8).otherwise(0.5)) / 3), 6).alias("reliability")),
    f"SELECT source, round(avg((coalesce(quality::DOUBLE, 0.5) + least(length(text) / 500, 1.0) + {_PRIOR}) / 3), 6) AS reliability FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
)
# In whole numbers (a value is a 40th of a quantity; means in ten-thousandths), so that no order of summing and no rounding of doubles shows.
_MEAN = "(2 * sum(CAST(round(value * 40) AS BIGINT)) * 250 + count(*)) {div} (2 * count(*))"
_SPREAD = "least(b * n - a * a, n * (n - 1) * 100000000)"
_SHARE = "CASE WHEN n < 2 THEN 500000 ELSE (2 * (n * (n - 1) * 100000000 - {spread}) * 1000000 + n * (n - 1) * 100000000) {div} nullif(2 * n * (n - 1) * 100000000, 0) END / 1000000"
register(
    "score_consensus",
    lambda s, d: factors(s, d).groupBy("query_id", "l_suppkey").agg(F.expr(_MEAN.format(div="div")).alias("m")).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("m").alias("a"), F.sum(F.col("m") * F.col("m")).alias("b")).select("query_id", F.expr(_SHARE.format(spread=_SPREAD, div="div")).alias("consensus")),
    f"SELECT query_id, {_SHARE.format(spread=_SPREAD, div='//')} AS consensus FROM (SELECT query_id, count(*) AS n, sum(m)::BIGINT AS a, sum(m * m)::BIGINT AS b FROM (SELECT query_id, l_suppkey, ({_MEAN.format(div='//')})::BIGINT AS m FROM {FACTORS} GROUP BY ALL) GROUP BY query_id)",
)
register(
    "engine_confidence",
    lambda s, d: unit_hits(s, d).groupBy("query_id").agg(F.avg("score").alias("mean"), F.max("score").alias("top"), F.avg(0.7 + F.when(F.col("score") > 0.9, 0.1).otherwise(0.0)).alias("sources")).select("query_id", F.round(R.clamp(0.3 * F.when(F.col("top") > 0.8, F.least(F.col("mean") + 0.1, F.lit(1.0))).otherwise(F.col("mean")) + 0.4 * 0.8 + 0.2 * 1.0 + 0.1 * F.col("sources")), 6).alias("overall")),
    f"SELECT query_id, round(greatest(0.0, least(1.0, 0.3 * CASE WHEN max(score) > 0.8 THEN least(avg(score) + 0.1, 1.0) ELSE avg(score) END + 0.52 + 0.1 * avg(0.7 + CASE WHEN score > 0.9 THEN 0.1 ELSE 0 END))), 6) AS overall FROM {UNIT} GROUP BY query_id",
)
register(
    "synth_confidence",
    lambda s, d: unit_hits(s, d).groupBy("query_id").agg(F.least(F.lit(90), 9 * F.count("*")).cast("long").alias("retrieval"), F.round(0.5 * 80 + 0.3 * F.least(F.lit(90), 9 * F.count("*")) + 0.2 * F.least(F.lit(100), 15 * F.count("*")), 1).alias("overall")),
    f"SELECT query_id, least(90, 9 * count(*)) AS retrieval, round(40 + 0.3 * least(90, 9 * count(*)) + 0.2 * least(100, 15 * count(*)), 1)::DOUBLE AS overall FROM {UNIT} GROUP BY query_id",
)
# ---- answers
_NONE = "I couldn''t find any relevant information to answer your question."
_TOP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n, count(*) OVER (PARTITION BY query_id) AS hits FROM {UNIT}) WHERE n = 1)"
TEMPLATE = f"SELECT q.query_id AS query_id, CASE WHEN hits > 0 THEN substr(content, 1, 500) || '...' ELSE '{_NONE}' END AS answer, least(coalesce(hits, 0), 5) AS n_sources FROM {hybrid.ASKED_SQL} AS q LEFT JOIN {_TOP} AS t ON t.query_id = q.query_id"
register("template_answer", lambda s, d: R.template_answers(hybrid.asked(s), unit_hits(s, d)), TEMPLATE)
register(
    "extractive_answer",
    lambda s, d: R.extractive_answers(unit_hits(s, d)),
    f"SELECT query_id, trim(coalesce(list_filter(list_slice(string_split(content, '.'), 1, 3), lambda x: len(list_filter(list_filter(string_split_regex(lower(question), '\\s+'), lambda w: w <> ''), lambda w: contains(lower(x), w))) > 0)[1], substr(content, 1, 200))) AS answer FROM {_TOP}",
)


def ask(s, d):
    """Retrieval, template answer and confidence of every question in one plan."""
    h = hybrid.hybrid(s, d).join(load(s, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    out = R.template_answers(hybrid.asked(s), h)
    n = h.groupBy("query_id").agg(F.least(F.lit(90), 9 * F.count("*")).cast("long").alias("confidence"))
    return out.join(n, "query_id", "left").select("query_id", F.md5(F.col("answer").cast("binary")).alias("answer"), "n_sources", F.coalesce("confidence", F.lit(0)).alias("confidence"))


register(
    "ask_question",
    ask,
    f"""SELECT q.query_id AS query_id, md5(CASE WHEN hits > 0 THEN substr(text, 1, 500) || '...' ELSE '{_NONE}' END) AS answer, least(coalesce(hits, 0), 5) AS n_sources, coalesce(least(90, 9 * hits), 0) AS confidence
FROM {hybrid.ASKED_SQL} AS q LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS hits FROM ({hybrid.HYBRID_SQL})) AS h ON h.query_id = q.query_id AND h.rank = 1 LEFT JOIN documents USING (doc_id)""",
)
register(
    "source_attribution",
    lambda s, d: unit_hits(s, d).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where("n <= 5").select("query_id", "doc_id", F.when(F.char_length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content")).alias("snippet")),
    f"SELECT query_id, doc_id, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM {UNIT}) WHERE n <= 5",
)


def styled(s, d):
    """Up to three cleaned pieces of a question's hits that are long enough, joined and cut."""
    from sparrowdoc.functions.text import answer_text

    h = unit_hits(s, d).withColumn("piece", answer_text(F.col("content")))
    best = h.where(F.char_length("piece") > 20).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "doc_id", "piece"))).alias("p"))
    return best.select("query_id", F.md5(F.substring(F.array_join(F.transform(F.slice("p", 1, 3), lambda x: x["piece"]), " "), 1, 400).cast("binary")).alias("answer"))


register(
    "styled_answer",
    styled,
    f"""SELECT query_id, md5(substr(string_agg(piece, ' ' ORDER BY score DESC, doc_id), 1, 400)) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM (
 SELECT query_id, doc_id, score, trim(regexp_replace(regexp_replace(content, '(?m)^\\s*[#-]\\s*', '', 'g'), '\\s+', ' ', 'g')) AS piece FROM {UNIT}) WHERE length(piece) > 20 AND NOT ({' OR '.join(f"contains(lower(piece), '{m}')" for m in ['import ', 'from ', 'def ', 'class ', 'if __name__', 'print(', 'return ', '=', '{', '}', ';', '//'])})) WHERE n <= 3 GROUP BY query_id""",
)
REPLIES = "'ANSWER: order ' || o_orderkey || chr(10) || 'SOURCES: a, b' || chr(10) || 'CONFIDENCE: ' || o_custkey % 100 || chr(10) || 'REASONING: because' || chr(10) || 'of it'"
register(
    "parse_llm_sections",
    lambda s, d: load(s, d, "orders").select("o_orderkey", F.concat(F.lit("ANSWER: order "), F.col("o_orderkey"), F.lit("\nSOURCES: a, b\nCONFIDENCE: "), F.col("o_custkey") % 100, F.lit("\nREASONING: because\nof it")).alias("reply")).select("o_orderkey", *[c.alias(n) for n, c in R.parse_sections(F.col("reply")).items()]),
    "SELECT o_orderkey, 'order ' || o_orderkey AS answer, 'a, b' AS sources, (o_custkey % 100)::VARCHAR AS confidence, 'because' || chr(10) || 'of it' AS reasoning FROM orders",
)
register(
    "document_summary",
    lambda s, d: load(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_chunks"), F.sum(F.char_length("text")).cast("long").alias("length"), F.countDistinct("role").alias("roles"), F.min_by("text", "turn").alias("first")).withColumn("first", F.substring("first", 1, 100)),
    "SELECT conv_id, count(*) AS n_chunks, sum(length(text))::BIGINT AS length, count(DISTINCT role) AS roles, substr(arg_min(text, turn), 1, 100) AS first FROM conversations GROUP BY conv_id",
)
register(
    "system_stats",
    lambda s, d: load(s, d, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"), F.round(F.avg(F.char_length("text")), 4).alias("mean_length")),
    "SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, round(avg(length(text)), 4) AS mean_length FROM documents",
)




def studied(s, d):
    c = load(s, d, "customer")
    return c.select("c_custkey", F.concat(F.lit("Bachelor of "), F.col("c_mktsegment"), F.lit(", graduated from school "), F.col("c_nationkey"), F.lit("\nClause 7a: pay "), F.col("c_custkey"), F.lit("\n")).alias("content"))


register(
    "education",
    lambda s, d: studied(s, d).select("c_custkey", F.array_join(R.education(F.col("content")), "|").alias("studied"), F.array_join(F.transform(R.clauses(F.col("content")), lambda x: F.concat_ws(": ", x["name"], x["content"])), "|").alias("clauses")),
    "SELECT c_custkey, c_mktsegment || '|school ' || c_nationkey AS studied, 'Clause 7a: pay ' || c_custkey AS clauses FROM customer",
)
register(
    "evidence_strength",
    lambda s, d: R.evidence_strength(load(s, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_quantity") / 50).alias("confidence"), (F.col("l_partkey") % 4).alias("n_sources"), "l_linenumber").withColumnRenamed("l_linenumber", "n_outputs")).withColumn("strength", F.round("strength", 9)),
    "SELECT l_orderkey AS query_id, round(avg((l_quantity / 50 + least(l_partkey % 4 / 2, 1.0) + least(l_linenumber / 5, 1.0)) / 3), 9) AS strength FROM lineitem GROUP BY l_orderkey",
)
