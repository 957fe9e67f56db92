"""Rules over text, calculations, confidence and answers."""

from __future__ import annotations

import ast
import operator
import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.functions import fields as X

# Intent words, and all patterns and weights of this block. Intent words are
# matched as whole words by :func:`intents`, as Java and DuckDB have no common word border.
INTENTS = {
    "calculation": "total|sum|calculate|add|subtract|multiply|divide|how much|how many|percentage",
    "comparison": "compare|vs|versus|difference|better|higher|lower|more|less",
    "temporal": "before|after|during|since|until|when|date|time|period",
    "aggregation": "all|every|each|list|summarize|overview|combined",
}
STYLES = (("definition", ("what is", "what are", "define", "explain")), ("howto", ("how to", "how do", "how can")), ("feature", ("features", "capabilities", "functions", "can it")))
LINE_ITEMS = (r"(\d+(?:\.\d{2})?)\s*(?:each|per|@)", r"quantity\s*:?\s*(\d+)", r"total\s*:?\s*\$?(\d+(?:\.\d{2})?)")
TAX = {"subtotal": r"subtotal\s*:?\s*\$?(\d+(?:\.\d{2})?)", "rate": r"tax\s*(?:rate)?\s*:?\s*(\d+(?:\.\d+)?)\s*%", "amount": r"tax\s*(?:amount)?\s*:?\s*\$?(\d+(?:\.\d{2})?)"}
METHODS = (r"payment\s+method\s*:?\s*([^\n]+)", r"pay\s+by\s*:?\s*([^\n]+)")
ASKED_SKILLS = tuple(rf"{word}\s+(?:in\s+|with\s+)?([^.!?]+)" for word in ("skill", "experience", "knowledge", "proficient", "familiar"))
SKILLS = (r"skills?\s*:?\s*([^\n]+)", r"technologies?\s*:?\s*([^\n]+)", r"programming\s+languages?\s*:?\s*([^\n]+)", r"experience\s+with\s*:?\s*([^\n]+)")
DUE = (r"due\s+(?:date\s*:?\s*)?(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})", r"payment\s+due\s*:?\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})", r"net\s+(\d+)\s+days?")
OBLIGATIONS = r"(?:shall|must|will|agrees? to)\s+([^\n.]+)"
#: The other obligation patterns, each with the group of what is owed.
MORE_OBLIGATIONS = ((r"(responsible for|obligation to|duty to)\s+([^\n.]+)", 2), (r"(party\s+[AB]?)\s+(shall|must|will)\s+([^\n.]+)", 3))
TERMS = {
    "contract_duration": r"term\s*:?\s*(\d+)\s+(?:years?|months?|days?)",
    "effective_date": r"effective\s+date\s*:?\s*([^\n]+)",
    "termination_clause": r"termination\s*:?\s*([^\n]+)",
    "governing_law": r"governing\s+law\s*:?\s*([^\n]+)",
    "jurisdiction": r"jurisdiction\s*:?\s*([^\n]+)",
}
#: Rules by type: name, priority, trigger in the question.
RULES = (
    ("invoice", "total_calculation", 1, "total|sum|amount due"),
    ("invoice", "tax_validation", 2, "tax|vat|gst"),
    ("invoice", "due_date_reasoning", 1, "due date|payment|deadline"),
    ("resume", "experience_calculation", 1, r"years?\s+of\s+experience|experience"),
    ("resume", "skill_matching", 2, "skills?|competenc|abilit"),
    ("resume", "education_analysis", 2, "education|degree|qualification"),
    ("legal", "clause_interpretation", 1, "clause|section|article"),
    ("legal", "obligation_analysis", 1, "obligation|responsibility|duty"),
    ("legal", "term_extraction", 2, "term|condition|requirement"),
)
EDUCATION = (r"(bachelor|master|phd|doctorate)\s+(?:of\s+|in\s+)?([^\n,]+)", r"(b\.?\s*[as]\.?|m\.?\s*[as]\.?|ph\.?\s*d\.?)\s+(?:in\s+)?([^\n,]+)", r"degree\s+in\s+([^\n,]+)", r"graduated\s+(?:from\s+)?([^\n,]+)")
#: The group of what was studied, or where, in each of these.
STUDIED = (2, 2, 1, 1)
CLAUSES = (r"(clause\s+\d+[a-z]?)\s*:?\s*([^\n]+)", r"(section\s+\d+(?:\.\d+)?)\s*:?\s*([^\n]+)", r"(article\s+\d+)\s*:?\s*([^\n]+)")
WEIGHTS = {"source": 0.2, "retrieval": 0.25, "reasoning": 0.2, "calculation": 0.15, "consensus": 0.2}
PRIORS = {"invoice": 0.9, "contract": 0.9, "receipt": 0.8, "report": 0.8, "resume": 0.7}


#: Wanted skills that an offered one is compared with at a time.
SKILLS_A_BLOCK = 1000


def question_fault(c: Column) -> Column:
    """ok, or what is wrong with a question: none, of over 1000 characters, or of over 50 words."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text == "", "empty").when(F.char_length(c) > 1000, "too_long").when(F.size(F.split(text, r"\s+")) > 50, "too_many_words").otherwise("ok")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def intents(q: Column) -> dict[str, Column]:
    """Flags of a question, and its complexity."""
    found = {n: F.lower(q).rlike(f"(^|[^a-z0-9_])({p})([^a-z0-9_]|$)") for n, p in INTENTS.items()}
    level = F.when(found["temporal"] & found["aggregation"], "complex").when(found["calculation"] | found["comparison"], "moderate").otherwise("simple")
    return found | {"complexity": level}


def style(q: Column) -> Column:
    out = None
    for name, phrases in STYLES:
        cond = F.lower(q).rlike("|".join(phrases))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("contextual")


def dispatch(questions: DataFrame) -> DataFrame:
    """(query_id, rule): the rule of highest priority whose trigger a question has, for its document type."""
    s = questions.sparkSession
    rules = s.createDataFrame([(*r, i) for i, r in enumerate(RULES)], "doc_type string, rule string, priority int, trigger string, ord int")
    hits = questions.join(F.broadcast(rules), "doc_type").where(F.expr("rlike(lower(question), trigger)"))
    order = Window.partitionBy("query_id").orderBy("priority", "ord")
    return hits.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", "rule")


def line_item_sum(c: Column) -> tuple[Column, Column]:
    """Sum of all unit prices, quantities and totals in a text, and the confidence in it."""
    found = F.transform(F.flatten(F.array(*[X.find_all(c, f"(?i){p}", 1) for p in LINE_ITEMS])), lambda v: v.cast("double"))
    return F.aggregate(found, F.lit(0.0), lambda a, b: a + b), F.when(F.size(found) > 2, 0.9).otherwise(0.7)


def first_number(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, f"(?i){pattern}", 1), F.lit("")).cast("double")


def tax_check(c: Column) -> Column:
    """Whether the tax named is the rate of the subtotal, to a cent; null if a part is missing."""
    sub, rate, amount = (first_number(c, TAX[k]) for k in ("subtotal", "rate", "amount"))
    return F.abs(sub * rate / 100 - amount) < 0.01


def payment_terms(c: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, f"(?i){p}", 1), F.lit("")) for p in DUE])


def experience_years(c: Column, now: int) -> Column:
    """Stated years, year ranges and month/year ranges (in whole years), summed; an open end reaches to ``now``."""
    months = r"(?i)(\d{1,2})/(\d{4})\s*[-–]\s*(\d{1,2})/(\d{4})"
    part = [F.transform(X.find_all(c, months, g), lambda v: v.cast("long")) for g in (1, 2, 3, 4)]
    ranges = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(part, "abcd", strict=True)]), lambda r: F.floor((12 * (r["d"] - r["b"]) + r["c"] - r["a"]) / 12))
    # What is a range of months is no range of years.
    c = F.regexp_replace(c, months, " ")
    stated = F.transform(X.find_all(c, r"(?i)(\d+)\s+years?\s+(?:of\s+)?experience", 1), lambda v: v.cast("long"))
    starts = X.find_all(c, r"(?i)(\d{4})\s*[-–]\s*(?:\d{4}|[a-z]+)", 1)
    ends = X.find_all(c, r"(?i)\d{4}\s*[-–]\s*(\d{4}|[a-z]+)", 1)
    spans = F.zip_with(starts, ends, lambda a, b: F.when(b.rlike(r"^\d+$"), b).otherwise(F.lit(str(now))).cast("long") - a.cast("long"))
    return F.aggregate(F.concat(stated, spans, ranges), F.lit(0).cast("long"), lambda a, b: a + b)


def education(c: Column) -> Column:
    """What a text says was studied or where, in the order of the patterns."""
    return F.transform(F.flatten(F.array(*[X.find_all(c, f"(?i){p}", g) for p, g in zip(EDUCATION, STUDIED, strict=True)])), lambda v: F.trim(v))


def clauses(c: Column) -> Column:
    """(name, content) of clauses, then of sections, then of articles."""
    return F.flatten(F.array(*[F.arrays_zip(X.find_all(c, f"(?i){p}", 1).alias("name"), F.transform(X.find_all(c, f"(?i){p}", 2), lambda v: F.trim(v)).alias("content")) for p in CLAUSES]))


def obligations(c: Column) -> Column:
    """What is owed, by the patterns in order: a text may be found by several."""
    found = ((OBLIGATIONS, 1), *MORE_OBLIGATIONS)
    return F.flatten(F.array(*[F.transform(X.find_all(c, f"(?i){p}", g), lambda v: F.trim(v)) for p, g in found]))


def payment_method(c: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(c, f"(?i){p}", 1)), F.lit("")) for p in METHODS])


def listed(c: Column, patterns: tuple[str, ...]) -> Column:
    """Distinct comma-separated items after any of the patterns, trimmed, blanks left out."""
    items = F.flatten(F.transform(F.flatten(F.array(*[X.find_all(c, f"(?i){p}", 1) for p in patterns])), lambda v: F.split(v, ",")))
    return F.array_distinct(F.filter(F.transform(items, lambda v: F.trim(v)), lambda v: v != ""))


def skills_asked(question: Column) -> Column:
    return listed(F.lower(question), ASKED_SKILLS)


def skills_offered(content: Column) -> Column:
    return listed(content, SKILLS)


def skills_matched(asked: Column, offered: Column) -> Column:
    """(required, found) of the pairs in which one holds the other, whatever their case."""
    pairs = F.flatten(F.transform(asked, lambda a: F.transform(offered, lambda o: F.struct(a.alias("required"), o.alias("found")))))
    return F.filter(pairs, lambda p: F.contains(F.lower(p["found"]), F.lower(p["required"])) | F.contains(F.lower(p["required"]), F.lower(p["found"])))


def evidence_strength(steps: DataFrame) -> DataFrame:
    """(query_id, strength) of ``steps(query_id, confidence, n_sources, n_outputs)``: mean over the steps."""
    one = (F.col("confidence") + F.least(F.col("n_sources") / 2, F.lit(1.0)) + F.least(F.col("n_outputs") / 5, F.lit(1.0))) / 3
    return steps.groupBy("query_id").agg(F.avg(one).alias("strength"))


def skill_match(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """(doc_id, matched, percent): wanted skills that hold or are held by an offered one.

    Substrings need every combination, so each offered skill meets the wanted
    ones in blocks of about ``SKILLS_A_BLOCK``; Spark sends the blocks to all
    tasks only if they are small. Null skills match nothing.
    """
    each = wanted.select(F.lower("skill").alias("skill")).where("skill is not null").distinct()
    n = each.agg(F.count("*").alias("n"))  # one row
    asked = each.crossJoin(n).groupBy("n", F.pmod(F.xxhash64("skill"), F.ceil(F.col("n") / SKILLS_A_BLOCK)).alias("block")).agg(F.collect_list("skill").alias("asked"))
    asked = n.join(asked.drop("n"), F.lit(True), "left").select("n", F.coalesce("asked", F.array().cast("array<string>")).alias("asked"))
    hits = offered.crossJoin(asked).select("doc_id", F.filter("asked", lambda a: F.contains(a, F.lower("skill")) | F.contains(F.lower("skill"), a)).alias("m"), "n")
    flat = hits.groupBy("doc_id", "n").agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("m"))
    return flat.select("doc_id", F.size("m").cast("long").alias("matched"), F.round(100 * F.size("m") / F.greatest("n", F.lit(1)), 4).alias("percent"))


# ---- calculation -------------------------------------------------------------

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_WORDS = ((r"(\d(?:[\d.]*))%", r"(\1/100)"), (r"\bplus\b", "+"), (r"\bminus\b", "-"), (r"\btimes\b|\bmultiplied by\b", "*"), (r"\bdivided by\b|\bover\b", "/"))


def arithmetic(text: str | None) -> Decimal | None:
    """Value of an arithmetic expression in decimals, by a parser that knows numbers and
    operators only; None for anything else, division by zero or huge powers."""
    if not text:
        return None
    text = re.sub(r"[$€£¥₹,]", "", text.lower())
    for pattern, new in _WORDS:
        text = re.sub(pattern, new, text)

    def value(node):
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return Decimal(str(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return value(node.operand) * (1 if isinstance(node.op, ast.UAdd) else -1)
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and (abs(b) > 100 or abs(a) > 10**12):
                raise ValueError("power out of range")
            return _OPS[type(node.op)](a, b)
        raise ValueError("not arithmetic")

    try:
        return value(ast.parse(text.strip(), mode="eval"))
    except (SyntaxError, ValueError, ArithmeticError, RecursionError):
        return None


def calculate(df: DataFrame, column: str, places: int = 6) -> DataFrame:
    """Adds ``result`` (double, null where ``column`` is no arithmetic), rounded half up."""
    quantum = Decimal(1).scaleb(-places)

    @F.pandas_udf("double")
    def run(s):
        import pandas as pd

        out = [arithmetic(x) for x in s]
        return pd.Series([None if v is None or not v.is_finite() else float(v.quantize(quantum, ROUND_HALF_UP)) for v in out], dtype="float64")

    return df.withColumn("result", run(column))


def invoice_totals(lines: DataFrame) -> DataFrame:
    """(doc_id, subtotal, total) in exact cents: lines less discount plus tax."""
    d = lambda c: F.col(c).cast("decimal(18,4)")
    return lines.groupBy("doc_id").agg(F.sum(d("amount")).cast("double").alias("subtotal"), F.round(F.sum(d("amount") * (1 - d("discount")) * (1 + d("tax"))), 2).cast("double").alias("total"))


# ---- confidence --------------------------------------------------------------


def weighted_confidence(factors: DataFrame) -> DataFrame:
    """(query_id, confidence) of ``factors(query_id, factor, value)``: mean by weight over the factors there are."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("factor")), F.lit(0.1))
    return factors.groupBy("query_id").agg((F.sum(clamp(F.col("value")) * weight) / F.greatest(F.sum(weight), F.lit(0.1))).alias("confidence"))


def retrieval_confidence(hits: DataFrame) -> DataFrame:
    """(query_id, confidence): mean of score level, word overlap, evenness of scores and spread over documents."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    overlap = F.size(F.array_intersect(words("question"), words("content"))) / F.greatest(F.size(words("question")), F.lit(1))
    by = hits.withColumn("overlap", overlap).groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("score").alias("top"), F.avg("score").alias("mean"), F.avg("overlap").alias("overlap"), F.stddev_samp("score").alias("sd"), F.countDistinct("doc_id").alias("docs")
    )
    spread = F.when(F.col("n") > 1, 1 - F.least(F.col("sd"), F.lit(1.0)))
    total = (F.col("top") + F.col("mean")) / 2 + F.col("overlap") + F.coalesce(spread, F.lit(0.0)) + F.col("docs") / F.col("n")
    return by.select("query_id", F.round(clamp(total / F.when(F.col("n") > 1, 4).otherwise(3)), 6).alias("confidence"))


def level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


# ---- answers -----------------------------------------------------------------


def template_answers(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answer, n_sources): the best hit's first 500 characters; a sentence of its own without hits."""
    best = hits.groupBy("query_id").agg(F.max_by("content", F.struct("score", -F.col("doc_id"))).alias("top"), F.count("*").alias("n"))
    none = F.lit("I couldn't find any relevant information to answer your question.")
    return questions.join(best, "query_id", "left").select("query_id", F.when(F.col("n") > 0, F.concat(F.substring("top", 1, 500), F.lit("..."))).otherwise(none).alias("answer"), F.least(F.coalesce("n", F.lit(0)), F.lit(5)).cast("long").alias("n_sources"))


def extractive_answers(hits: DataFrame) -> DataFrame:
    """(query_id, answer): of the best hit's first three sentences the first with a question word, else its start."""
    best = hits.groupBy("query_id").agg(F.max_by(F.struct("content", "question"), F.struct("score", -F.col("doc_id"))).alias("b")).select("query_id", "b.*")
    words = F.filter(F.split(F.lower("question"), r"\s+"), lambda w: w != "")
    firsts = F.filter(F.slice(F.split("content", r"\."), 1, 3), lambda s: F.exists(words, lambda w: F.contains(F.lower(s), w)))
    return best.select("query_id", F.trim(F.coalesce(F.try_element_at(firsts, F.lit(1)), F.substring("content", 1, 200))).alias("answer"))


def parse_sections(c: Column) -> dict[str, Column]:
    """The ANSWER, SOURCES, CONFIDENCE and REASONING parts of a model's reply."""
    names = ("ANSWER", "SOURCES", "CONFIDENCE", "REASONING")
    cut = lambda n: F.trim(F.regexp_extract(F.concat(F.lit("\n"), c), rf"(?s)\n{n}:(.*?)(?=\n(?:{'|'.join(names)}):|$)", 1))
    return {n.lower(): cut(n) for n in names}
