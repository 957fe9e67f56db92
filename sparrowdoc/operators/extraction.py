"""Field extraction by rules, typing, deduplication and confidence.

The rule table is a small list on the driver; every rule becomes an expression
over the same scan, so a document is read once whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.functions import fields as X


@dataclass(frozen=True)
class Rule:
    field: str
    pattern: str
    kind: str
    boost: float = 0.0
    group: int = 1


# The rules by document type; patterns ignore case.
RULES = {
    "common": (
        Rule("email", f"({X.EMAIL})", "email"),
        Rule("phone", f"({X.PHONE})", "phone"),
        Rule("date", r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})", "date"),
        Rule("date", r"(\d{4}-\d{1,2}-\d{1,2})", "date"),
    ),
    "invoice": (
        Rule("invoice_number", r"Invoice\s*#?\s*:?\s*([A-Za-z0-9-]+)", "text", 0.2),
        Rule("invoice_number", r"Invoice\s*Number\s*:?\s*([A-Za-z0-9-]+)", "text", 0.2),
        Rule("total_amount", r"Total\s*:?\s*\$?\s*([0-9,]+\.?\d*)", "number", 0.3),
        Rule("total_amount", r"Amount\s*Due\s*:?\s*\$?\s*([0-9,]+\.?\d*)", "number", 0.3),
        Rule("due_date", r"Due\s*Date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{4})", "date", 0.2),
    ),
    "resume": (
        Rule("years_experience", r"(\d+)\s*(?:years?|yrs?)\s*(?:of\s*)?experience", "number", 0.2),
        Rule("education_degree", r"(Bachelor|Master|PhD|B\.?A\.?|M\.?A\.?|B\.?S\.?|M\.?S\.?)", "text", 0.2),
        Rule("education_degree", r"(Associates?|Doctorate)", "text", 0.2),
    ),
    "legal_contract": (
        Rule("effective_date", r"Effective\s*Date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{4})", "date", 0.2),
        Rule("contract_value", r"Contract\s*Value\s*:?\s*\$?\s*([0-9,]+\.?\d*)", "number", 0.2),
    ),
}
CONFIDENCE = {"text": 0.9, "number": 0.95, "date": 0.9, "email": 0.95, "phone": 0.9}
KEY_FIELDS = {"invoice": ["total_amount", "invoice_number", "due_date"], "resume": ["email", "phone", "years_experience"], "legal_contract": ["effective_date", "contract_value"]}


def typed(raw: Column, kind: str, day: Column | None = None) -> tuple[Column, Column, Column]:
    """(text, number, date) of a found value; all null where it doesn't fit its kind. ``day``: the value parsed as a date."""
    none_n, none_d = F.lit(None).cast("double"), F.lit(None).cast("date")
    if kind == "number":
        n = F.expr("try_cast(regexp_replace(raw, '[,$ ]', '') AS double)")
        return F.when(n.isNotNull(), raw), n, none_d
    if kind == "date":
        day = X.parse_date(raw) if day is None else day
        return F.date_format(day, "yyyy-MM-dd"), none_n, day
    if kind == "email":
        return F.when(X.is_email(raw), F.lower(raw)), none_n, none_d
    if kind == "phone":
        digits = F.regexp_replace(raw, r"\D", "")
        return F.when(F.char_length(digits).between(7, 15), digits), none_n, none_d
    return F.when(F.trim(raw) != "", F.trim(raw)), none_n, none_d


def extract(df: DataFrame, doc_type: str = "general", wanted: list[str] | None = None) -> DataFrame:
    """(doc_id, ord, name, value, value_num, value_date, confidence, method) of ``df(doc_id, content)``.

    ``ord`` numbers the values of a rule; values that don't fit their kind are left out.
    Only the rules of the fields ``wanted`` are run, or all.
    """
    rules = [r for r in (*RULES.get(doc_type, ()), *RULES["common"]) if wanted is None or r.field in wanted]
    kinds = [k for k in CONFIDENCE if any(r.kind == k for r in rules)]
    found = F.array(*[F.struct(F.lit(i).alias("rule"), X.find_all(F.col("content"), f"(?im){r.pattern}", r.group).alias("raws")) for i, r in enumerate(rules)])
    flat = df.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.rule", F.posexplode("f.raws").alias("ord", "raw"))
    of_kind = lambda kind: F.col("rule").isin([i for i, r in enumerate(rules) if r.kind == kind])
    # Parsed once, for the value and for the date.
    flat = flat.withColumn("day", F.when(of_kind("date"), X.parse_date(F.col("raw"))) if "date" in kinds else F.lit(None).cast("date"))
    value = number = day = None
    for kind in kinds:
        t, n, x = typed(F.col("raw"), kind, F.col("day"))
        is_kind = of_kind(kind)
        value, number, day = (F.when(is_kind, c) if old is None else old.when(is_kind, c) for old, c in ((value, t), (number, n), (day, x)))
    by_rule = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("rule") + 1)
    return flat.select(
        "doc_id",
        "ord",
        by_rule(lambda r: r.field).alias("name"),
        value.alias("value"),
        number.alias("value_num"),
        day.alias("value_date"),
        by_rule(lambda r: round(CONFIDENCE[r.kind] + r.boost, 2)).alias("confidence"),
        F.lit("rule").alias("method"),
    ).where(F.col("value").isNotNull())


def deduped(fields: DataFrame) -> DataFrame:
    """One row for each document, name and value: the most confident; weak or blank ones go.
    Rows are gathered by document, which serves all that follows by document."""
    fields = fields.repartition("doc_id")
    order = Window.partitionBy("doc_id", "name", "value").orderBy(F.desc("confidence"), "ord")
    return fields.where((F.col("confidence") >= 0.3) & (F.trim("value") != "")).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def with_confidence(fields: DataFrame, doc_type: str) -> DataFrame:
    """Confidence by role: more for key fields, less for header and table fields, more for repeated names."""
    key, weak = F.col("name").isin(KEY_FIELDS.get(doc_type, [])), F.col("name").rlike("^(header_|table_)")
    c = F.when(key, F.least(F.col("confidence") + 0.1, F.lit(1.0))).otherwise(F.col("confidence"))
    c = F.when(weak, F.greatest(c - 0.1, F.lit(0.5))).otherwise(c)
    n = F.count("*").over(Window.partitionBy("doc_id", "name"))
    return fields.withColumn("confidence", F.round(F.when(n > 1, F.least(c + 0.05, F.lit(1.0))).otherwise(c), 4))


#: Fields of a header block, each with the group that has the value.
HEADER = {"title": (r"^([A-Z][A-Za-z\s]+)$", 1), "date": (r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})", 1), "reference": (r"(REF|Ref|Reference):\s*([A-Za-z0-9-]+)", 2)}


def header_fields(df: DataFrame) -> DataFrame:
    """(doc_id, name, value, confidence) of header texts ``df(doc_id, text)``; dates become ISO dates."""
    found = [F.struct(F.lit(f"header_{n}").alias("name"), F.trim(F.regexp_extract("text", p, g)).alias("value")) for n, (p, g) in HEADER.items()]
    flat = df.select("doc_id", F.explode(F.array(*found)).alias("f")).select("doc_id", "f.*").where("value <> ''")
    value = F.when(F.col("name") == "header_date", F.date_format(X.parse_date(F.col("value")), "yyyy-MM-dd")).otherwise(F.col("value"))
    return flat.select("doc_id", "name", value.alias("value"), F.lit(0.8).alias("confidence")).where("value is not null")


def table_fields(df: DataFrame) -> DataFrame:
    """(doc_id, row, name, value, value_num) of tab-separated tables: first line is the header."""
    lines = F.split("content", "\n")
    heads = F.split(F.element_at(lines, 1), "\t")
    rows = df.select("doc_id", heads.alias("heads"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("row", "line"))
    cells = rows.select("doc_id", "row", F.explode(F.arrays_zip(F.col("heads").alias("h"), F.split("line", "\t").alias("v"))).alias("c")).where(F.col("c.h").isNotNull() & (F.trim("c.v") != ""))
    name = F.concat(F.lit("table_"), F.regexp_replace(F.lower(F.trim("c.h")), r"\s+", "_"))
    return cells.select("doc_id", "row", name.alias("name"), F.trim("c.v").alias("value"), F.expr("try_cast(regexp_replace(c.v, '[,$ ]', '') AS double)").alias("value_num"))


def json_fields(df: DataFrame, column: str) -> DataFrame:
    """(key columns, name, value) of the first {...} in a text; nulls and blanks are left out."""
    body = F.regexp_extract(F.col(column), r"(?s)\{.*\}", 0)
    rest = [c for c in df.columns if c != column]
    flat = df.select(*rest, F.explode(F.from_json(body, "map<string,string>")).alias("name", "value"))
    return flat.where(F.col("value").isNotNull() & (F.trim("value") != ""))
