"""Column expressions that find and check values in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of fields.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
NUMBER = r"-?\d+\.?\d*"
AMOUNT = r"[₹$€£¥]\s*[\d,]+\.?\d*|\d+\.?\d*"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE = rf"\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|\d{{1,2}}\s+(?:{MONTHS})[a-z]*\s+\d{{2,4}}"
ENTITY = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
#: Date formats, in the order they are tried.
DATE_FORMATS = ("M/d/yyyy", "d/M/yyyy", "yyyy-M-d", "M-d-yyyy", "d-M-yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy")
#: Masks by kind of sensitive data.
MASKS = {
    "EMAIL": (EMAIL, "[EMAIL]"),
    "PHONE": (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"),
    "SSN": (r"\b\d{3}-?\d{2}-?\d{4}\b", "[SSN]"),
    "CREDIT_CARD": (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CREDIT_CARD]"),
    "GENERIC": (r"[\p{L}\p{N}_]+", "[REDACTED]"),
}
DANGEROUS = (r"<script[^>]*>.*?</script>", "javascript:", "vbscript:", r"on[A-Za-z0-9_]+\s*=", "data:.*base64", "<iframe[^>]*>", "<object[^>]*>", "<embed[^>]*>")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def numbers(c: Column) -> Column:
    return F.transform(find_all(c, NUMBER), lambda x: x.cast("double"))


def parse_date(c: Column) -> Column:
    """First of the formats that fits, else null."""
    return F.coalesce(*[F.try_to_date(c, f) for f in DATE_FORMATS])


def mask(c: Column, kind: str = "GENERIC") -> Column:
    """Masks one kind of sensitive data; an unknown kind leaves the text alone."""
    if kind not in MASKS:
        return c
    return F.regexp_replace(c, *map(F.lit, MASKS[kind]))


def is_email(c: Column) -> Column:
    return c.rlike(f"^{EMAIL}$")


def is_phone(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"\D", "")).between(7, 15)


def dangerous(c: Column) -> Column:
    out = F.lit(False)
    for p in DANGEROUS:
        out = out | c.rlike(f"(?is){p}")
    return out


def escape_html(c: Column) -> Column:
    """Tags taken out, then & < > " ' escaped, in this order."""
    out = F.regexp_replace(c, "<[^>]+>", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
