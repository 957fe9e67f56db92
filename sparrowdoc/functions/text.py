"""Column expressions on text: cleaning, line types, helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the lexical index, English and of the domain.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with this these they them their there where when what who how why "
    "document page file content text data information details item section part"
).split()

#: Markers of code in answer text.
CODE_MARKS = ["import ", "from ", "def ", "class ", "if __name__", "print(", "return ", "=", "{", "}", ";", "//"]


def clean(c: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ocr_clean(c: Column) -> Column:
    """Cleaning for recognised text: drops odd characters, mends lone l and 0,
    thousands commas and hyphens at line breaks. The order of steps matters."""
    out = F.regexp_replace(clean(c), r"[^\p{L}\p{N}_\s.,;:!?\-()\[\]{}\"'/$%&*+=<>]", " ")
    for pattern, new in ((r"\bl\b", "I"), (r"\b0\b", "O"), (r"(?<=\d),(?=\d{3}(?:\D|$))", ""), (r"(?<=[\p{L}\p{N}_])- (?=[\p{L}\p{N}_])", "")):
        out = F.regexp_replace(out, pattern, new)
    return clean(out)


def lowered(c: Column) -> Column:
    """Lower case, each letter by itself: a capital sigma at a word's end is one like any other, a dotted capital i an i.

    So a part of a text is lowered as it is within the text.
    """
    return F.lower(F.replace(F.replace(c, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def _words(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(lowered(c), r"[^\p{L}\p{N}_\s.\-]", " "), r"\s+", " ")), " ")


def _kept(words: Column) -> Column:
    return F.filter(words, lambda t: (F.char_length(t) >= 2) | t.rlike(r"^\p{N}+$"))


def tokens(c: Column) -> Column:
    """Index tokens: lower case, words with inner dots and hyphens, of two characters
    or all digits; a hyphenated word of over three also gives its parts."""
    kept = _kept(_words(c))
    # Most texts have no hyphen and skip the nested arrays.
    return F.when(~F.contains(c, F.lit("-")), kept).otherwise(_with_parts(kept))


def _with_parts(kept: Column) -> Column:
    return F.flatten(F.transform(kept, lambda t: F.when(t.contains("-") & (F.char_length(t) > 3), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))))


def inner_tokens(c: Column) -> Column:
    """Tokens of every text that holds this one anywhere: its words, but for those at its
    ends, which there may be parts of longer words."""
    words = _words(F.concat(F.lit("x"), c, F.lit("x")))
    return _kept(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))


def content_terms(c: Column) -> Column:
    """Tokens that are no stop words."""
    return F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS))


def line_type(c: Column, doc_type: str = "general") -> Column:
    """header, list, table, a typed field, or paragraph."""
    line = F.trim(c)
    out = (
        F.when(line.rlike(r"^[A-Z\s]+$") & (F.char_length(line) < 100), "header")
        .when(line.rlike(r"^\s*[•\-*\d+.]\s+"), "list")
        .when(line.contains("\t") | line.rlike(r"\s{3,}"), "table")
    )
    if doc_type == "invoice":
        out = out.when(F.lower(line).rlike("invoice|bill|amount|total|due"), "invoice_field")
    elif doc_type == "resume":
        out = out.when(F.lower(line).rlike("experience|education|skills|work"), "resume_section")
    return out.otherwise("paragraph")


# What makes a section important, by document type.
IMPORTANT = {
    "invoice": ["total", "amount", "due", "invoice", "payment", "tax"],
    "resume": ["experience", "education", "skills", "work", "university"],
    "legal_contract": ["agreement", "party", "terms", "condition", "clause"],
    "general": ["important", "summary", "conclusion", "key", "main"],
}
BOOSTS = {
    "invoice": ("total|amount|due|tax|subtotal", 0.3),
    "resume": ("experience|education|skills|summary", 0.3),
    "legal_contract": ("clause|term|condition|agreement|party", 0.2),
    "medical_record": ("diagnosis|treatment|medication|patient|doctor", 0.3),
    "purchase_order": ("order|quantity|price|item|delivery", 0.3),
}


def importance(c: Column, doc_type: str = "general") -> Column:
    """Half, a fifth more for length, a tenth for each keyword up to three, then the type's boost."""
    low = F.lower(c)
    found = sum((F.when(low.contains(k), 1).otherwise(0) for k in IMPORTANT.get(doc_type, IMPORTANT["general"])), F.lit(0))
    score = F.least(F.lit(1.0), 0.5 + F.when(F.char_length(low) > 100, 0.2).otherwise(0.0) + F.least(F.lit(0.3), found * 0.1))
    if doc_type in BOOSTS:
        pattern, boost = BOOSTS[doc_type]
        score = F.least(F.lit(1.0), score + F.when(low.rlike(pattern), boost).otherwise(0.0))
    return score


def answer_text(c: Column) -> Column:
    """Text fit for an answer: no code spans or line markers; "" if it looks like code."""
    out = F.regexp_replace(c, r"```[\s\S]*?```", "")
    out = F.regexp_replace(out, "`[^`]+`", "")
    out = clean(F.regexp_replace(out, r"(?m)^\s*[#-]\s*", ""))
    codelike = F.lit(False)
    for mark in CODE_MARKS:
        codelike = codelike | F.lower(out).contains(mark)
    return F.when(codelike, "").otherwise(out)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r'[<>:"/\\|?*]', "_")


def format_bytes(n: Column) -> Column:
    """1.0 KB and so on, one decimal."""
    out = None
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.concat(F.round(n / float(1024**i), 1).cast("string"), F.lit(f" {unit}"))
        cond = n < 1024 ** (i + 1)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(F.concat(F.round(n / float(1024**5), 1).cast("string"), F.lit(" PB")))


def extension_kind(c: Column) -> Column:
    """Kind of a file by its suffix."""
    ext = F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("docx", "doc"), "docx").when(ext.isin("txt", "md"), "text").when(ext.isin("png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif"), "image").otherwise("unknown")


def alnum_ratio(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / F.greatest(F.char_length(c), F.lit(1))


def passes_quality(c: Column, confidence: Column, least: float = 0.6) -> Column:
    """Ten characters or more, enough confidence, half of them letters or digits."""
    return (F.char_length(F.trim(c)) >= 10) & (confidence >= least) & (alnum_ratio(c) >= 0.5)
