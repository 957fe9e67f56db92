"""Query expansion, multi-query retrieval, reranking and annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.operators import fusion, lexical

# Synonyms, question templates and reformulations.
SYNONYMS = {
    "invoice": ["bill", "receipt", "statement"],
    "total": ["sum", "amount", "cost"],
    "date": ["time", "when", "period"],
    "company": ["business", "organization", "firm"],
    "experience": ["background", "history", "expertise"],
    "skill": ["ability", "competency", "capability"],
}
TEMPLATES = {
    "what": "This document contains information about ",
    "how": "This document explains how to ",
    "when": "This document specifies when ",
    "where": "This document indicates where ",
    "why": "This document explains why ",
}
REFORMULATIONS = (
    ("total amount", "invoice total sum amount due"),
    ("due date", "payment due date deadline"),
    ("vendor", "supplier company business"),
    ("experience", "work experience employment history"),
    ("skills", "technical skills abilities competencies"),
    ("education", "degree university college education"),
    ("contract", "agreement legal document terms"),
    ("clause", "contract clause provision term"),
)


def synonyms(c: Column) -> Column:
    """The first three synonyms of the question's words, in order."""
    table = F.create_map(*[x for w, s in SYNONYMS.items() for x in (F.lit(w), F.array(*map(F.lit, s)))])
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w.isin(list(SYNONYMS)))
    return F.slice(F.flatten(F.transform(words, lambda w: table[w])), 1, 3)


def with_synonyms(c: Column) -> Column:
    s = synonyms(c)
    return F.when(F.size(s) > 0, F.concat(c, F.lit(" "), F.array_join(s, " ")))


def hypothetical(c: Column) -> Column:
    """A sentence that a fitting document might hold, for the five question words."""
    out = None
    for word, start in TEMPLATES.items():
        text = F.concat(F.lit(start), F.trim(F.replace(c, F.lit(word), F.lit(""))))
        cond = F.startswith(F.lower(c), F.lit(word))
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


def reformulated(c: Column) -> Column:
    """The question with domain terms spelled out; null if nothing changes."""
    out = c
    for old, new in REFORMULATIONS:
        out = F.regexp_replace(out, f"(?i){old}", new)
    return F.when(out != c, out)


def variants(queries: DataFrame) -> DataFrame:
    """(query_id, variant, question): the original and what expansion adds, one plan for all."""
    q = F.col("question")
    made = F.array(*[F.struct(F.lit(n).alias("variant"), t.alias("question")) for n, t in (("original", q), ("synonyms", with_synonyms(q)), ("hypothetical", hypothetical(q)), ("reformulated", reformulated(q)))])
    return queries.select("query_id", F.explode(F.filter(made, lambda v: v["question"].isNotNull())).alias("v")).select("query_id", "v.variant", "v.question")


def multiquery(hits: DataFrame, top_k: int, others: float, others_k: int) -> DataFrame:
    """Best hits over the variants of a query: ``hits(query_id, variant, doc_id, chunk_id, score, rank)``;
    other variants count ``others`` as much and give ``others_k`` hits."""
    own = F.col("variant") == "original"
    weighted = hits.where(own | (F.col("rank") <= others_k)).withColumns({"score": F.round(F.when(own, F.col("score")).otherwise(F.col("score") * others), 6), "ord": F.when(own, 0).otherwise(1)})
    best = weighted.groupBy(*fusion.KEY).agg(F.max("score").alias("score"))
    return lexical.rank(best, top_k)


def keyword_hits(chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """BM25 for every variant of every query, in one search."""
    v = variants(queries).withColumn("vid", F.struct("query_id", "variant"))
    found = lexical.search(chunks, v.select(F.col("vid").alias("query_id"), "question"), top_k)
    return found.select("query_id.query_id", "query_id.variant", "doc_id", "chunk_id", "score", "rank")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def rerank(hits: DataFrame) -> DataFrame:
    """Adds rerank_score, not rounded: the score raised by a fifth of the part of the question's words in the content."""
    q, c = word_set(F.col("question")), word_set(F.col("content"))
    part = F.size(F.array_intersect(q, c)) / F.greatest(F.size(q), F.lit(1))
    return hits.withColumn("rerank_score", F.col("score") * (1 + 0.2 * part))


def highlighted(content: Column, question: Column) -> Column:
    """Question words of over two characters marked with ``**``, whatever their case."""
    terms = F.filter(F.split(F.lower(question), r"\s+"), lambda t: F.char_length(t) > 2)
    return F.aggregate(terms, content, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit("(?i)\\Q"), t, F.lit("\\E")), F.concat(F.lit("**"), t, F.lit("**"))))


def signals(hits: DataFrame) -> DataFrame:
    """Adds term frequency, position and length signals of a hit and their product."""
    terms = F.filter(F.split(F.lower(F.col("question")), r"\s+"), lambda t: t != "")
    c = F.lower("content")
    n = F.greatest(F.size(F.filter(F.split(c, r"\s+"), lambda t: t != "")), F.lit(1))
    long = F.filter(terms, lambda t: F.char_length(t) > 2)
    count = lambda t: (F.char_length(c) - F.char_length(F.replace(c, t, F.lit("")))) / F.char_length(t) / n
    frequency = F.when(F.size(long) > 0, F.aggregate(long, F.lit(0.0), lambda s, t: s + count(t)) / F.size(long)).otherwise(0.0)
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(c, t)), lambda i: i > 0))
    position = F.when(first.isNull(), 0.0).otherwise(1 - (first - 1) / F.greatest(F.char_length(c), F.lit(1)))
    penalty = F.when(F.char_length("content") < 50, 0.8).when(F.char_length("content") > 1000, 0.9).otherwise(1.0)
    return hits.withColumns({"frequency": F.round(frequency, 6), "position": F.round(position, 6), "penalty": penalty}).withColumn("strength", F.round(F.col("frequency") * F.col("position") * F.col("penalty"), 6))


def first_of_each(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") == 1).drop("_n")
