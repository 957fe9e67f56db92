"""Inverted index and lexical ranking.

``chunks(doc_id, chunk_id, content)`` in, ranked chunks out. Only postings of
query terms are grouped: the query side is joined to the exploded tokens before
the shuffle, so what moves is the matches and not the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.functions.text import STOP_WORDS, content_terms, inner_tokens, lowered, tokens

K1, B = 1.2, 0.75
KEY = ["doc_id", "chunk_id"]
#: Query terms that become a filter inside the scan at most.
PUSHED_TERMS = 10_000


def as_chunks(docs: DataFrame) -> DataFrame:
    """Whole documents as chunks of one."""
    return docs.select("doc_id", F.lit(0).alias("chunk_id"), F.col("text").alias("content"))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, doc_id, chunk_id, tf) without stop words."""
    return chunks.select(*KEY, F.explode(content_terms(F.col("content"))).alias("term")).groupBy("term", *KEY).agg(F.count("*").alias("tf"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select(*KEY, F.size(content_terms(F.col("content"))).cast("long").alias("dl"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, mean length, vocabulary."""
    terms = chunks.select(content_terms(F.col("content")).alias("terms"))
    # One pass: each chunk gives its terms, and a row of no term that carries its length.
    rows = terms.select(F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string")))).alias("term"), F.size("terms").alias("dl"))
    by_term = rows.groupBy("term").agg(F.count("*").alias("n"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("held"))
    none = F.col("term").isNull()
    return by_term.agg(F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)).alias("n_chunks"), F.sum(F.when(none, F.col("held") / F.col("n"))).alias("avgdl"), F.count("term").alias("vocabulary"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of ``queries(query_id, question)``."""
    return queries.select("query_id", F.explode(content_terms(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def matches(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the query terms with chunk length, document frequency and corpus numbers.

    Each chunk is tokenised once: it gives its hits, and one row of no term that
    carries its length, from which corpus numbers are summed; a null text counts
    as a chunk without a length, and chunks without an id or with the same one each count. Up to ``PUSHED_TERMS`` distinct query terms are
    pushed into the scan; more are joined to the exploded tokens.
    """
    wanted = terms.select("term").distinct()
    few = [r["term"] for r in wanted.limit(PUSHED_TERMS + 1).collect()]
    found = content_terms(F.col("content"))
    base = chunks.select(*KEY, found.alias("found")).select(*KEY, F.coalesce("found", F.array().cast("array<string>")).alias("terms"), F.when(F.col("found").isNotNull(), F.size("found")).alias("dl"))
    own = F.array(F.lit(None).cast("string"))
    if len(few) <= PUSHED_TERMS:
        kept = F.filter("terms", lambda t: t.isin(few)) if few else F.array().cast("array<string>")
        rows = base.select(*KEY, "dl", F.explode(F.concat(kept, own)).alias("term"))
    else:
        rows = base.select(*KEY, "dl", F.explode(F.concat("terms", own)).alias("term")).join(wanted.withColumn("asked", F.lit(True)), "term", "left").where("asked or term is null").drop("asked")
    counted = rows.groupBy("term", *KEY, "dl").agg(F.count("*").alias("tf"))
    lengths = counted.where("term is null").agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).alias("avgdl"))
    hits = counted.where("term is not null")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    return hits.join(df, "term").crossJoin(F.broadcast(lengths))  # one row


def bm25_weight(k1: float = K1, b: float = B) -> Column:
    """Term weight; the inverse frequency may be negative for terms in over half of the chunks."""
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def tfidf_weight() -> Column:
    return F.col("tf") / F.col("dl") * F.ln(F.col("n") / (F.col("df") + 1))


def rank(scored: DataFrame, top_k: int, by: str = "query_id") -> DataFrame:
    """The best ``top_k`` of each query, ties by id; adds ``rank`` from 1."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), *KEY)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def search(chunks: DataFrame, queries: DataFrame, top_k: int = 10, weight: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, chunk_id, score, rank) by BM25, or by another term weight.

    Scores are rounded to six places before ranking; only positive ones count.
    ``only(doc_id)`` filters documents after corpus numbers are taken.
    """
    terms = query_terms(queries)
    return ranked(matches(chunks, terms), terms, top_k, weight, only)


def ranked(hits: DataFrame, terms: DataFrame, top_k: int, weight: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """The result of :func:`search` from the hits of its terms, with document frequencies and corpus numbers."""
    if only is not None:
        hits = hits.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    value = bm25_weight() if weight is None else weight
    scored = hits.withColumn("w", value).join(terms, "term").groupBy("query_id", *KEY).agg(F.round(F.sum(F.col("w") * F.col("times")), 6).alias("score"))
    return rank(scored.where(F.col("score") > 0), top_k)


def having_all(chunks: DataFrame, required: list[str]) -> DataFrame:
    """Chunks that hold every term."""
    have = F.array_distinct(content_terms(F.col("content")))
    return chunks.where(F.size(F.array_intersect(have, F.array(*map(F.lit, required)))) == len(set(required)))


def having_none(chunks: DataFrame, excluded: list[str]) -> DataFrame:
    return chunks.where(~F.arrays_overlap(content_terms(F.col("content")), F.array(*map(F.lit, excluded))))


def _longest(terms: Column) -> Column:
    """The longest term, which stands in for the rarest; null if there is none."""
    return F.array_max(F.transform(terms, lambda t: F.named_struct(F.lit("n"), F.char_length(t), F.lit("t"), t)))["t"]


def phrase_search(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, doc_id, chunk_id) of ``phrases(query_id, phrase)`` that stand in a chunk, its ends perhaps within longer words.

    Chunks that hold the longest of the phrase's inner words are looked at. A phrase without
    one is looked for in those that hold one of its ``anchors``, if that column is given, else
    in all chunks. A phrase of stop words finds nothing.
    """
    inner = inner_tokens(F.col("phrase"))
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    best = [one(_longest(F.filter(inner, lambda t: ~t.isin(STOP_WORDS)))), one(_longest(inner)), F.array(F.lit(None).cast("string"))]
    if "anchors" in phrases.columns:
        best.insert(1, F.col("anchors"))
    wanted = phrases.where(F.size(content_terms(F.col("phrase"))) > 0).select("query_id", lowered(F.col("phrase")).alias("phrase"), F.explode(F.coalesce(*best)).alias("term"))
    few = [r["term"] for r in wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    terms = F.array_distinct(tokens(F.col("content")))
    if len(few) <= PUSHED_TERMS:
        known = [t for t in few if t is not None]
        terms = F.filter(terms, lambda t: t.isin(known)) if known else F.array().cast("array<string>")
    low = lowered(F.col("content")).alias("low")
    found = chunks.select(*KEY, low, F.explode(terms).alias("term")).join(wanted, "term").where(F.contains("low", "phrase")).select("query_id", *KEY)
    if len(few) <= PUSHED_TERMS and None not in few:
        return found
    everywhere = chunks.select(*KEY, low).join(wanted.where("term is null").select("query_id", "phrase"), F.contains("low", "phrase"))
    return found.unionByName(everywhere.select("query_id", *KEY))


def parse_queries(queries: DataFrame) -> DataFrame:
    """Phrases in quotes, the other terms, and which are required or excluded."""
    q = F.col("question")
    rest = F.regexp_replace(q, r'"[^"]+"', " ")
    before_not, after_not = F.split_part(rest, F.lit(" NOT "), F.lit(1)), F.regexp_extract(rest, r"(?s) NOT (.*)$", 1)
    has_and = q.contains(" AND ")
    has_not = ~has_and & q.contains(" NOT ")
    # The operators themselves are no terms.
    plain = lambda c: F.filter(content_terms(c), lambda t: ~t.isin("not", "and", "or"))
    return queries.select(
        "query_id",
        F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1)).alias("phrases"),
        F.when(has_not, plain(before_not)).otherwise(plain(rest)).alias("terms"),
        F.when(has_and, plain(rest)).otherwise(F.array().cast("array<string>")).alias("required"),
        F.when(has_not, plain(after_not)).otherwise(F.array().cast("array<string>")).alias("excluded"),
        has_and.alias("all_of"),
    )


def boolean_search(chunks: DataFrame, queries: DataFrame, top_k: int = 10, only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, chunk_id, score, rank): a question parsed, its candidates found and scored by BM25, in one plan.

    A chunk is a candidate if it holds a term, or a word of a phrase. With AND it must
    hold every term and every phrase as it stands, after NOT none of the terms there.
    Words of phrases are scored like other terms. ``only(doc_id)`` filters documents
    after corpus numbers are taken. Questions without terms find nothing, and a
    chunk without an id isn't found.
    """
    parsed = parse_queries(queries)
    in_role = lambda c, r: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(r).alias("role")))
    words = F.flatten(F.transform("phrases", content_terms))
    roles = parsed.select("query_id", F.explode(F.concat(in_role("terms", "scored"), in_role(words, "scored"), in_role(F.array_distinct("required"), "required"), in_role(F.array_distinct("excluded"), "excluded"))).alias("r"))
    terms = roles.groupBy("query_id", "r.term").agg(*[F.count_if(F.col("r.role") == r).alias(r) for r in ("scored", "required", "excluded")])
    hits = matches(chunks, terms)
    if only is not None:
        hits = hits.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    found = hits.withColumn("w", bm25_weight()).join(terms, "term").groupBy("query_id", *KEY).agg(
        F.round(F.sum(F.col("w") * F.col("scored")), 6).alias("score"), F.sum("required").alias("has"), F.sum("excluded").alias("bad")
    )
    must = parsed.select("query_id", F.size(F.array_distinct("required")).alias("wants"), F.when(F.col("all_of"), F.size(F.array_distinct("phrases"))).otherwise(0).alias("needs"))
    # What is found holds every required term, and a scored one.
    anchors = F.when(F.size("required") > 0, F.array(_longest(F.col("required")))).otherwise(F.array_distinct(F.concat("terms", words)))
    phrases = parsed.where("all_of").select("query_id", anchors.alias("anchors"), F.explode(F.array_distinct("phrases")).alias("phrase")).select(F.struct("query_id", "phrase").alias("query_id"), "phrase", "anchors")
    held = phrase_search(chunks, phrases).distinct().groupBy("query_id.query_id", *KEY).agg(F.count("*").alias("held"))
    good = found.dropna(subset=KEY).join(must, "query_id").join(held, ["query_id", *KEY], "left").where((F.col("score") > 0) & (F.col("has") == F.col("wants")) & (F.col("bad") == 0) & (F.coalesce("held", F.lit(0)) == F.col("needs")))
    return rank(good.select("query_id", *KEY, "score"), top_k)


def header_boost(hits: DataFrame, chunks: DataFrame, factor: int = 2) -> DataFrame:
    """``hits`` of :func:`search` with the score of title and header chunks of ``chunks(doc_id, chunk_id, kind)`` times ``factor``, ranked anew."""
    boosted = hits.drop("rank").join(chunks.select(*KEY, "kind"), KEY, "left")
    score = F.when(F.col("kind").isin("title", "header"), F.col("score") * factor).otherwise(F.col("score"))
    return rank(boosted.withColumn("score", score).drop("kind"), 1 << 30)


def suggestions(chunks: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    """The most frequent terms that go on from ``prefix``."""
    terms = chunks.select(*KEY, F.explode(F.array_distinct(content_terms(F.col("content")))).alias("term"))
    found = terms.where(F.startswith("term", F.lit(prefix)) & (F.char_length("term") > len(prefix)))
    return found.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(n)


__all__ = ["as_chunks", "postings", "search", "tokens"]
