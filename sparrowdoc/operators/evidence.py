"""Agreement and conflict across the documents of a group.

``docs(group_id, doc_id, content)``: a group is a set of documents read together,
such as the hits of a question. Everything is counted by (group, value), so a
group's documents never meet in one task as a whole; conflicts are the pairs of
documents that no shared value connects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.functions import fields as X

PATTERNS = {"number": X.AMOUNT, "date": f"(?i){X.DATE}", "entity": X.ENTITY}
# What looks like an identifier; case is ignored.
REFERENCES = (r"(?:INV|INVOICE)[#-]?\s*[A-Za-z0-9_-]+", r"(?:REF|REFERENCE)[#-]?\s*[A-Za-z0-9_-]+", r"(?:ID|NUMBER)[#-]?\s*[A-Za-z0-9_-]+", r"[A-Z]{2,}\d{3,}")

#: Values of a group whose pairs are counted by masks, and documents of a value that meet in one task.
HOT, LANE = 8, 1024


def values(docs: DataFrame, kind: str) -> DataFrame:
    """(group_id, doc_id, value), every occurrence."""
    return docs.select("group_id", "doc_id", F.explode(X.find_all(F.col("content"), PATTERNS[kind])).alias("value"))


def shared_entities(docs: DataFrame) -> DataFrame:
    """(group_id, value, n_docs, in_all): entities of more than one document."""
    n = docs.groupBy("group_id").agg(F.countDistinct("doc_id").alias("of"))
    counted = values(docs, "entity").groupBy("group_id", "value").agg(F.countDistinct("doc_id").alias("n_docs")).where("n_docs > 1")
    return counted.join(n, "group_id").select("group_id", "value", "n_docs", (F.col("n_docs") == F.col("of")).alias("in_all"))


def date_overlaps(docs: DataFrame) -> DataFrame:
    """(group_id, n_dates, n_repeated): distinct dates, and those seen more than once anywhere."""
    by_date = values(docs, "date").groupBy("group_id", "value").agg(F.count("*").alias("n"))
    return by_date.groupBy("group_id").agg(F.count("*").alias("n_dates"), F.count_if(F.col("n") > 1).alias("n_repeated"))


def numeric_patterns(docs: DataFrame) -> DataFrame:
    """(group_id, n, least, most, mean) of all numbers of a group, to four places.

    The mean is summed and rounded in decimals, so that neither the order of
    the rows nor a mean that ends in a five decides its last digit; numbers
    beyond 14 digits before the point are averaged as doubles.
    """
    x = F.expr(r"try_cast(regexp_replace(value, '[₹$€£¥,\\s]', '') AS double)")
    counted = values(docs, "number").withColumn("x", x).withColumn("d", F.expr("try_cast(x AS decimal(20, 6))")).groupBy("group_id")
    summed = counted.agg(F.count("x").alias("n"), F.count("d").alias("of"), F.expr("try_sum(d)").alias("d"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"))
    exact = F.when(F.col("of") == F.col("n"), F.expr("try_divide(d, try_cast(n AS decimal(10, 0)))"))
    mean = F.coalesce(F.round(exact, 4).cast("double"), F.round("mean", 4))
    return summed.select("group_id", "n", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"), mean.alias("mean"))


def references(docs: DataFrame) -> DataFrame:
    """(group_id, doc_id, ref), distinct, upper-cased."""
    found = F.flatten(F.array(*[X.find_all(F.col("content"), f"(?i){p}") for p in REFERENCES]))
    return docs.select("group_id", "doc_id", F.explode(F.array_distinct(F.transform(found, F.upper))).alias("ref"))


def _met(held: DataFrame, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(group_id, value, a, b, and of both each column of ``keep``), a < b: a group's documents that hold the same value.

    ``held(group_id, doc_id, value)`` has each of them once. A value of many
    documents is dealt to lanes of about ``LANE`` documents that all others visit.
    """
    n = held.groupBy("group_id", value).agg(F.count("*").alias("n")).where("n > 1")
    lanes = held.join(n, ["group_id", value]).withColumn("lanes", F.ceil(F.col("n") / LANE).cast("int")).drop("n")
    named = lambda side: [F.col(c).alias(f"{side}_{c}") for c in keep]
    a = lanes.select("group_id", value, F.pmod(F.xxhash64("doc_id"), F.col("lanes")).cast("int").alias("lane"), F.col("doc_id").alias("a"), *named("a"))
    b = lanes.select("group_id", value, F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.col("doc_id").alias("b"), *named("b"))
    return a.join(b, ["group_id", value, "lane"]).where("a < b").drop("lane")


def cross_references(docs: DataFrame) -> DataFrame:
    """(group_id, a, b, n_shared): pairs of a group's documents with identifiers in common."""
    return _met(references(docs).distinct(), "ref").groupBy("group_id", "a", "b").agg(F.count("*").alias("n_shared"))


def agreement(docs: DataFrame, kind: str) -> DataFrame:
    """(group_id, agreement): how often the most frequent value comes, by document."""
    top = values(docs, kind).groupBy("group_id", "value").agg(F.count("*").alias("n")).groupBy("group_id").agg(F.max("n").alias("top"))
    n = docs.groupBy("group_id").agg(F.countDistinct("doc_id").alias("of"))
    return n.join(top, "group_id", "left").select("group_id", "of", (F.coalesce("top", F.lit(0)) / F.col("of")).alias("agreement"))


def consensus(docs: DataFrame) -> DataFrame:
    """(group_id, score, level): mean of number and date agreement and the spread of entities."""
    spread = values(docs, "entity").groupBy("group_id").agg((F.countDistinct("value") / F.count("*")).alias("spread"))
    out = agreement(docs, "number").withColumnRenamed("agreement", "a").join(agreement(docs, "date").select("group_id", F.col("agreement").alias("b")), "group_id").join(spread, "group_id", "left")
    score = F.round((F.col("a") + F.col("b") + F.coalesce("spread", F.lit(0.0))) / 3, 6)
    return out.select("group_id", score.alias("score")).withColumn("level", F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low"))


def _sharing(held: DataFrame) -> DataFrame:
    """(group_id, s): how many pairs of a group's documents have a value in common, of distinct ``held(group_id, doc_id, value)``.

    A document gets a mask of which of its group's ``HOT`` most frequent values it
    holds; pairs that share one of these are counted by masks. Only pairs that
    share none of them, but another value, are found one by one.
    """
    often = Window.partitionBy("group_id").orderBy(F.desc("c"), "value")
    counted = held.groupBy("group_id", "value").agg(F.count("*").alias("c")).where("c > 1")
    hot = counted.withColumn("bit", F.row_number().over(often) - 1).where(F.col("bit") < HOT).select("group_id", "value", "bit")
    marked = held.join(hot, ["group_id", "value"], "left")
    masks = marked.groupBy("group_id", "doc_id").agg(F.coalesce(F.bit_or(F.expr("shiftleft(1, bit)")), F.lit(0)).alias("mask"))
    classes = masks.where("mask != 0").groupBy("group_id", "mask").agg(F.count("*").alias("n"))
    a, b = classes.select("group_id", F.col("mask").alias("ma"), F.col("n").alias("na")), classes.select("group_id", F.col("mask").alias("mb"), F.col("n").alias("nb"))
    by_mask = a.join(b, "group_id").where("ma <= mb and (ma & mb) != 0")  # a group has 2 ** HOT masks at most
    first = by_mask.select("group_id", F.expr("if(ma = mb, na * (na - 1) div 2, na * nb)").alias("s"))
    others = marked.where("bit is null").drop("bit").join(masks, ["group_id", "doc_id"])
    more = _met(others, "value", ("mask",)).where("(a_mask & b_mask) = 0").select("group_id", "a", "b").distinct().select("group_id", F.lit(1).cast("long").alias("s"))
    return first.unionByName(more).groupBy("group_id").agg(F.sum("s").alias("s"))


def conflicts(docs: DataFrame) -> DataFrame:
    """(group_id, n_docs, mismatched_pairs, date_conflict).

    Pairs without a number in common are all pairs of the documents that have
    numbers less those that share one, so no pair is written out that agrees
    on nothing.
    """
    nums = values(docs, "number").distinct()
    with_numbers = nums.groupBy("group_id").agg(F.countDistinct("doc_id").alias("n"))
    dates = values(docs, "date").groupBy("group_id").agg((F.countDistinct("value") > F.countDistinct("doc_id")).alias("date_conflict"))
    n = docs.groupBy("group_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    out = n.join(with_numbers, "group_id", "left").join(_sharing(nums), "group_id", "left").join(dates, "group_id", "left")
    pairs = F.coalesce((F.col("n") * (F.col("n") - 1) / 2).cast("long"), F.lit(0).cast("long")) - F.coalesce("s", F.lit(0))
    return out.select("group_id", "n_docs", pairs.alias("mismatched_pairs"), F.coalesce("date_conflict", F.lit(False)).alias("date_conflict"))


def document_evidence(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance, quality, n_chunks, length) of ``hits(query_id, doc_id, question, content, score)``."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    by = hits.groupBy("query_id", "doc_id").agg(F.first("question").alias("question"), F.concat_ws(" ", F.collect_list("content")).alias("content"), F.avg("score").alias("quality"), F.count("*").alias("n_chunks"))
    part = F.size(F.array_intersect(words("question"), words("content"))) / F.greatest(F.size(words("question")), F.lit(1))
    return by.select("query_id", "doc_id", F.round(part, 6).alias("relevance"), F.round("quality", 6).alias("quality"), "n_chunks", F.char_length("content").cast("long").alias("length"))


def synthesis_confidence(consensus_score, quality, n_docs, n_conflicts):
    """Consensus moved by quality, number of documents and conflicts, kept in 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), consensus_score + 0.2 * (quality - 0.5) + F.least(0.05 * n_docs, F.lit(0.15)) - 0.1 * n_conflicts))
