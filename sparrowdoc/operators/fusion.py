"""Fusion of a semantic and a lexical ranking, all queries in one plan.

Both lists are (query_id, doc_id, chunk_id, score[, length]). A query for which
one list is empty keeps the other list's raw scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEMANTIC, KEYWORD, RRF_K = 0.6, 0.4, 60
KEY = ["query_id", "doc_id", "chunk_id"]


def _ranked(df: DataFrame, tag: str) -> DataFrame:
    by = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(by), F.max("score").over(by)
    return df.select(
        *KEY,
        F.col("score").alias(f"{tag}_score"),
        F.row_number().over(by.orderBy(F.desc("score"), "doc_id", "chunk_id")).alias(f"{tag}_rank"),
        F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0).alias(f"{tag}_unit"),
        F.count("*").over(by).alias(f"{tag}_n"),
    )


def minmax(scores: DataFrame) -> DataFrame:
    """Adds ``unit``: scores of a query scaled to 0..1, all 1 if they are equal."""
    return _ranked(scores, "s").select(*KEY, F.col("s_score").alias("score"), F.col("s_unit").alias("unit"))


def quality(df: DataFrame) -> DataFrame:
    """(query_id, quality): mean of score spread, text length and list length, each at most 1."""
    spread = F.when(F.count("*") == 1, 0.5).otherwise(F.least(F.var_pop("score"), F.lit(1.0)))
    return df.groupBy("query_id").agg(((spread + F.least(F.avg("length") / 500, F.lit(1.0)) + F.least(F.count("*") / 10, F.lit(1.0))) / 3).alias("quality"))


def _part(tag: str, value: Column, weight: Column) -> Column:
    return F.when(F.col(f"{tag}_rank").isNull(), 0.0).otherwise(value * weight)


def fuse(semantic: DataFrame, keyword: DataFrame, method: str = "rrf", ws: float = SEMANTIC, wk: float = KEYWORD, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, chunk_id, score) by rrf, weighted, borda, combsum or adaptive.

    Any other name is rrf. Scores are rounded to six places.
    """
    both = _ranked(semantic, "s").join(_ranked(keyword, "k"), KEY, "full_outer")
    by = Window.partitionBy("query_id")
    both = both.withColumns({f"{t}_n": F.coalesce(F.max(f"{t}_n").over(by), F.lit(0)) for t in "sk"})
    s, w = F.lit(ws), F.lit(wk)
    if method == "adaptive":
        q = quality(semantic).withColumnRenamed("quality", "qs").join(quality(keyword).withColumnRenamed("quality", "qk"), "query_id", "full_outer")
        both = both.join(q, "query_id", "left")
        qs, qk = F.coalesce("qs", F.lit(0.0)), F.coalesce("qk", F.lit(0.0))
        total = F.when(qs + qk > 0, qs + qk).otherwise(1.0)
        s, w = F.when(qs + qk > 0, 2 * qs / total).otherwise(ws), F.when(qs + qk > 0, 2 * qk / total).otherwise(wk)
    values = {
        "weighted": (F.col("s_unit"), F.col("k_unit")),
        "combsum": (F.col("s_unit"), F.col("k_unit")),
        "borda": (F.col("s_n") - F.col("s_rank") + 1, F.col("k_n") - F.col("k_rank") + 1),
    }
    a, b = values.get(method, (1.0 / (k + F.col("s_rank")), 1.0 / (k + F.col("k_rank"))))
    fused = _part("s", a, s) + _part("k", b, w)
    score = F.when(F.col("k_n") == 0, F.col("s_score")).when(F.col("s_n") == 0, F.col("k_score")).otherwise(fused)
    return both.select(*KEY, F.round(score, 6).alias("score"))


def best_of(hits: DataFrame) -> DataFrame:
    """One row for each (query, document, chunk): the best score, the earliest of equals."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "ord")
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")
