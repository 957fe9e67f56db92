"""Queries over a stored index: built from the documents, changed by batches, searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.operators import lexical
from sparrowdoc.plans.lexical import BENCH, BM25, FIXED, benchmark_questions, chunks, questions, ranked_sql
from sparrowdoc.plans.registry import register
from sparrowdoc.plans.vectors import knn_sql, queries, vectors
from sparrowdoc.sources.index import Index, new_path
from sparrowdoc.sources.tables import load


def stored(s: SparkSession, d: str) -> DataFrame:
    index = Index.create(s, new_path(s, "index"), chunks(s, d))
    return index.search(benchmark_questions(s, d), 5).withColumn("rank", F.col("rank").cast("long"))


register("index_search", stored, ranked_sql(BENCH, BM25, 5))


def changed(s: SparkSession, d: str) -> Index:
    """Two batches of documents, one of them changed afterwards, toxic documents deleted."""
    docs, english = load(s, d, "documents"), F.col("lang").eqNullSafe("en")
    index = Index.create(s, new_path(s, "index"), lexical.as_chunks(docs.where(english)))
    index.add(lexical.as_chunks(docs.where(~english)))
    index.upsert(lexical.as_chunks(docs.where(~english).withColumn("text", F.concat_ws(" ", "source", "text"))))
    index.delete(load(s, d, "labels").where("toxic = 1"))
    return index


_LEFT = "(SELECT doc_id, CASE WHEN coalesce(lang = 'en', FALSE) THEN text ELSE concat_ws(' ', source, text) END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"
register(
    "index_changes",
    lambda s, d: changed(s, d).search(questions(s)).withColumn("rank", F.col("rank").cast("long")),
    ranked_sql(FIXED, BM25, 10).replace("FROM documents)", f"FROM {_LEFT})"),
)
register(
    "index_history",
    lambda s, d: changed(s, d).history(),
    "SELECT * FROM (VALUES (0, 'create'), (1, 'add'), (2, 'upsert'), (3, 'delete')) AS h(batch, action)",
)


def filtered(s: SparkSession, d: str) -> DataFrame:
    """Nearest vectors among those of English documents, of an index with vectors."""
    held = vectors(s, d).select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_id"), "embedding")
    index = Index.create(s, new_path(s, "index"), chunks(s, d), held)
    return index.nearest(queries(s, d), 10, only=load(s, d, "documents").where("lang = 'en'")).withColumn("rank", F.col("rank").cast("long"))


register(
    "index_nearest",
    filtered,
    "SELECT query_id, vec_id AS doc_id, 0 AS chunk_id, score, rank FROM (" + knn_sql(10).replace("FROM embeddings q, embeddings v WHERE", "FROM embeddings q, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND") + ")",
)
