"""Corpus pipeline: from raw documents to packed sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's documents; all but the last return the
columns of documents, whichever these are. Rows of null text go through as
empty documents, rows that share a doc_id are one document to the two middle
stages, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.llm import line_dedup, ngram_join, packing, toxicity
from sparrowdoc.llm.common import documents, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the calibrated score calls toxic (0.5 or more)."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.withColumnRenamed("score", "_score"), model, [c if c != "score" else "_score" for c in docs.columns])
    return scored.where(F.col("score") < 0.5).drop("score").withColumnRenamed("_score", "score")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that five or more documents share out of all but the last of them."""
    others = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    kept = line_dedup.dedupe_lines(docs.withColumnsRenamed(others), carry=tuple(others.values()))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")} | {c: F.col(o) for c, o in others.items()}
    return kept.select(*(made[c].alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at 0.8 or more."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of at most 4096."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_shared_lines), ("ngram_join", drop_near_copies), ("packing", pack)]

#: The learned scores of the first stage are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
