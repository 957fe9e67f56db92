"""Pluggable edges: embedding and language models, which Spark can't express.

The defaults are offline and deterministic. A real model is a function over
batches of strings; it runs in ``mapInPandas``, so a batch makes one call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdoc.operators.vector import hash_embedding


def embed(df: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None, dims: int = 16) -> DataFrame:
    """Adds ``embedding``: the model's, or the hash stand-in. Null text stays without one."""
    if model is None:
        return df.withColumn("embedding", F.when(F.col("text").isNotNull(), hash_embedding(F.col("text"), dims)))

    def work(frames):
        for pdf in frames:
            has = pdf["text"].notna()
            out = [None] * len(pdf)
            found = iter(model(pdf.loc[has, "text"].tolist()))
            pdf["embedding"] = [next(found) if h else x for h, x in zip(has, out, strict=True)]
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(work, f"{kinds}, embedding array<double>")


def missing_embeddings(df: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The distinct texts that ``cache(key, model)`` has no embedding of: (key, text)."""
    keyed = df.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.where(F.col("model") == model).select("key"), "key", "left_anti")


def prompt(question, contexts) -> F.Column:
    """The text a model is asked with: the question and its numbered contexts."""
    numbered = F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(c, 1, 500)))
    return F.concat(F.lit("Question: "), question, F.lit("\nContext:\n"), F.array_join(numbered, "\n"))


def answer(df: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds ``reply`` of the model to ``df(prompt, ...)``; a batch that raises gives null replies."""

    def work(frames):
        for pdf in frames:
            try:
                pdf["reply"] = model(pdf["prompt"].tolist())
            except Exception:  # noqa: BLE001  an edge may raise anything; its rows stay without a reply
                pdf["reply"] = None
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(work, f"{kinds}, reply string")
