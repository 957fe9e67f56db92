"""Every query of the engine with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _ORACLES[name] = sql


def queries() -> dict[str, Query]:
    load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(_ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_all()
    return _QUERIES["bm25_topk"](spark, sf_dir)


def load_all() -> None:
    """Imports the plan modules; each registers its queries."""
    from sparrowdoc.plans import engine, evidence, extracts, hybrid, indexes, lexical, reasoning, streams, texts, vectors  # noqa: F401
