"""Every query with an oracle gives the oracle's rows on the small tables."""

import math

import pandas as pd
import pytest

from sparrowdoc.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def shown(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return "0" if v == 0 else f"{v:.9g}"
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(shown(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf, con, name):
    ours = registry.queries()[name](spark, sf).toPandas()
    theirs = con.execute(ORACLES[name]).df()
    (a, x), (b, y) = rows(ours), rows(theirs)
    assert a == b
    assert len(x) == len(y)
    for p, q in zip(x, y, strict=True):
        assert p == q or all(u == v or _close(u, v) for u, v in zip(p, q, strict=True)), (p, q)


def _close(u, v):
    try:
        return math.isclose(float(u), float(v), rel_tol=1e-9, abs_tol=1e-9)
    except ValueError:
        return {u, v} <= {"null", "<NA>", "None", "NaT"}


def test_entry_is_registered(spark, sf):
    assert registry.entry(spark, sf).count() > 0
