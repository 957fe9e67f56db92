"""The driver's contract."""

import __spark_entry__


def test_names_agree():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120
    assert ("pipeline" in queries) == (__spark_entry__.corpus_pipeline is not None)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
