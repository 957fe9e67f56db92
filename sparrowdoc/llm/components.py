"""Connected components of a table of links, by label passing with shortcuts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise

#: Links that one task joins at most (16 bytes each); more go through rounds of label passing.
ONE_TASK = 500_000


def _in_one_task(links: DataFrame) -> DataFrame:
    """Union-find over a counted, bounded number of links."""

    def work(batches):
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "label"])

    name = links.schema["a"].dataType.simpleString()
    kind = to_arrow_type(links.schema["a"].dataType)
    return links.repartition(1).mapInArrow(work, f"node {name}, label {name}")


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, label): each node of ``links(a, b)`` with the smallest node it is joined to.

    Few links (counted first) are joined by one task. Else, every round a node takes the smallest label around it, then the label of
    that label; rounds grow with the logarithm of a component's width. Each
    round is written to the shared folder, so lost executors cost one round.
    Nulls make no link; self-links and repeated links are harmless.
    """
    links = links.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    if links.count() <= one_task:
        return materialise(_in_one_task(links), "labels")
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = materialise(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("root", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where(F.col("was") != F.col("label")).limit(1).count():
            return labels
