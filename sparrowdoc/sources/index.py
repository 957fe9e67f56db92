"""A search index kept as tables that grow by batches: chunks, postings and vectors.

``<path>/<table>/batch=<n>`` holds what batch n added, ``<path>/gone/batch=<n>``
the documents whose earlier rows it ended, and ``<path>/log/batch=<n>``, written
last, that it is whole. What a failed batch left is not read, and the next batch
writes over it. There is one writer at a time.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.functions.text import content_terms
from sparrowdoc.operators import lexical, vector

KEY = lexical.KEY


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and all runs in one process (``local[...]``) a
    temporary folder is made and registered; on a cluster an unset folder is an
    error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparrowdoc-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "sparrowdoc", f"{name}-{uuid.uuid4().hex}")


class Index:
    """Search over stored tables: ``Index.create(spark, path, chunks, vectors)`` or ``Index(spark, path)``.

    ``chunks(doc_id, chunk_id, content)`` and ``vectors(doc_id, chunk_id,
    embedding)`` have ids of any one type that sorts; other columns are left out.
    Null content is a chunk without terms. Chunks of a null doc_id are searched,
    but no deletion finds them. Without vectors, ``nearest`` finds nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, chunks: DataFrame, vectors: DataFrame | None = None) -> Index:
        """A new index; an old one at ``path`` is an error."""
        new = cls(spark, path)
        log = spark._jvm.org.apache.hadoop.fs.Path(f"{new.path}/log")
        if log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
            raise ValueError(f"there is an index at {path}")
        new._write(0, "create", chunks, vectors if vectors is not None else chunks.limit(0).select(*KEY, F.lit(None).cast("array<double>").alias("embedding")), chunks.limit(0))
        return new

    def add(self, chunks: DataFrame, vectors: DataFrame | None = None) -> None:
        """Appends chunks of documents that the index does not hold."""
        self._write(self._next(), "add", chunks, vectors, None)

    def upsert(self, chunks: DataFrame, vectors: DataFrame | None = None) -> None:
        """Appends chunks; what the index held of their documents, vectors as well, ends."""
        self._write(self._next(), "upsert", chunks, vectors, chunks)

    def delete(self, docs: DataFrame) -> None:
        """Ends the documents of ``docs(doc_id)``; unknown ones are let be."""
        self._write(self._next(), "delete", None, None, docs)

    def compact(self, path: str) -> Index:
        """A new index of the live rows, in one batch."""
        return Index.create(self.spark, path, self.read("chunks"), self.read("vectors"))

    def history(self) -> DataFrame:
        """(batch, action) of the batches that are whole."""
        return self.spark.read.parquet(f"{self.path}/log").select(F.col("batch").cast("int").alias("batch"), "action")

    def read(self, table: str) -> DataFrame:
        """The live rows of ``chunks``, ``postings`` or ``vectors``."""
        return self._live(table).drop("batch")

    def stats(self) -> DataFrame:
        """One row: documents, chunks, mean length, vectors and batches."""
        c = self.read("chunks").agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))
        return c.crossJoin(self.read("vectors").agg(F.count("embedding").alias("n_vectors"))).crossJoin(self.history().agg(F.count("*").alias("n_batches")))  # one row each

    def search(self, queries: DataFrame, top_k: int = 10, only: DataFrame | None = None, weight=None) -> DataFrame:
        """(query_id, doc_id, chunk_id, score, rank) like :func:`lexical.search`, from stored postings: no text is read.

        Up to ``lexical.PUSHED_TERMS`` terms go into the scan, where files are sorted by
        term and have Bloom filters; more are joined.
        """
        terms = lexical.query_terms(queries)
        few = [r["term"] for r in terms.select("term").distinct().limit(lexical.PUSHED_TERMS + 1).collect()]
        found = self._live("postings", F.col("term").isin(few) if len(few) <= lexical.PUSHED_TERMS else None)
        hits = found.join(terms.select("term").distinct(), "term", "left_semi").drop("batch")
        sizes = self.read("chunks").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        return lexical.ranked(hits.join(df, "term").crossJoin(F.broadcast(sizes)), terms, top_k, weight, only)  # one row

    def nearest(self, queries: DataFrame, top_k: int = 10, threshold: float = 0.0, only: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, chunk_id, score, rank) of :func:`vector.knn` over the vectors, of documents in ``only(doc_id)`` if given. Equal scores go by the ids as text."""
        held = self.read("vectors")
        if only is not None:
            held = held.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
        kinds = {c: held.schema[c].dataType for c in KEY}
        # Whole numbers are padded, so that their text sorts like them.
        text = [F.lpad(F.col(c).cast("string"), 20, "0") if t.typeName() in ("long", "integer", "short", "byte") else F.col(c) for c, t in kinds.items()]
        found = vector.knn(held.select(F.concat_ws("#", *text).alias("vec_id"), "embedding"), queries, top_k, threshold)
        at = F.regexp_extract("vec_id", r"(?s)^(.*)#([^#]*)$", 1), F.regexp_extract("vec_id", r"(?s)^(.*)#([^#]*)$", 2)
        return found.select("query_id", *[x.cast(t).alias(c) for x, (c, t) in zip(at, kinds.items(), strict=True)], "score", "rank")

    # ---- tables ------------------------------------------------------------------

    def _next(self) -> int:
        return self.history().agg(F.max("batch")).first()[0] + 1

    def _write(self, batch: int, action: str, chunks: DataFrame | None, vectors: DataFrame | None, gone: DataFrame | None) -> None:
        def put(table: str, df: DataFrame) -> None:
            df.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.path}/{table}/batch={batch}")

        if chunks is not None:
            terms = F.coalesce(content_terms(F.col("content")), F.array().cast("array<string>"))
            put("chunks", chunks.select(*KEY, "content", F.size(terms).cast("long").alias("dl")))
            counted = chunks.select(*KEY, terms.alias("terms")).select(*KEY, F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term")).groupBy("term", *KEY, "dl").agg(F.count("*").alias("tf"))
            # By term and chunk, so that a term of many chunks is not one task's.
            put("postings", counted.repartitionByRange("term", *KEY).sortWithinPartitions("term", *KEY))
        if vectors is not None:
            put("vectors", vectors.select(*KEY, F.col("embedding").cast("array<double>").alias("embedding")))
        if gone is not None:
            put("gone", gone.select("doc_id").distinct())
        put("log", self.spark.range(1).select(F.lit(action).alias("action")))

    def _live(self, table: str, where=None) -> DataFrame:
        """The rows of whole batches that no later batch ended, with their ``batch``."""
        done = {r["batch"]: r["action"] for r in self.history().collect()}  # a row a batch
        df = self.spark.read.parquet(f"{self.path}/{table}").where(F.col("batch").isin(list(done)))
        df = df if where is None else df.where(where)
        ends = [b for b, action in done.items() if action in ("upsert", "delete")]
        if not ends:
            return df
        last = self.spark.read.parquet(f"{self.path}/gone").where(F.col("batch").isin(ends)).groupBy("doc_id").agg(F.max("batch").alias("last"))
        return df.join(last, "doc_id", "left").where("last is null or batch >= last").drop("last")
