"""Input tables and file sources.

Text files, Parquet tables and binary files come in through Spark's readers;
formats that need an imaging library or a network service (PDF, DOCX, OCR) are
edges: a function of (path, bytes) that the caller plugs into ``read_binary``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File suffixes by kind.
KINDS = {"pdf": ["pdf"], "docx": ["docx", "doc"], "text": ["txt", "md"], "image": ["png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif"]}

#: Largest uploads in MB by suffix; images share one limit.
LIMITS = {"pdf": 100, "docx": 50, "doc": 50, "txt": 10} | dict.fromkeys(["png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif"], 20)


def upload_problem(name: Column, size: Column) -> Column:
    """Null for a file that may be taken in, else what is wrong: its suffix, no content, or its size."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    most = F.element_at(F.create_map(*[F.lit(x) for k, mb in LIMITS.items() for x in (k, mb << 20)]), suffix)
    return F.when(most.isNull(), "type").when(size <= 0, "empty").when(size > most, "size")


def clean_metadata(m: Column, lists: bool = False) -> Column:
    """Metadata with tags taken out, keys cut at 100 and values at 1000 characters; with ``lists`` values are arrays and keep ten items.

    Of keys that are equal after the cut the last one counts.
    """
    cut = lambda c, n: F.substring(F.regexp_replace(c, "<[^>]+>", ""), 1, n)
    value = lambda v: F.transform(F.slice(v, 1, 10), lambda x: cut(x, 1000)) if lists else cut(v, 1000)
    entries = F.transform(F.map_entries(m), lambda e: F.struct(cut(e["key"], 100).alias("key"), value(e["value"]).alias("value")))
    # The place of a key's last entry, from 0, is what its entry must have.
    last = lambda e: F.array_max(F.transform(entries, lambda o, i: F.when(o["key"] == e["key"], i)))
    return F.map_from_entries(F.filter(entries, lambda e, i: last(e) == i))


DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the engine's Parquet tables; naive timestamps become instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """Whole text files as documents: id ``doc_<stem>``, the file name as title."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return raw.select(
        F.concat(F.lit("doc_"), stem).alias("doc_id"),
        name.alias("title"),
        F.col("value").alias("content"),
        F.col("_metadata.file_path").alias("source"),
        F.lit("general").alias("doc_type"),
        F.col("_metadata.file_modification_time").alias("created_at"),
        F.create_map(F.lit("size"), F.col("_metadata.file_size").cast("string")).alias("metadata"),
    )


def from_texts(spark: SparkSession, texts: list[str], prefix: str = "text") -> DataFrame:
    """Documents from strings: ids ``text_1``, ``text_2``, …"""
    rows = [(f"{prefix}_{i}", f"{prefix} {i}", t, "inline", "general", None, {}) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, DOCUMENT)


def read_binary(spark: SparkSession, path: str, extract: Callable[[str, bytes], tuple[str, float]], pattern: str = "*") -> DataFrame:
    """Files through an extraction edge: (doc_id, content, confidence, error).

    A file whose extraction raises becomes an error row; the batch goes on.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def work(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    text, confidence = extract(p, bytes(data))
                    rows.append((p, text, float(confidence), None))
                except Exception as e:  # noqa: BLE001  an edge may raise anything; the row says what
                    rows.append((p, None, 0.0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "confidence", "error"])

    return raw.mapInPandas(work, "doc_id string, content string, confidence double, error string")


def without_documents(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose doc_id is not in ``gone``: deletion from any index table."""
    return df.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
