"""Helpers shared by the training-data operators: scratch tables and batch plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text a Python worker handles at a time.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and all runs in one process (``local[...]``) a
    temporary folder is made and registered, so that checkpoints and tables
    land in one place; on a cluster an unset folder is an error.
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
    return f"{shared_dir(spark)}/sparrowdoc/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here.

    Unlike a local checkpoint the copy survives a lost executor. ``compression``
    is a codec's name, for zstd with its level if need be (``zstd:9``).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    codec, _, level = compression.partition(":")
    df.write.options(**{"compression": codec, "parquet.compression.codec.zstd.level": level or "3"}).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`materialise` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that operators left in the shared folder; for a session's end,
    when no result that reads them is wanted any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sparrowdoc")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice hold about ``limit`` bytes.

    A single longer text makes a slice of its own; no text is cut.
    """
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings; null is the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def one_thread() -> None:
    """Keeps native libraries in a worker to the one core Spark gave it.

    The workers hold large memos of plain strings and make no reference
    cycles, so the cycle collector runs seldom.
    """
    gc.set_threshold(200_000, 50, 1000)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def default_tokenizer() -> str:
    """Path of the word-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def release() -> None:
    """Gives memory that a worker has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Runs what is executed inside with Arrow batches of at most ``rows`` rows, so that
    long texts make no huge batch; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if not 0 < int(was) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)
