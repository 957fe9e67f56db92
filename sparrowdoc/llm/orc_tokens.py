"""Token ids as ORC: written in ascending document order, read back by stripe.

Rows are range-partitioned by doc_id before they are encoded, so what moves is
text (which compresses) and not ids. Each range becomes one file; inside it
ORC keeps the ids run-length encoded, an index entry for every ``row_stride``
rows and Bloom filters on doc_id, so a lookup of a document reads only the
stripes that can hold it, and stripes are read in parallel.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import default_tokenizer, new_path, slices
from .encoding import SLICE, encoder

#: ORC writer settings: stripe of 64 MB, an index entry for 1000 rows.
STRIPE_BYTES = 64 << 20
ROW_STRIDE = 1000
#: Input bytes of a range, and so of a file; plans give sizes beyond ``UNKNOWN`` where they know none.
SHARD_BYTES = 128 << 20
UNKNOWN = 1 << 60


def encode(df: DataFrame, end_id: int, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, shard, ordinal, ids array<int>): each text's ids with ``end_id`` appended;
    ``ordinal`` is the row's place in its shard, which is one partition."""
    path = tokenizer or default_tokenizer()

    def work(batches):
        import numpy as np

        enc = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        at = 0
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                raw = [r + end for r in enc.encode(b.column("text")).to_pylist()]
                sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                place = pa.array(np.arange(at, at + len(raw)))
                at += len(raw)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("shard"), place, ids], names=["doc_id", "shard", "ordinal", "ids"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "shard", "text").mapInArrow(work, f"doc_id {kind}, shard int, ordinal long, ids array<int>")


def planned_shards(df: DataFrame) -> int:
    """Ranges that ``df`` is cut into: by its size as the plan estimates it (files:
    their bytes), or by the counted bytes of its texts where the plan can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > UNKNOWN:
        size = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def write_orc(df: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, shards: int | None = None) -> None:
    """Encodes ``df(doc_id, text)`` and writes ORC files of ascending doc_id.

    ``shard`` numbers the ranges: ids of a lower shard come before all of a
    higher one; ``ordinal`` is the row's place in its range. Rows with equal
    doc_id are ordered by text; a null doc_id comes first; a null text is empty
    and so is just ``end_id``. An empty table writes no rows. Columns other than
    doc_id and text are not read.
    """
    rows = df.select("doc_id", "text")
    # By doc_id alone: the driver samples the keys, and they must stay small.
    ranged = rows.repartitionByRange(shards or planned_shards(rows), "doc_id")
    # The shard is taken right after the exchange, so it names the range.
    ranged = ranged.withColumn("shard", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")
    (
        encode(ranged, end_id, tokenizer)
        .write.option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(ROW_STRIDE))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The written ids: (doc_id, shard, ordinal, ids). Filters on doc_id reach the stripes."""
    return spark.read.schema(f"doc_id {id_type}, shard int, ordinal long, ids array<int>").orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int], id_type: str = "bigint") -> DataFrame:
    """Ids of some documents; Bloom filters and row indexes skip the other stripes."""
    return read_orc(spark, path, id_type).where(F.col("doc_id").isin(doc_ids))


def catalogue(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of files read back with :func:`read_orc`.

    ``start`` counts the ids of all documents stored before: a running sum over the
    rows' places in the shard plus the sum of the lower shards (one row for each shard, not document).
    """

    def work(batches):
        for b in batches:
            ids = b.column("ids")
            raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = ids.offsets.to_numpy()
            view = memoryview(raw).cast("B")
            crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("shard"), b.column("ordinal"), pa.array(at[1:] - at[:-1], pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "ordinal", "n_tokens", "ids_crc32"],
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = stored.mapInArrow(work, f"doc_id {kind}, shard int, ordinal long, n_tokens long, ids_crc32 long")
    totals = stored.groupBy("shard").agg(F.sum(F.size("ids").cast("long")).alias("held"))
    below = totals.select("shard", F.coalesce(F.sum("held").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inside = Window.partitionBy("shard").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(below, "shard")
        .select("doc_id", (F.col("before") + F.col("below")).alias("start"), "n_tokens", "ids_crc32")
    )


def store_and_catalogue(df: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Writes ``df`` as ORC into the shared folder, reads it back, and lists its documents."""
    spark = df.sparkSession
    path = new_path(spark, "token-orc")
    write_orc(df, path, end_id, tokenizer)
    return catalogue(read_orc(spark, path, df.schema["doc_id"].dataType.simpleString()))
