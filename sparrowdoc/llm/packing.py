"""Best-fit packing of token pieces: hierarchical residual packing.

Every round packs items by best fit, the longest first, inside hash partitions
of bounded size. Bins that are nearly full are done. The rest become items of
the next round, as long as the sum of what they hold, and are dealt anew to the
fewer partitions that they need, until one partition holds all of them or
hardly any two of them fit together. Following an item through the rounds gives its sequence and offset.
"""

from __future__ import annotations

import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_tokenizer, materialise, slices
from .encoding import SLICE, encoder

CAPACITY = 4096
#: Items that one partition packs: enough variety that few bins stay underfull.
ITEMS_A_PARTITION = 40_000
#: A bin whose free space is at most this part of the capacity is nearly full.
SLACK = 1 / 256
#: Rounds go on while one joins at least this part of its items to others.
LEAST_GAIN = 1 / 256
#: The column that numbers the pieces.
ITEM = "_packed_item"


def tokenise_pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of ``df(doc_id, text)``.

    Each text is encoded whole (null: empty), ``end_id`` is appended, and only
    what is longer than ``capacity`` is cut, into pieces of that length.
    """
    path = tokenizer or default_tokenizer()

    def work(batches):
        enc = encoder(path)
        end = end_id.to_bytes(4, "little")
        step = 4 * capacity
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                rows = [
                    (i, at // step, at // 4, min(step, len(raw) - at) // 4, zlib.crc32(raw[at : at + step]))
                    for i, raw in enumerate(r + end for r in enc.encode(b.column("text")).to_pylist())
                    for at in range(0, len(raw), step)
                ]
                i, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(i)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, bin, offset, length) by best fit, longest first, ties by item.

    A bin is named by its first item. ``free`` has a bit for each amount of
    free space that some bin has, so the tightest fit is its lowest set bit
    from the item's length on.
    """
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, out = 0, []
    for item, length in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = free >> length
        if length and fits:
            space = length + (fits & -fits).bit_length() - 1
            home = bins[space].pop()
            if not bins[space]:
                free &= ~(1 << space)
        else:
            space, home = capacity, item
        out.append((item, home, capacity - space, length))
        left = space - length
        if left:
            bins[left].append(home)
            free |= 1 << left
    return out


def _round(items: DataFrame, parts: int, capacity: int, turn: int = 0) -> DataFrame:
    """One round over ``items(item, length)``: (item, bin, at, length). Every turn deals them anew."""

    def work(batches):
        import numpy as np

        ids, lengths = [], []
        for b in batches:
            ids.append(b.column("item").to_numpy())
            lengths.append(b.column("length").to_numpy())
        if ids and sum(map(len, ids)):
            rows = best_fit(list(zip(np.concatenate(ids).tolist(), np.concatenate(lengths).tolist(), strict=True)), capacity)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item", "bin", "at", "length"])

    dealt = items.select("item", "length").repartition(parts, F.xxhash64("item", F.lit(turn)))
    return dealt.mapInArrow(work, "item long, bin long, at long, length long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, items_a_partition: int = ITEMS_A_PARTITION, slack: float = SLACK, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Packs ``pieces(length, ...)`` into sequences of at most ``capacity``.

    Adds sequence_id (long, any numbers) and offset (long, gapless from 0 in
    each sequence) and keeps every row and column; columns of these two names
    are replaced. Lengths lie in 1..capacity. Repeated rows are packed each for
    itself; an empty table stays empty. No round gives a partition more than
    some ``items_a_partition`` items: the rounds end when one partition has held
    all open bins, or when a round has joined less than ``least_gain`` of them.
    """
    pieces = pieces.drop("sequence_id", "offset")
    table = materialise(pieces.withColumn(ITEM, F.monotonically_increasing_id()), "pieces")
    n, shortest = table.agg(F.count("*"), F.min("length")).first()
    if not n:
        return table.drop(ITEM).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    items, rounds = table.where(F.col("length") < capacity).select(F.col(ITEM).alias("item"), "length"), []
    had = n
    nearly = int(capacity * slack)
    while True:
        parts = max(1, -(-had // items_a_partition))
        placed = materialise(_round(items, parts, capacity, len(rounds)), f"round{len(rounds)}")
        rounds.append(placed)
        if parts == 1:
            break
        held = materialise(placed.groupBy("bin").agg(F.sum("length").alias("length")), f"bins{len(rounds)}")
        # A bin with less room than the shortest item still about can take nothing more.
        items = held.where((capacity - F.col("length") > nearly) & (capacity - F.col("length") >= shortest)).withColumnRenamed("bin", "item")
        (bins,), (left, shortest) = held.agg(F.count("*")).first(), items.agg(F.count("*"), F.min("length")).first()
        if left < 2 or (len(rounds) > 1 and had - bins < least_gain * had):
            break
        had = left
    first, later = rounds[0], rounds[1:]
    if later:
        # What happens to a bin of the first round later on.
        chain = reduce(
            lambda done, r: done.join(r.select(F.col("item").alias("bin"), F.col("bin").alias("up"), F.col("at").alias("more")), "bin", "left").select(
                "first", F.coalesce("up", "bin").alias("bin"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            ),
            later[1:],
            later[0].select(F.col("item").alias("first"), "bin", F.col("at").alias("shift")),
        )
        moved = first.join(chain.withColumnRenamed("bin", "up"), F.col("bin") == F.col("first"), "left").select(
            "item", F.coalesce("up", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset")
        )
    else:
        moved = first.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    whole = table.join(moved.withColumnRenamed("item", ITEM), ITEM, "left")
    return whole.withColumns({"sequence_id": F.coalesce("sequence_id", ITEM), "offset": F.coalesce("offset", F.lit(0))}).drop(ITEM)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Tokenises and packs ``df(doc_id, text)``; other columns are not read."""
    return pack(tokenise_pieces(df, capacity, end_id, tokenizer), capacity)
