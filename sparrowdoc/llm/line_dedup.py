"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A :class:`LineIndex` keeps three tables in the shared folder, each in parts that
are only ever added to: the references (line key and document, with the version
that added or removed it), the reference counts (documents and largest document
of a key), and one cuckoo filter a shard with the keys whose count has reached
the threshold. Inserting or deleting documents counts the touched keys anew;
keys that cross the threshold enter or leave their shard's filter, so a deletion
undoes an insertion, and shards without such keys stay as they are. Dedup brings
references and filters together by shard, in groups of bounded size, and looks up
only what passes in the shard's exact counts, so a false positive costs a look
and never a line.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, slices

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys a shard's filter is planned for.
KEYS_A_SHARD = 100_000
#: References that meet a shard's filter in one group, on average; shards with more are split.
ROWS_A_GROUP = 250_000
#: Parts of a table before they are made one.
PARTS = 8
SLOTS = 4
SPACE = b" \t\n\v\f\r"


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets a key; deletable."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def planned(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, (int(keys / SLOTS / 0.8)).bit_length()))

    @staticmethod
    def marks(k2: np.ndarray) -> np.ndarray:
        """Fingerprints; 0 means an empty slot, so it is no fingerprint."""
        return np.maximum(k2.astype(np.uint64) >> np.uint64(48), np.uint64(1)).astype(np.uint16)

    def places(self, k1: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        one = k1.astype(np.uint64) & mask
        return one, (one ^ (marks.astype(np.uint64) * np.uint64(0x5BD1E995))) & mask

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        m = self.marks(k2)
        one, two = self.places(k1, m)
        return (self.table[one] == m[:, None]).any(1) | (self.table[two] == m[:, None]).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Adds keys, each once. False if the table is too full; it is then unusable."""
        m = self.marks(k2)
        one, two = self.places(k1, m)
        mask, table = len(self.table) - 1, self.table
        for mark, a, b in zip(m.tolist(), one.tolist(), two.tolist(), strict=True):
            at, turn = a, 0
            for place in (a, b):
                if (empty := np.flatnonzero(table[place] == 0)).size:
                    table[place, empty[0]] = mark
                    break
            else:
                while turn < 500:
                    slot = turn % SLOTS
                    mark, table[at, slot] = int(table[at, slot]), mark
                    at = (at ^ (mark * 0x5BD1E995)) & mask
                    if (empty := np.flatnonzero(table[at] == 0)).size:
                        table[at, empty[0]] = mark
                        break
                    turn += 1
                else:
                    return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        m = self.marks(k2)
        one, two = self.places(k1, m)
        for mark, a, b in zip(m.tolist(), one.tolist(), two.tolist(), strict=True):
            for place in (a, b):
                if (found := np.flatnonzero(self.table[place] == mark)).size:
                    self.table[place, found[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, "<u2").reshape(-1, SLOTS).copy())


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, or None where it is shorter than ``min_chars`` code points.
    ``line`` has A-Z lower-cased already."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    return key if len(key) >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars else None


def line_references(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc_id): the distinct long line keys of each document, as 128-bit hashes."""
    import xxhash

    def work(batches):
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for b in slices(whole, "text"):
                hashes, counts = [], []
                for t in b.column("text").to_pylist():
                    keys = {k for x in t.encode().lower().split(b"\n") if len(x) >= min_chars and (k := key_of(x, min_chars))} if t else ()
                    hashes += map(digest, keys)
                    counts.append(len(keys))
                pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                of = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), b.column("doc_id").take(of)], names=["k1", "k2", "doc_id"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(work, f"k1 long, k2 long, doc_id {kind}").distinct()


def _counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _planned_shards(shared: DataFrame) -> int:
    return max(1, -(-shared.count() // KEYS_A_SHARD))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def _change_filters(filters: DataFrame | None, shards: int, changed: DataFrame) -> DataFrame:
    """Applies ``changed(k1, k2, enters)`` to the filters of the shards that it has keys of. One
    that gets too full comes back empty, to be made anew of all its keys; without ``filters``
    all are made of the keys given, in twice the size as often as needed."""
    import pandas as pd

    changed = changed.withColumn("shard", _shard(shards))

    def apply(held: CuckooFilter | None, keys: pd.DataFrame) -> CuckooFilter | None:
        k1, k2, enters = keys["k1"].to_numpy(), keys["k2"].to_numpy(), keys["enters"].to_numpy(dtype=bool)
        k1 = k1 >> 8  # the shard took the low bits
        f = held or CuckooFilter.planned(int(enters.sum()))
        f.delete(k1[~enters], k2[~enters])
        return f if f.insert(k1[enters], k2[enters]) else None

    def fresh(keys: pd.DataFrame) -> pd.DataFrame:
        size = len(keys)
        while (f := apply(CuckooFilter.planned(size), keys)) is None:
            size *= 2
        return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "filter": [f.to_bytes()]})

    if filters is None:
        return changed.groupBy("shard").applyInPandas(fresh, "shard int, filter binary")

    def both(held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if not len(keys):
            return pd.DataFrame({"shard": pd.Series(dtype="int32"), "filter": pd.Series(dtype="object")})
        if not len(held):
            return fresh(keys)
        f = apply(CuckooFilter.from_bytes(held["filter"].iloc[0]), keys)
        return pd.DataFrame({"shard": [int(held["shard"].iloc[0])], "filter": [f.to_bytes() if f else b""]})

    return filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(both, "shard int, filter binary")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


@dataclass(frozen=True)
class LineIndex:
    """References, counts and filters of the lines seen so far.

    Rows that share a doc_id are one document. Rows without one are one document
    too, which comes before every other. Null or empty texts hold one empty line.
    Each table is a tuple of parts with the column ``version``; of rows with equal
    keys the latest version holds.
    """

    ref_parts: tuple[DataFrame, ...]
    count_parts: tuple[DataFrame, ...]
    filter_parts: tuple[DataFrame, ...]
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @staticmethod
    def _latest(parts: tuple[DataFrame, ...], keys: list[str], held: list[str]) -> DataFrame:
        if len(parts) == 1:
            return parts[0].select(*keys, *held)
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy(*keys).agg(F.max_by(F.struct(*held), "version").alias("_held")).select(*keys, "_held.*")

    @property
    def refs(self) -> DataFrame:
        return self._latest(self.ref_parts, ["k1", "k2", "doc_id"], ["live"]).where("live").drop("live")

    @property
    def counts(self) -> DataFrame:
        """Keys of two or more documents (of one, where that is the threshold)."""
        return self._latest(self.count_parts, ["k1", "k2"], ["n_docs", "max_doc"]).where(F.col("n_docs") >= min(2, self.min_docs))

    @property
    def filters(self) -> DataFrame:
        return self._latest(self.filter_parts, ["shard"], ["filter"])

    def _shared(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("n_docs") >= self.min_docs)

    @staticmethod
    def _stored(df: DataFrame, version: int, name: str) -> DataFrame:
        return materialise(df.withColumn("version", F.lit(version)), name)

    @classmethod
    def create(cls, df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        refs = cls._stored(line_references(df, min_chars).withColumn("live", F.lit(True)), 0, "line-refs")
        counts = cls._stored(_counts(refs).where(F.col("n_docs") >= min(2, min_docs)), 0, "line-counts")
        shared = counts.where(F.col("n_docs") >= min_docs)
        shards = _planned_shards(shared)
        filters = cls._stored(_change_filters(None, shards, shared.select("k1", "k2", F.lit(True).alias("enters"))), 0, "line-filters")
        return cls((refs,), (counts,), (filters,), shards, min_chars, min_docs)

    def insert(self, df: DataFrame) -> LineIndex:
        """The index with the documents of ``df`` added; lines a document has already stay counted once."""
        return self._with(line_references(df, self.min_chars).withColumn("live", F.lit(True)))

    def delete(self, df: DataFrame) -> LineIndex:
        """The index without the documents whose doc_id is in ``df``; undoes their insertion."""
        gone = df.select(F.col("doc_id").alias("of")).distinct()
        hit = self.refs.join(gone, _same(F.col("doc_id"), F.col("of")), "left_semi")
        return self._with(hit.withColumn("live", F.lit(False)))

    def _with(self, change: DataFrame) -> LineIndex:
        version = len(self.ref_parts)
        whole = self._compact() if version >= PARTS else self
        version = len(whole.ref_parts)
        part = self._stored(change, version, "line-refs")
        keys = part.select("k1", "k2").distinct()
        after = replace(whole, ref_parts=(*whole.ref_parts, part))
        # Keys that no document holds any more have a count of 0.
        counted = keys.join(_counts(after.refs.join(keys, ["k1", "k2"], "left_semi")), ["k1", "k2"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
        touched = self._stored(counted, version, "line-counts")
        after = replace(after, count_parts=(*whole.count_parts, touched))
        was, now = (self._shared(c).select("k1", "k2") for c in (whole.counts.join(keys, ["k1", "k2"], "left_semi"), touched))
        changed = now.join(was, ["k1", "k2"], "left_anti").withColumn("enters", F.lit(True)).unionByName(was.join(now, ["k1", "k2"], "left_anti").withColumn("enters", F.lit(False)))
        entries = self._shared(after.counts).select("k1", "k2", F.lit(True).alias("enters"))
        planned = _planned_shards(entries)
        if planned > 2 * self.shards:
            # The index has outgrown its shards: more of them, all anew.
            return replace(after, filter_parts=(self._stored(_change_filters(None, planned, entries), 0, "line-filters"),), shards=planned)
        made = materialise(_change_filters(whole.filters, self.shards, changed), "line-filters")
        full = [r["shard"] for r in made.where(F.length("filter") == 0).select("shard").collect()]
        if full:
            made = made.where(F.length("filter") > 0).unionByName(_change_filters(None, self.shards, entries.where(_shard(self.shards).isin(full))))
        return replace(after, filter_parts=(*whole.filter_parts, made.withColumn("version", F.lit(version)) if not full else self._stored(made, version, "line-filters")))

    def _compact(self) -> LineIndex:
        """Every table in one part."""
        refs = self._stored(self.refs.withColumn("live", F.lit(True)), 0, "line-refs")
        counts = self._stored(self.counts, 0, "line-counts")
        return replace(self, ref_parts=(refs,), count_parts=(counts,), filter_parts=(self._stored(self.filters, 0, "line-filters"),))

    def _lost(self) -> DataFrame:
        """(doc_id, k1, k2): the references that lose their lines.

        A shard's filter and its exact counts meet its references, dealt over as many
        groups as these need (counted first), so a hot key is spread over many groups.
        """
        shards, refs = self.shards, self.refs
        n = refs.count()
        kind = self.refs.schema["doc_id"].dataType
        arrow = to_arrow_type(kind)
        shared = self._shared(self.counts).withColumn("shard", _shard(shards))
        # One number for each shard of ``KEYS_A_SHARD`` keys: how often its filter is needed.
        rows = {r["shard"]: r["n"] for r in shared.groupBy("shard").agg(F.sum("n_docs").alias("n")).collect()}
        spread = max(1, -(-n // (ROWS_A_GROUP * max(1, len(rows)))))
        splits = F.array(*[F.lit(max(spread, -(-rows.get(s, 0) // ROWS_A_GROUP))) for s in range(shards)])
        parts = F.element_at(splits, F.col("shard") + 1)
        left = refs.withColumn("shard", _shard(shards)).withColumn("split", F.pmod(F.xxhash64("doc_id", "k2"), parts).cast("int"))
        exact = shared.groupBy("shard").agg(F.collect_list(F.struct("k1", "k2", "max_doc")).alias("exact"))
        right = self.filters.join(exact, "shard").withColumn("split", F.explode(F.sequence(F.lit(0), parts - 1)))
        schema = pa.schema([("doc_id", arrow), ("k1", pa.int64()), ("k2", pa.int64())])

        def probe(given: pa.Table, held: pa.Table) -> pa.Table:
            if not given.num_rows or not held.num_rows:
                return schema.empty_table()
            k1, k2 = given.column("k1").to_numpy(), given.column("k2").to_numpy()
            passed = np.flatnonzero(CuckooFilter.from_bytes(held.column("filter")[0].as_buffer().to_pybytes()).contains(k1 >> 8, k2))
            entries = held.column("exact").combine_chunks().flatten()
            e1, e2 = (entries.field(f).to_numpy(zero_copy_only=False) for f in ("k1", "k2"))
            order = np.lexsort((e2, e1))
            pairs = np.empty(len(order), [("a", "<i8"), ("b", "<i8")])
            pairs["a"], pairs["b"] = e1[order], e2[order]
            asked = np.empty(len(passed), pairs.dtype)
            asked["a"], asked["b"] = k1[passed], k2[passed]
            at = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
            found = pairs[at] == asked
            passed, at = passed[found], order[at[found]]
            docs, last = given.column("doc_id").combine_chunks().take(pa.array(passed)), entries.field("max_doc").take(pa.array(at))
            is_last = pc.or_(pc.fill_null(pc.equal(docs, last), False), pc.and_(pc.is_null(docs), pc.is_null(last)))
            goes = np.flatnonzero(~is_last.to_numpy(zero_copy_only=False))
            return pa.table([docs.take(pa.array(goes)), pa.array(k1[passed][goes]), pa.array(k2[passed][goes])], schema=schema)

        return left.groupBy("shard", "split").cogroup(right.groupBy("shard", "split")).applyInArrow(probe, f"doc_id {kind.simpleString()}, k1 long, k2 long")

    def droppable(self) -> DataFrame:
        """(doc_id, drops): for each document the keys (16 bytes each) of lines it loses."""
        return self._lost().groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("drops"))

    def dedupe(self, df: DataFrame, texts: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_sha256[, kept]) and the columns ``carry`` of each row of
        ``df``; of those, names that the result has itself are left out."""
        import xxhash

        min_chars = self.min_chars
        names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", *["kept"] * texts]
        carry = tuple(c for c in carry if c not in names)
        held = [f"_carry{i}" for i in range(len(carry))]
        drops = self.droppable().select(F.col("doc_id").alias("_of"), F.col("drops").alias("_drops"))
        rows = df.select("doc_id", "text", *(F.col(f"`{c}`").alias(h) for c, h in zip(carry, held, strict=True)))
        rows = rows.join(drops, _same(F.col("doc_id"), F.col("_of")), "left").drop("_of")

        def work(batches):
            digest = xxhash.xxh3_128_digest
            for whole in batches:
                for b in slices(whole, "text"):
                    n, dropped, sha, kept = [], [], [], []
                    lost = b.column("_drops")
                    pairs = np.stack([lost.flatten().field(f).to_numpy() for f in ("k1", "k2")], 1).astype("<i8").tobytes() if len(lost.flatten()) else b""
                    at = 0
                    for t, size in zip(b.column("text").to_pylist(), pc.list_value_length(lost).fill_null(0).to_pylist(), strict=True):
                        t = t or ""
                        if size:
                            gone = {pairs[i : i + 16] for i in range(at, at + 16 * size, 16)}
                            at += 16 * size
                            lines = t.split("\n")
                            stay = [x for x in lines if len(x) < min_chars or not (k := key_of(x.encode().lower(), min_chars)) or digest(k) not in gone]
                            n.append(len(lines))
                            dropped.append(len(lines) - len(stay))
                            t = "\n".join(stay)
                        else:
                            n.append(t.count("\n") + 1)
                            dropped.append(0)
                        sha.append(hashlib.sha256(t.encode()).hexdigest())
                        if texts:
                            kept.append(t)
                    cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
                    cols += [pa.array(kept, pa.string())] * texts + [b.column(h) for h in held]
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, *held])

        kind = df.schema["doc_id"].dataType.simpleString()
        more = ["kept string"] * texts + [f"{h} {df.schema[c].dataType.simpleString()}" for c, h in zip(carry, held, strict=True)]
        out = rows.mapInArrow(work, ", ".join([f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string", *more]))
        return out.withColumnsRenamed(dict(zip(held, carry, strict=True)))


def dedupe_lines(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, texts: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Indexes ``df(doc_id, text)`` and drops its shared lines; other columns are only carried."""
    return LineIndex.create(df, min_chars, min_docs).dedupe(df, texts, carry)
