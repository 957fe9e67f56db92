"""N-gram Jaccard self-join over count vectors.

Each text becomes its set of word n-grams; each set a point of group counts:
n-grams are hashed to groups, a coordinate says how many fell into a group.
For two sets of sizes a and b that link, the coordinates differ by at most d
in all, where d follows from a + b and the threshold. So if the groups are cut
into more than d blocks, some block has equal counts in both points. Points
are filed under every block's counts (by bands of set size, so that a linked
pair meets in a band), and only points in one file are compared:

1. each with the file's first point; the overlap is bounded by the summed
   minima of the coordinates, first of few and then of as many as suit the
   sets' size, and only pairs whose bounds pass are verified on their n-grams;
2. then, in files whose points are still in different components, every other
   pair through an R-tree over the points whose nodes are skipped by the same
   bound. It goes in rounds: a point first meets its few likeliest partners,
   and in each round those points that have others left meet four times as many,
   while links found so far join components. The rounds end when no point has
   partners left that it has not met. The searches in a large file are dealt
   to many tasks.

Nothing is dropped: a link is missed by neither step, and pairs already in one
component need no look, because the result is components. A set is named by 64
bits of a 128-bit hash; where two sets share these, both take the other 64.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, rows_a_batch, slices
from .components import components
from .encoding import forget
from .license_scan import WordHash, mix, rolling

#: Least number of a point's coordinates, 8 bits each. Points of larger sets have a power of two as many.
GROUPS = 256
FINEST = 1 << 15
#: N-grams a coordinate: of the points that bounds are first taken of, and of fine points.
COARSE, FINE = 8, 2
#: Bytes of points sent to every task at most; more are joined to their rows.
SEND_POINTS = 48 << 20
#: Ids sent to every task at most, and only if they are numbers, so of eight bytes or fewer.
SEND_IDS = 1_000_000
#: Points of a leaf, and children of an inner node.
FAN = 8
#: Searches of one file that a task makes; a larger file is dealt to more tasks.
BLOCK = 4_000
#: Pairs of one set in a join; the pairs of a set with more are dealt to more tasks.
HOT = 500
#: Bytes of file members handled together.
HELD_BYTES = 8 << 20
#: Names that may be shared by different sets: many more than chance gives any corpus.
SHARED = 100_000
#: Entries packed together, and entries that a task sorts.
PACKED, SORTED = 1_000_000, 2_000_000
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000
#: Partners that a point meets in the first round.
FIRST_WIDTH = 4


# ---- sets -------------------------------------------------------------------


def ngram_set(text: str | None, k: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the word k-grams: A-Z lower-cased, words cut at ASCII
    white space; fewer words than k count as one n-gram; no words, no n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    return np.unique(rolling(h, k) if len(h) >= k else rolling(h, len(h)) ^ np.uint64(len(h)))


def point(s: np.ndarray, a_group: int = FINE) -> np.ndarray:
    """Counts of the set in each group, modulo 256; no more than ``a_group`` in a group on average."""
    groups = GROUPS
    while groups < FINEST and a_group * groups < len(s):
        groups *= 2
    return np.bincount((mix(s ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.uint8)


def folded(p: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The point over fewer groups: groups whose numbers agree modulo ``groups`` are one."""
    return p if len(p) == groups else p.reshape(-1, groups).sum(0, dtype=np.uint8)


def bound(p: np.ndarray, n: int, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of a set (point ``p``, size ``n``) with others (``q``, ``m``).

    The sum of the minima is half of n + m less the coordinates' differences;
    modulo 256 these differences can only come out smaller, so it stays a bound.
    """
    gap = q - p[None, :]
    return (n + m - np.minimum(gap, 0 - gap).sum(1, dtype=np.int64)) // 2


def needed(n, m, num: int, den: int):
    """Smallest overlap of sets of sizes n and m that link: den * overlap >= num * union."""
    return -((-num * (n + m)) // (num + den))


# ---- filing -----------------------------------------------------------------


@functools.cache
def bands(num: int, den: int, upto: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bands of set size: first sizes, numbers of blocks, least numbers of equal blocks, and thin counts.

    Sizes of linked sets are in one band or in neighbouring ones. With more
    blocks than the most that can differ, a linked pair has ``equal`` or more
    equal blocks. Blocks with ``thin`` or fewer n-grams say little, as many
    texts share them by chance or by a common passage. If a set has fewer thin
    blocks than ``equal``, some equal block isn't thin; so thin blocks are
    filed only for sets that have ``equal`` of them or more, which are few.
    ``thin`` is as large as up to half as many more blocks allow.
    """
    first, blocks, equal, thin = [1], [], [], []
    while True:
        low = first[-1]
        high = low * den // num
        d = 2 * high * (den - num) // (den + num)
        found = (1, 0)
        for t in (4, 3, 2, 1, 0):
            e = next((e for e in range(1, d // 2 + 2) if e > (z := _thin(low, d + e, t)) + 2 * math.sqrt(z)), 0)
            if e:
                found = (e, t)
                break
        blocks.append(d + found[0])
        equal.append(found[0])
        thin.append(found[1])
        if low > upto:
            return first, blocks, equal, thin
        first.append(high + 1)


def _thin(n: int, m: int, t: int) -> float:
    """Expected number of m blocks with t or fewer of n n-grams."""
    mean = n / m
    return m * math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(t + 1))


def file_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The files (64-bit) that a non-empty set is filed under."""
    n = len(s)
    first, blocks, equal, thin = bands(num, den, 1 << max(10, n.bit_length() + 1))
    own = int(np.searchsorted(first, n, "right")) - 1
    spread = mix(s ^ np.uint64(0xD1342543DE82EF95))
    out = []
    for band in (own, own + 1):
        if band != own and n * den < num * first[band]:
            continue  # nothing in the next band is near enough in size
        m = blocks[band]
        block = (spread >> np.uint64(32)).astype(np.int64) % m
        group = spread & np.uint64(0xFFFFFFFF)
        # The sum over a block is a hash of its group counts: each count times its group's value.
        value = mix(group * np.uint64(0x9E3779B97F4A7C15) + block.astype(np.uint64))
        order = np.argsort(block, kind="stable")
        at = block[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        full = at[starts]
        sums = np.add.reduceat(value[order], starts)
        thick = np.diff(np.r_[starts, n]) > thin[band]
        if m - np.count_nonzero(thick) < equal[band]:
            full, sums = full[thick], sums[thick]
        else:
            whole = np.zeros(m, np.uint64)
            whole[full] = sums
            full, sums = np.arange(m), whole
        out.append(mix(sums + mix(np.uint64((band + 1) << 32) + full.astype(np.uint64))))
    return np.concatenate(out)


# ---- R-tree -----------------------------------------------------------------


class CountRTree:
    """Packed R-tree over points of counts; search prunes nodes by the bound.

    Points are packed by recursive tiling: a run of points is halved along the
    coordinate that varies most in it (the set's size is one, too) until a leaf
    holds ``FAN``. Each node keeps the least and largest coordinates and sizes
    below it; the differences to that box are a lower bound of the differences to
    any point in it. Counts are modulo 256: where they don't add up to the set's
    size some have wrapped, and no box is used for such a set.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.order = self._tiled(points, sizes)
        self.points, self.sizes = points[self.order], sizes[self.order]
        wrapped = self.points.sum(1, dtype=np.int64) != self.sizes
        level = self.points, self.points, self.sizes, self.sizes, wrapped
        self.levels = []
        self.visited = 0
        while not self.levels or len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), FAN)
            level = tuple(f.reduceat(x, starts, 0) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum, np.logical_or), level, strict=True))
            self.levels.append((level[0].astype(np.int16), level[1].astype(np.int16), *level[2:]))

    @staticmethod
    def _tiled(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        order = np.arange(len(sizes))
        todo = [(0, len(sizes))]
        while todo:
            a, b = todo.pop()
            if b - a <= FAN:
                continue
            rows = order[a:b]
            held = points[rows].astype(np.float32)
            spread = held.var(0)
            most = int(spread.argmax())
            by = sizes[rows] if sizes[rows].var() > spread[most] else held[:, most]
            # A multiple of the leaf's size stands on the left, so no leaf straddles.
            half = a + max(FAN, (b - a) // 2 // FAN * FAN)
            order[a:b] = rows[np.argsort(by, kind="stable")]
            todo += [(a, half), (half, b)]
        return order

    def near(self, p: np.ndarray, n: int) -> np.ndarray:
        """Indices of points whose overlap bound with (p, n) allows a link."""
        num, den = self.num, self.den
        x = p.astype(np.int16)[None, :]
        boxed = int(p.sum(dtype=np.int64)) == n
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high, least, most, wrapped = (v[nodes] for v in self.levels[depth])
            fits = (least * num <= n * den) & (n * num <= most * den)
            if boxed and len(self.levels) > 1:
                outside = (np.maximum(low - x, 0) + np.maximum(x - high, 0)).sum(1, dtype=np.int64)
                # Before rounding, the differences of a link grow with the sizes; rounded they don't, so a node of mixed sizes needs this.
                fits &= wrapped | (outside <= (n + most) * (den - num) // (num + den))
            children = nodes[fits][:, None] * FAN + np.arange(FAN)[None, :]
            below = len(self.levels[depth - 1][0]) if depth else len(self.sizes)
            if not depth:
                self.visited += len(children)
            nodes = children[children < below]
        m = self.sizes[nodes]
        ok = bound(p, n, self.points[nodes], m) >= needed(n, m, num, den) if len(nodes) else np.zeros(0, bool)
        return self.order[nodes[ok]]


# ---- plan -------------------------------------------------------------------


def set_name(s: np.ndarray, shared: frozenset[int] = frozenset(), bits: int = 64) -> tuple[int, int]:
    """(name, other half) of a set: halves of a 128-bit hash. A name in ``shared``, which sets
    of different other halves have, gives way to the other half."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    name, other = h >> 64 >> 64 - bits, h & 0xFFFFFFFFFFFFFFFF
    return (other if name in shared else name), other


def _signed(names: list[int]) -> pa.Array:
    return pa.array(np.array(names, np.uint64).view(np.int64))


def set_table(df: DataFrame, k: int, bits: int = 64) -> DataFrame:
    """(doc_id, n, set, other): size and both halves of the hash of each row's set."""

    def work(batches):
        forget()
        memo = WordHash()
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [ngram_set(t, k, memo) for t in b.column("text").to_pylist()]
                n = pa.array([len(s) for s in sets], pa.int64())
                names = [set_name(s, bits=bits) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, *(_signed([x[i] for x in names]) for i in (0, 1))], names=["doc_id", "n", "set", "other"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n long, set long, other long")


def shared_names(sets: DataFrame) -> frozenset[int]:
    """Names that different sets have: some three among 10^10 sets."""
    twice = sets.groupBy("set").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b").select("set")
    found = twice.limit(SHARED + 1).collect()
    if len(found) > SHARED:
        raise ValueError("more sets share a name than 64 bits explain")
    return frozenset(r["set"] & 0xFFFFFFFFFFFFFFFF for r in found)


def filed(df: DataFrame, k: int, num: int, den: int, buckets: int, shared: frozenset[int] = frozenset(), bits: int = 64) -> DataFrame:
    """(bucket, pack): every file of every set, packed. A task files equal sets once.

    Files are dealt to buckets by hash. A pack has one bucket's entries of many
    sets: the sets' hashes, their numbers of entries, and 40 bits of each
    file, so that an entry takes some seven bytes. Two files whose 40 bits and
    bucket agree by chance are one file: more to compare, nothing lost.
    """

    def packs(keys, names):
        counts = np.fromiter(map(len, keys), np.int64, len(keys))
        key, owner, names = np.concatenate(keys), np.repeat(np.arange(len(keys)), counts), np.array(names, np.uint64)
        bucket = (key % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, owner = bucket[order], owner[order]
        short = np.ascontiguousarray((key[order] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = []
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
            own = owner[lo:hi]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            n = np.diff(np.r_[first, len(own)]).astype("<u4")
            rows.append(len(n).to_bytes(4, "little") + names[own[first]].astype("<u8").tobytes() + n.tobytes() + short[lo:hi].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(rows, pa.binary())], names=["bucket", "pack"])

    def work(batches):
        forget()
        memo, seen = WordHash(), set()
        keys, names, held = [], [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                for t in b.column("text").to_pylist():
                    s = ngram_set(t, k, memo)
                    if not len(s) or (name := set_name(s, shared, bits)[0]) in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(name)
                    keys.append(file_keys(s, num, den))
                    names.append(name)
                    held += len(keys[-1])
                if held > PACKED:
                    yield packs(keys, names)
                    keys, names, held = [], [], 0
        if keys:
            yield packs(keys, names)

    return df.select("text").mapInArrow(work, "bucket int, pack binary")


def unpacked(bucket: int, pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(file, set) of a pack's entries."""
    n = int.from_bytes(pack[:4], "little")
    names = np.frombuffer(pack, "<i8", n, 4)
    counts = np.frombuffer(pack, "<u4", n, 4 + 8 * n)
    short = np.frombuffer(pack, np.uint8, offset=4 + 12 * n).reshape(-1, 5)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :5] = short
    return wide.view("<i8").ravel() | (bucket & 0x7FFFFF) << 40, np.repeat(names, counts)


def shared_files(packed: DataFrame, partitions: int) -> DataFrame:
    """(file, set, head, size) of files with two or more sets; head is the file's first set, size their number.

    A task sorts the entries of its buckets, 16 bytes each; ``partitions`` is
    chosen so that these are a few million.
    """

    def work(batches):
        files, sets = [], []
        for b in batches:
            for bucket, pack in zip(b.column("bucket").to_pylist(), b.column("pack").to_pylist(), strict=True):
                f, s = unpacked(bucket, pack)
                files.append(f)
                sets.append(s)
        if not files:
            return
        f, s = np.concatenate(files), np.concatenate(sets)
        files.clear()
        sets.clear()
        order = np.lexsort((s, f))
        f, s = f[order], s[order]
        new = np.r_[True, (f[1:] != f[:-1]) | (s[1:] != s[:-1])]
        f, s = f[new], s[new]
        same = f[1:] == f[:-1]
        give = np.r_[False, same] | np.r_[same, False]
        f, s = f[give], s[give]
        start = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.empty(0, np.int64)
        held = np.diff(np.r_[start, len(f)])
        head, size = np.repeat(s[start], held), np.repeat(held, held)
        for at in range(0, len(f), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 200_000]) for x in (f, s, head, size)], names=["file", "set", "head", "size"])

    return packed.repartition(partitions, "bucket").mapInArrow(work, "file long, set long, head long, size long")


def _numbers(df: DataFrame, column: str) -> bool:
    """Whether the column's ids are numbers, and few enough to be sent to every task."""
    return df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") and df.count() <= SEND_IDS


def _texts(df: DataFrame, reps: DataFrame, k: int, shared: frozenset[int] = frozenset(), bits: int = 64) -> DataFrame:
    """(set, text, n, point, fine): a text of each set of ``reps(set, rep)`` with the set's size, coarse and fine points.

    Rows are looked up by representative and told apart by their own set, as rows may
    share a doc_id or have none. ``reps`` goes to every task only if it is small.
    """

    def work(batches):
        forget()
        memo = WordHash()
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [ngram_set(t, k, memo) for t in b.column("text").to_pylist()]
                cols = [_signed([set_name(s, shared, bits)[0] for s in sets]), b.column("text"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([point(s, g).tobytes() for s in sets], pa.binary()) for g in (COARSE, FINE))]
                yield pa.RecordBatch.from_arrays(cols, names=["set", "text", "n", "point", "fine"])

    sent = F.broadcast if _numbers(reps, "rep") else lambda x: x
    named, nameless = reps.where(F.col("rep").isNotNull()), reps.where(F.col("rep").isNull())
    rows = df.withColumnRenamed("doc_id", "rep").join(sent(named.select("rep").distinct()), "rep", "left_semi").select("text")
    if nameless.limit(1).count():
        rows = rows.unionByName(df.where(F.col("doc_id").isNull()).select("text"))
    rows = rows.mapInArrow(work, "set long, text string, n long, point binary, fine binary")
    return rows.join(sent(reps.select("set")), "set", "left_semi").dropDuplicates(["set"])


def _hot(sets: DataFrame) -> DataFrame | None:
    """(hot, salts): the sets of more than ``HOT`` rows ``(hot)``, if any, and the groups that their rows are dealt to."""
    many = sets.groupBy("hot").count().where(F.col("count") > HOT)
    found = materialise(many.select("hot", F.ceil(F.col("count") / HOT).cast("int").alias("salts")), "ngram-hot")
    n = found.count()
    return (F.broadcast(found) if n <= SEND_IDS else found) if n else None


def _hot_ends(pairs: DataFrame) -> DataFrame | None:
    return _hot(pairs.select(F.explode(F.array("a", "b")).alias("hot")))


def _beside(pairs: DataFrame, sets: DataFrame, end: str, hot: DataFrame | None) -> DataFrame:
    """The pairs with the columns of ``sets(set, ...)`` for one of their ends, the columns' names
    marked by it. Hot sets stand once for each group of their pairs."""
    marked = sets.withColumnsRenamed({c: f"{c}_{end}" for c in sets.columns if c != "set"}).withColumnRenamed("set", end)
    if hot is None:
        return pairs.join(marked, end)
    salts = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(hot, F.col(end) == F.col("hot"), "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), salts).cast("int")).drop("hot", "salts")
    copies = marked.join(hot, F.col(end) == F.col("hot"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("hot", "salts")
    return dealt.join(copies, [end, "salt"]).drop("salt")


def _within_bound(pairs: DataFrame, points: DataFrame, num: int, den: int, hot: DataFrame | None, column: str = "point") -> DataFrame:
    """The pairs (a, b) whose bound, over the points in ``column``, allows a link."""

    def differences(x: list[bytes], y: list[bytes]) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        least = np.array([len(v) == GROUPS == len(w) for v, w in zip(x, y, strict=True)], bool)
        gap = np.subtract(*(np.frombuffer(b"".join(p for p, few in zip(v, least, strict=True) if few), np.uint8).reshape(-1, GROUPS) for v in (x, y)))
        out[least] = np.minimum(gap, 0 - gap).sum(1, dtype=np.int64)
        for i in np.flatnonzero(~least).tolist():
            v, w = x[i], y[i]
            few = min(len(v), len(w))
            gap = folded(np.frombuffer(v, np.uint8), few) - folded(np.frombuffer(w, np.uint8), few)
            out[i] = np.minimum(gap, 0 - gap).sum(dtype=np.int64)
        return out

    def work(batches):
        for whole in batches:
            for b in slices(whole, "p_a"):
                na, nb = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
                top = (na + nb - differences(b.column("p_a").to_pylist(), b.column("p_b").to_pylist())) // 2
                ok = pa.array(top >= needed(na, nb, num, den))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    sets = points.select("set", "n", F.col(column).alias("p"))
    joined = _beside(_beside(pairs, sets, "a", hot), sets, "b", hot).select("a", "b", "n_a", "n_b", "p_a", "p_b")
    return joined.mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int, hot: DataFrame | None) -> DataFrame:
    """Links (a, b) among the pairs of sets, decided on the n-grams."""

    def work(batches):
        forget()
        memo = WordHash()
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole, "text_a"):
                ok = []
                for a, c, ta, tb in zip(*(b.column(x).to_pylist() for x in ("a", "b", "text_a", "text_b")), strict=True):
                    if len(held) > 200:
                        held.clear()
                    x = held.get(a)
                    x = held.setdefault(a, ngram_set(ta, k, memo)) if x is None else x
                    y = held.get(c)
                    y = held.setdefault(c, ngram_set(tb, k, memo)) if y is None else y
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(den * both >= num * (len(x) + len(y) - both))
                mask = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    sets = texts.select("set", "text")
    joined = _beside(_beside(pairs, sets, "a", hot), sets, "b", hot).select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(work, "a long, b long")


def _whole_files(batches):
    """The batches' rows, sorted by file, in tables of whole files."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size < HELD_BYTES:
            continue
        f, part = b.column("file").to_numpy(), b.column("part").to_numpy()
        cut = int(np.flatnonzero((f != f[-1]) | (part != part[-1]))[-1]) + 1 if (f[0], part[0]) != (f[-1], part[-1]) else 0
        if cut:
            yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held, size = [b.slice(cut)], 0
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(rows: DataFrame, points: DataFrame, num: int, den: int, width: int, partitions: int) -> DataFrame:
    """(a, b, open): pairs of sets of one file and different components whose bound allows a link.

    ``rows(file, size, set, comp, ask)``: the files' sets but their heads, which have met
    all others. A file whose sets are in one component is passed over; each other is one
    R-tree, in which the sets that ``ask`` look for partners of a larger name; the searches of
    a file of more than ``BLOCK`` sets are dealt to several tasks. Most points have 256
    bytes. A search gives at most ``width`` pairs, those with the highest bound; if there
    are others, a row says so: ``open``, with the file as ``a`` and the set as ``b``.
    """
    points = points.drop("fine")
    sent = None
    if points.agg(F.coalesce(F.sum(F.length("point")), F.lit(0))).first()[0] <= SEND_POINTS:
        got = points.orderBy("set").toArrow()
        flat = got.column("point").to_pylist()
        starts = np.r_[0, np.cumsum([len(p) for p in flat], dtype=np.int64)]
        sent = points.sparkSession.sparkContext.broadcast((got.column("set").to_numpy(), got.column("n").to_numpy(), starts, b"".join(flat)))
    else:
        rows = rows.join(points, "set")

    def searched(table: pa.Table):
        column = lambda c: table.column(c).to_numpy()
        files, parts, names, comps, asks = map(column, ("file", "part", "set", "comp", "asks"))
        starts = np.flatnonzero(np.r_[True, (files[1:] != files[:-1]) | (parts[1:] != parts[:-1])])
        ends = np.r_[starts[1:], len(files)]
        busy = (np.minimum.reduceat(comps, starts) != np.maximum.reduceat(comps, starts)) & np.logical_or.reduceat(asks, starts)
        if sent is not None:
            all_names, all_sizes, place, flat = sent.value
        for x, y in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True):
            name, comp = names[x:y], comps[x:y]
            if sent is not None:
                at = np.searchsorted(all_names, name)
                sizes, raw = all_sizes[at], [memoryview(flat)[place[i] : place[i + 1]] for i in at.tolist()]
            else:
                sizes, raw = table.column("n")[x:y].to_numpy(), table.column("point")[x:y].to_pylist()
            # The file's sizes are alike; its points are compared over as many groups as all have.
            groups = min(map(len, raw))
            matrix = np.stack([folded(np.frombuffer(p, np.uint8), groups) for p in raw])
            tree = CountRTree(matrix, sizes, num, den)
            for i in np.flatnonzero(asks[x:y]).tolist():
                j = tree.near(matrix[i], int(sizes[i]))
                j = j[(comp[j] != comp[i]) & (name[j] > name[i])]
                if len(j) > width:
                    spare = bound(matrix[i], int(sizes[i]), matrix[j], sizes[j]) - needed(int(sizes[i]), sizes[j], num, den)
                    j = j[np.lexsort((name[j], -spare))[:width]]
                    yield int(files[x]), int(name[i]), True
                for b in name[j].tolist():
                    yield int(name[i]), b, False

    def work(batches):
        found: set = set()

        def give():
            a, b, is_open = zip(*found, strict=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(is_open, pa.bool_())], names=["a", "b", "open"])

        for table in _whole_files(batches):
            found.update(searched(table))
            if len(found) > 500_000:
                yield give()
        if found:
            yield give()

    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("asks", F.col("ask") & (F.pmod("set", parts) == F.col("part")))
    dealt = rows.drop("size", "ask").repartition(partitions, "file", "part").sortWithinPartitions("file", "part")
    return dealt.mapInArrow(work, "a long, b long, open boolean").distinct()


def _partitions(sets: DataFrame, num: int, den: int) -> int:
    """Tasks that sort files, from the sizes of all sets: a set has some 2.5 times as many as can differ."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    entries = 2.5 * total * (den - num) / (den + num) + sets.count()
    return max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries / SORTED))


def ngram_components(df: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``df(doc_id, text)``.

    Two rows link when ``den * |A & B| >= num * |A | B|`` for their sets of word
    k-grams. component_id is the smallest doc_id reachable by links, the row's
    own included. Rows without words (or null) link with nothing; equal texts
    always link. A null doc_id names no component and stays null where nothing
    names it. Other columns are not read; an empty table gives none.
    """
    with rows_a_batch(df.sparkSession, BATCH_ROWS):
        return _components(df, k, num, den)


def _named(df: DataFrame, k: int, bits: int) -> tuple[DataFrame, frozenset[int]]:
    """The table (doc_id, n, set) of all rows, and the names that more than one set had."""
    sets = materialise(set_table(df, k, bits), "ngram-sets")
    shared = shared_names(sets.where(F.col("n") > 0))
    if shared:
        signed = [x - (1 << 64) if x >> 63 else x for x in shared]
        sets = sets.withColumn("set", F.when(F.col("set").isin(signed), F.col("other")).otherwise(F.col("set")))
    return sets.drop("other"), shared


def _components(df: DataFrame, k: int, num: int, den: int, bits: int = 64) -> DataFrame:
    df = df.select("doc_id", "text")
    sets, shared = _named(df, k, bits)
    reps = sets.where(F.col("n") > 0).groupBy("set").agg(F.min("doc_id").alias("rep"))
    partitions = _partitions(sets, num, den)
    members = materialise(shared_files(filed(df, k, num, den, 8 * partitions, shared, bits), partitions), "ngram-files")
    wanted = materialise(reps.join(members.select("set").distinct(), "set", "left_semi"), "ngram-reps")
    texts = materialise(_texts(df, wanted, k, shared, bits), "ngram-texts")
    points = texts.select("set", "n", "point", "fine")
    stars = materialise(members.where(F.col("set") != F.col("head")).select(F.least("set", "head").alias("a"), F.greatest("set", "head").alias("b")).distinct(), "ngram-stars")
    hot = _hot_ends(stars)
    close = _within_bound(_within_bound(stars, points, num, den, hot), points, num, den, hot, "fine")
    links = materialise(_verified(close, texts, k, num, den, hot), "ngram-links")
    named = texts.select("set")
    labels = components(links)
    rest = members.where((F.col("size") > 2) & (F.col("set") != F.col("head"))).select("file", "size", "set")
    small = named.count() <= SEND_IDS
    asking, tested, width = None, None, FIRST_WIDTH
    done = [members, wanted, texts, stars, links]
    while True:
        comp = named.join(labels.withColumnRenamed("node", "set"), "set", "left").select("set", F.coalesce("label", "set").alias("comp"))
        if asking is None:
            rows = rest.withColumn("ask", F.lit(True))
        else:
            # A file may have many sets, so its rows aren't gathered by file where that can be helped.
            files = asking.select("file").distinct()
            rows = rest.join(F.broadcast(files) if files.count() <= SEND_IDS else files, "file", "left_semi")
            rows = rows.join(asking, ["file", "set"], "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
        found = materialise(_open_pairs(rows.join(F.broadcast(comp) if small else comp, "set"), points, num, den, width, partitions), "ngram-pairs")
        new = found.where("NOT open").select("a", "b")
        if tested is not None:
            new = new.join(tested, ["a", "b"], "left_anti")
        new = materialise(new, "ngram-new")
        hot = _hot_ends(new)
        more = materialise(_verified(_within_bound(new, points, num, den, hot, "fine"), texts, k, num, den, hot), "ngram-links")
        done += [found, new, more]
        if more.limit(1).count():
            # The labels stand for the links already found.
            labels = components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
        asking = found.where("open").select(F.col("a").alias("file"), F.col("b").alias("set"), F.lit(True).alias("ask"))
        if not asking.limit(1).count():
            break
        tested = new if tested is None else tested.unionByName(new)
        width *= 4
    discard(*done)
    labels = labels.withColumnRenamed("node", "set")
    least = reps.join(labels, "set").groupBy("label").agg(F.min("rep").alias("least"))
    smallest = reps.join(labels.join(least, "label"), "set", "left").select("set", F.coalesce("least", "rep").alias("smallest"))
    hot = _hot(sets.select(F.col("set").alias("hot")))
    if hot is None:
        out = sets.join(smallest, "set", "left")
    else:
        # The rows of a text with many copies are dealt to several tasks.
        salts, is_hot = F.coalesce("salts", F.lit(1)), F.col("set") == F.col("hot")
        dealt = sets.join(hot, is_hot, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int")).drop("hot", "salts")
        copies = smallest.join(hot, is_hot, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("hot", "salts")
        out = dealt.join(copies, ["set", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("smallest", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(df: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df`` without those that a smaller doc_id's component holds too.

    All columns stay. Rows of null doc_id stay, and rows that share the doc_id
    which names their component (they are one document).
    """
    gone = materialise(ngram_components(df, k, num, den).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "ngram-gone")
    return df.join(F.broadcast(gone) if _numbers(gone, "doc_id") else gone, "doc_id", "left_anti")
