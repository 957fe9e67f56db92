"""Vector table: normalisation, exact and probed nearest neighbours, pooling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors sent to the tasks, or dealt to a group of vectors, at most.
QUERY_BLOCK = 4096
#: Vectors of a group, and queries multiplied with them at a time.
GROUP_VECTORS, SCORED_QUERIES = 16_384, 256


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in -1..1; 0 if a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.when(size == 0, 1.0).otherwise(size))))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def hash_embedding(text: Column, dims: int = 16) -> Column:
    """Stand-in embedding that every engine can repeat: from the text's MD5."""
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 1_000_000
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.pmod(h + i, F.lit(1000)) / 1000.0)


def _unit(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the places of a pandas column's usable vectors, and these at length 1."""
    held: dict[int, list[int]] = {}
    for i, e in enumerate(column):
        if e is not None and len(e):
            held.setdefault(len(e), []).append(i)
    out = {}
    for dims, at in held.items():
        v = np.stack([np.asarray(column.iloc[i], dtype=float) for i in at])
        size = np.linalg.norm(v, axis=1, keepdims=True)
        good = (size > 0).ravel() & np.isfinite(size).ravel()
        if good.any():
            out[dims] = np.array(at)[good], v[good] / size[good]
    return out


def _best(vectors, queries, top_k: int, least: float):
    """The ``top_k`` best rows of one pandas frame for each query of another, as a frame."""
    import pandas as pd

    vectors = vectors.sort_values("vec_id", kind="stable")  # equal scores go by id
    ours, asked, parts = _unit(vectors["embedding"]), _unit(queries["embedding"]), []
    for dims in ours.keys() & asked.keys():
        (at, v), (places, q) = ours[dims], asked[dims]
        for start in range(0, len(q), SCORED_QUERIES):
            score = np.clip(v @ q[start : start + SCORED_QUERIES].T, -1, 1).round(6)
            order = np.argsort(-score, axis=0, kind="stable")[:top_k]
            best = np.take_along_axis(score, order, axis=0)
            row, j = np.nonzero(best >= least)
            parts.append(
                pd.DataFrame({"query_id": queries["query_id"].to_numpy()[places[start + j]], "vec_id": vectors["vec_id"].to_numpy()[at[order[row, j]]], "score": best[row, j]})
            )
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": queries["query_id"][:0], "vec_id": vectors["vec_id"][:0], "score": np.zeros(0)})


def knn(vectors: DataFrame, queries: DataFrame, top_k: int = 10, threshold: float = 0.0, by_cell: bool = False, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): the nearest vectors of each query by cosine.

    ``vectors(vec_id, embedding)``, ``queries(query_id, embedding)``, ids of any
    type; with ``by_cell`` both have a ``cell`` (a row for each cell a vector is
    filed under or a query looks at) and only rows of one cell meet. Up to
    ``query_block`` queries are sent to the tasks, where a batch of vectors meets
    all of them; more, or cells, are dealt with the vectors to groups of bounded
    size. Either way a group keeps its own best ``top_k``. Ties go to the smaller
    vec_id. Null, empty, zero or unfinite vectors, null ids and vectors of
    another dimension match nothing.
    """
    cell = ["cell"] if by_cell else []
    v = vectors.where("embedding is not null and vec_id is not null").select("vec_id", "embedding", *cell)
    q = queries.where("embedding is not null and query_id is not null").select("query_id", "embedding", *cell)
    types = f"query_id {q.schema['query_id'].dataType.simpleString()}, vec_id {v.schema['vec_id'].dataType.simpleString()}, score double"
    few = None if by_cell else q.limit(query_block + 1).toPandas()
    if few is not None and len(few) <= query_block:
        sent = v.sparkSession.sparkContext.broadcast(few)

        def work(frames):
            for pdf in frames:
                yield _best(pdf, sent.value, top_k, max(threshold, -1))

        found = v.mapInPandas(work, types)
    else:
        found = _dealt(v if by_cell else v.withColumn("cell", F.lit(0)), q if by_cell else q.withColumn("cell", F.lit(0)), types, top_k, max(threshold, -1), query_block)
    if by_cell:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def _dealt(v: DataFrame, q: DataFrame, types: str, top_k: int, least: float, query_block: int) -> DataFrame:
    """Best rows by groups of about ``GROUP_VECTORS`` vectors and ``query_block`` queries of a cell.

    A cell with more vectors has lanes that every query of it visits, one with
    more queries has blocks that every vector of it visits.
    """
    lanes = v.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_VECTORS).cast("int").alias("lanes"))
    blocks = q.groupBy("cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
    shape = F.broadcast(lanes.join(blocks, "cell"))  # a row a cell
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = v.join(shape, "cell").withColumn("lane", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("lanes")).cast("int")).withColumn("block", upto("blocks"))
    q = q.join(shape, "cell").withColumn("block", F.pmod(F.xxhash64("query_id", "embedding"), F.col("blocks")).cast("int")).withColumn("lane", upto("lanes"))
    key = ["cell", "lane", "block"]
    # Named anew, so that queries taken from the vectors have columns of their own.
    q = q.select(*[F.col(c).alias(c) for c in (*key, "query_id", "embedding")])
    return v.select(*key, "vec_id", "embedding").groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(lambda a, b: _best(a, b, top_k, least), types)


def train_cells(vectors: DataFrame, n_cells: int = 64, sample_rows: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Unit centres of at most ``n_cells`` cells, by k-means on at most ``sample_rows`` vectors, taken by the hash of their id.

    Vectors of the sample's most frequent dimension count; no usable vector, no cells.
    """
    sample = vectors.where("embedding is not null and vec_id is not null").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    held = _unit(sample["embedding"])
    if not held:
        return np.zeros((0, 0))
    v = max(held.values(), key=lambda x: x[1].shape)[1]
    centres = v[np.linspace(0, len(v) - 1, min(n_cells, len(v))).astype(int)]
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def in_cells(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """A row with ``cell`` for each of the ``n`` nearest cells of a row's ``embedding``, nearest first; without usable vector, or of another dimension, none."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def work(frames):
        for pdf in frames:
            at, v = _unit(pdf["embedding"]).get(centres.shape[1], (np.zeros(0, int), np.zeros((0, centres.shape[1]))))
            cells = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :n]
            out = pdf.iloc[np.repeat(at, cells.shape[1])].copy()
            out["cell"] = cells.ravel().astype("int32")
            yield out

    return df.mapInPandas(work, f"{kinds}, cell int")


def mean_vectors(vectors: DataFrame, by: str) -> DataFrame:
    """(by, embedding): the mean vector of each group."""
    flat = vectors.where(F.col("embedding").isNotNull()).select(by, F.posexplode(doubles(F.col("embedding"))).alias("pos", "x"))
    return flat.groupBy(by, "pos").agg(F.avg("x").alias("x")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(by, F.transform("v", lambda s: s["x"]).alias("embedding"))
