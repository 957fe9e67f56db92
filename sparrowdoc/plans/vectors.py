"""Vector and fusion queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowdoc.operators import fusion, lexical, vector
from sparrowdoc.plans import sql
from sparrowdoc.plans.registry import register
from sparrowdoc.sources.tables import load, without_documents

COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def vectors(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings")


def queries(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every id divisible by 20."""
    return vectors(s, d).where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def near(s: SparkSession, d: str, k: int = 10, **more) -> DataFrame:
    return vector.knn(vectors(s, d), queries(s, d), k, **more).withColumn("rank", F.col("rank").cast("long"))


def knn_sql(k: int, least: float = 0.0) -> str:
    return f"""SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round({COS.format(a="q.embedding", b="v.embedding")}, 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a="q.embedding", b="v.embedding")}, 6) DESC, v.vec_id) AS rank
 FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= {k} AND score >= {least}"""


register("knn_exact", near, knn_sql(10))
register("vector_threshold", lambda s, d: near(s, d, 10, threshold=0.35), knn_sql(10, 0.35))
register(
    "cosine_pairs",
    lambda s, d: (lambda v: v.alias("a").join(v.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(vector.cosine(vector.doubles(F.col("a.embedding")), vector.doubles(F.col("b.embedding"))), 6).alias("cosine")))(vectors(s, d)),
    f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
register(
    "vector_normalize",
    lambda s, d: vectors(s, d).select("vec_id", vector.normalised(vector.doubles(F.transform("embedding", lambda x: x * 3))).alias("e")).select("vec_id", F.round(vector.norm(F.col("e")), 6).alias("norm"), F.round(F.element_at("e", 1), 6).alias("first")),
    "SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(e[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS e FROM embeddings)",
)
register(
    "vector_stats",
    lambda s, d: vectors(s, d).agg(F.count("*").alias("n_vectors"), F.countDistinct("label").alias("n_labels"), F.max(F.size("embedding")).cast("long").alias("dims")),
    "SELECT count(*) AS n_vectors, count(DISTINCT label) AS n_labels, max(len(embedding)) AS dims FROM embeddings",
)
register(
    "embedding_dim_check",
    lambda s, d: vectors(s, d).select("vec_id", (F.size("embedding") == 64).alias("fits")).groupBy("fits").agg(F.count("*").alias("n")),
    "SELECT len(embedding) = 64 AS fits, count(*) AS n FROM embeddings GROUP BY 1",
)
register(
    "embedding_cache_misses",
    lambda s, d: (lambda t: t.select("doc_id", F.sha2("text", 256).alias("key")).join(t.where(F.col("lang") == "en").select(F.sha2("text", 256).alias("key")).distinct(), "key", "left_anti").select("doc_id", "key"))(load(s, d, "documents")),
    "SELECT doc_id, sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')",
)
register(
    "delete_document",
    lambda s, d: without_documents(vectors(s, d).withColumnRenamed("vec_id", "doc_id"), load(s, d, "labels").where("toxic = 1")).select("doc_id", "label"),
    "SELECT vec_id AS doc_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
register(
    "hash_embedding",
    lambda s, d: load(s, d, "documents").select("doc_id", vector.hash_embedding(F.col("text"), 8).alias("e")).select("doc_id", *[F.round(F.element_at("e", i), 3).alias(f"e{i}") for i in (1, 8)]),
    "SELECT doc_id, round(((h + 0) % 1000) / 1000.0, 3) AS e1, round(((h + 7) % 1000) / 1000.0, 3) AS e8 FROM (SELECT doc_id, (('0x' || substr(md5(text), 1, 8))::BIGINT % 1000000) AS h FROM documents)",
)


def probed(s: SparkSession, d: str) -> DataFrame:
    """Neighbours by 13 of 64 trained cells; every vector is filed in its three nearest."""
    v = vectors(s, d).select("vec_id", "embedding")
    centres = vector.train_cells(v)
    return vector.knn(vector.in_cells(v, centres, 3), vector.in_cells(queries(s, d), centres, 13), 10, by_cell=True).withColumn("rank", F.col("rank").cast("long"))


register("knn_ivf", probed)


def topics(s: SparkSession, d: str) -> DataFrame:
    m = vector.mean_vectors(vectors(s, d), "label")
    # One row a label on either side.
    pairs = m.alias("a").join(m.alias("b"), F.col("a.label") < F.col("b.label"))
    sim = F.round(vector.cosine(F.col("a.embedding"), F.col("b.embedding")), 6)
    return pairs.select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), sim.alias("similarity")).withColumn("level", F.when(F.col("similarity") > 0.7, "high").when(F.col("similarity") > 0.4, "medium").otherwise("low"))


register(
    "topic_similarity",
    topics,
    f"""WITH flat AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
 m AS (SELECT label, list(x ORDER BY pos) AS e FROM (SELECT label, pos, avg(x) AS x FROM flat GROUP BY label, pos) GROUP BY label)
SELECT a, b, similarity, CASE WHEN similarity > 0.7 THEN 'high' WHEN similarity > 0.4 THEN 'medium' ELSE 'low' END AS level
FROM (SELECT a.label AS a, b.label AS b, round({COS.format(a='a.e', b='b.e')}, 6) AS similarity FROM m a JOIN m b ON a.label < b.label)""",
)

# ---- fusion: neighbours of a vector, and BM25 for the first words of its document


def semantic_list(s: SparkSession, d: str) -> DataFrame:
    lengths = load(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.char_length("text").alias("length"))
    return near(s, d).join(lengths, "vec_id").select("query_id", F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_id"), "score", "length")


def keyword_list(s: SparkSession, d: str) -> DataFrame:
    docs = load(s, d, "documents")
    asked = queries(s, d).select(F.col("query_id").alias("doc_id")).join(docs, "doc_id").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("question"))
    found = lexical.search(lexical.as_chunks(docs), asked, 10)
    return found.join(docs.select("doc_id", F.char_length("text").alias("length")), "doc_id").select("query_id", "doc_id", "chunk_id", "score", "length")


def _lists_sql() -> str:
    from sparrowdoc.plans.lexical import BASE, BM25, HITS

    return f"""{BASE}, {HITS},
q AS (SELECT doc_id AS query_id, unnest({sql.content_terms("array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ')")}) AS term FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0)),
qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM base),
hits AS (SELECT term, doc_id, chunk_id, dl, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(({BM25}) * times), 6) AS score FROM hits JOIN dfs USING (term) JOIN qt USING (term) CROSS JOIN stats GROUP BY query_id, doc_id),
lens AS (SELECT doc_id, length(text) AS length FROM documents),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0) JOIN lens USING (doc_id) WHERE r <= 10),
s AS (SELECT query_id, vec_id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r, length FROM ({knn_sql(10)}) JOIN lens ON vec_id = doc_id),
su AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS unit, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY query_id)),
ku AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS unit, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY query_id)),
qs AS (SELECT query_id, (CASE WHEN count(*) = 1 THEN 0.5 ELSE least(var_pop(score), 1.0) END + least(avg(length) / 500, 1.0) + least(count(*) / 10, 1.0)) / 3 AS quality FROM s GROUP BY query_id),
qk AS (SELECT query_id, (CASE WHEN count(*) = 1 THEN 0.5 ELSE least(var_pop(score), 1.0) END + least(avg(length) / 500, 1.0) + least(count(*) / 10, 1.0)) / 3 AS quality FROM k GROUP BY query_id),
f AS (SELECT coalesce(su.query_id, ku.query_id) AS query_id, coalesce(su.doc_id, ku.doc_id) AS doc_id, su.score AS ss, ku.score AS ks, su.r AS sr, ku.r AS kr, su.unit AS sunit, ku.unit AS kunit FROM su FULL OUTER JOIN ku ON su.query_id = ku.query_id AND su.doc_id = ku.doc_id),
g AS (SELECT f.*, coalesce((SELECT count(*) FROM s WHERE s.query_id = f.query_id), 0) AS sn, coalesce((SELECT count(*) FROM k WHERE k.query_id = f.query_id), 0) AS kn, coalesce(qs.quality, 0.0) AS qs, coalesce(qk.quality, 0.0) AS qk FROM f LEFT JOIN qs ON qs.query_id = f.query_id LEFT JOIN qk ON qk.query_id = f.query_id)"""


def _fused_sql(a: str, b: str, ws: str = "0.6", wk: str = "0.4") -> str:
    return f"WITH {_lists_sql()} SELECT query_id, doc_id, 0 AS chunk_id, round(CASE WHEN kn = 0 THEN ss WHEN sn = 0 THEN ks ELSE coalesce(({a}) * ({ws}), 0) + coalesce(({b}) * ({wk}), 0) END, 6) AS score FROM g"


_RANK = ("1.0 / (60 + sr)", "1.0 / (60 + kr)")
_SQL = {
    "rrf": _fused_sql(*_RANK),
    "weighted": _fused_sql("sunit", "kunit"),
    "borda": _fused_sql("sn - sr + 1", "kn - kr + 1"),
    "combsum": _fused_sql("sunit", "kunit"),
    "adaptive": _fused_sql(*_RANK, "CASE WHEN qs + qk > 0 THEN 2 * qs / (qs + qk) ELSE 0.6 END", "CASE WHEN qs + qk > 0 THEN 2 * qk / (qs + qk) ELSE 0.4 END"),
}
for _m, _q in _SQL.items():
    register(f"fuse_{_m}", lambda s, d, m=_m: fusion.fuse(semantic_list(s, d), keyword_list(s, d), m), _q)
register(
    "result_quality",
    lambda s, d: fusion.quality(keyword_list(s, d)).withColumn("quality", F.round("quality", 6)),
    f"WITH {_lists_sql()} SELECT query_id, round(quality, 6) AS quality FROM qk",
)
register(
    "minmax_scores",
    lambda s, d: fusion.minmax(keyword_list(s, d)).withColumn("unit", F.round("unit", 6)),
    f"WITH {_lists_sql()} SELECT query_id, doc_id, 0 AS chunk_id, score, round(unit, 6) AS unit FROM ku",
)


def running(s: SparkSession, d: str) -> DataFrame:
    """Mean of an event type's values so far."""
    so_far = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(s, d, "events").select("event_type", "event_id", (F.round(F.sum("value").over(so_far), 4) / F.count("value").over(so_far)).alias("running"))


register(
    "running_average",
    running,
    "SELECT event_type, event_id, round(sum(value) OVER w, 4) / count(value) OVER w AS running FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
)
register(
    "dedupe_best",
    lambda s, d: fusion.best_of(semantic_list(s, d).select("query_id", "doc_id", "chunk_id", F.col("score"), F.lit(1).alias("ord")).unionByName(keyword_list(s, d).select("query_id", "doc_id", "chunk_id", F.round(F.col("score") / 10, 6).alias("score"), F.lit(2).alias("ord")))),
    f"WITH {_lists_sql()} SELECT query_id, doc_id, 0 AS chunk_id, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, ord) AS n FROM (SELECT query_id, doc_id, score, 1 AS ord FROM s UNION ALL SELECT query_id, doc_id, round(score / 10, 6), 2 FROM k)) WHERE n = 1",
)
register(
    "similar_documents",
    lambda s, d: near(s, d, 5).withColumnRenamed("vec_id", "doc_id").join(load(s, d, "documents").select("doc_id", "lang"), "doc_id"),
    f"SELECT query_id, doc_id, score, rank, lang FROM (SELECT query_id, vec_id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({knn_sql(10)})) JOIN documents USING (doc_id) WHERE rank <= 5",
)
