"""Queries of vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vector as fn
from quarry.operators import vector as op
from quarry.registry import query
from quarry.sources import concepts as c

COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.read(spark, sf_dir, "embeddings").withColumnRenamed("label", "space")


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round({COS}, 6) AS score FROM embeddings v JOIN embeddings q ON v.label = q.label WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS place FROM s QUALIFY place <= 10""")
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of the same space for each query."""
    v = _vectors(spark, sf_dir)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "space", "embedding")
    return op.search(v, q, 10)


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round({COS}, 6) AS score FROM embeddings v JOIN embeddings q ON v.label = q.label WHERE q.vec_id % 20 = 0),
t AS (SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5)
SELECT t.query_id, t.vec_id, d.doc_id, t.score FROM t JOIN documents d ON d.doc_id % 500 = t.vec_id
QUALIFY row_number() OVER (PARTITION BY t.query_id ORDER BY t.score DESC, t.vec_id, d.doc_id) <= 20""")
def vector_topk_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest texts, then the objects that share them, four times as many at most."""
    from pyspark.sql import Window

    v = _vectors(spark, sf_dir)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "space", "embedding")
    found = op.search(v, q, 5).select("query_id", "vec_id", "score")
    mapped = c.read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 500).alias("vec_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "doc_id")
    return found.join(mapped, "vec_id").withColumn("nr", F.row_number().over(w)).where("nr <= 20").select("query_id", "vec_id", "doc_id", "score")


@query(f"SELECT v.vec_id, round({COS}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE 1 - {COS} < 0.6")
def vector_distance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors within a cosine distance of 0.6 from the first."""
    v = c.read(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    score = fn.cosine(F.col("embedding"), F.col("q"))
    return v.crossJoin(F.broadcast(q)).where(1 - score < 0.6).select("vec_id", F.round(score, 6).alias("score"))  # one row


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), m AS (SELECT t.doc_id, e.vec_id, e.label FROM t LEFT JOIN embeddings e ON t.doc_id = e.vec_id AND e.label = 3)
SELECT doc_id, vec_id, CASE WHEN vec_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS has FROM m""")
def object_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents in one space; documents without one stay."""
    v = c.read(spark, sf_dir, "embeddings").where("label = 3").select("vec_id", F.col("vec_id").alias("doc_id"))
    return c.read(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left").select("doc_id", "vec_id", F.when(F.col("vec_id").isNull(), 0.0).otherwise(1.0).alias("has"))


@query("""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 1), s AS (
  SELECT p.p_partkey, p.p_type, (CASE WHEN contains(lower(p_name), 'ring') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(p_name), 'red') THEN 1.0 ELSE 0.0 END)::DOUBLE / 2 AS lex,
    list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS vec FROM part p LEFT JOIN embeddings e ON p_partkey = vec_id CROSS JOIN q)
SELECT p_partkey, round(0.6::DOUBLE * lex + 0.4::DOUBLE * coalesce(vec, 0) + CASE WHEN p_type <> 'STANDARD' THEN 0.05::DOUBLE ELSE 0 END, 6) AS score FROM s WHERE lex > 0 OR 1 - vec < 0.6 ORDER BY score DESC, p_partkey LIMIT 40""")
def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best forty parts by literal words, vector and kind (the limit is the feature); ``hybrid_search`` has all legs."""
    q = c.read(spark, sf_dir, "embeddings").where("vec_id = 1").select(F.col("embedding").alias("q"))
    e = c.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    has = lambda w: F.when(F.lower("p_name").contains(w), 1.0).otherwise(0.0)
    rows = c.read(spark, sf_dir, "part").join(e, "p_partkey", "left").crossJoin(F.broadcast(q))  # one row
    rows = rows.select("p_partkey", "p_type", ((has("ring") + has("red")) / 2).alias("lex"), fn.cosine(F.col("embedding"), F.col("q")).alias("vec"))
    score = 0.6 * F.col("lex") + 0.4 * F.coalesce("vec", F.lit(0.0)) + F.when(F.col("p_type") != "STANDARD", 0.05).otherwise(0.0)
    return rows.where("lex > 0 or 1 - vec < 0.6").select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(40)
