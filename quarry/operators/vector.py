"""Exact vector search and its joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vector as fn


def nearest(vectors: DataFrame, probe: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k vectors nearest to one probe: a bounded heap in each task, merged."""
    rows = vectors if where is None else vectors.where(where)
    p = F.array(*(F.lit(float(x)) for x in probe))
    return rows.withColumn("score", F.round(fn.cosine(F.col("embedding"), p), 6)).orderBy(F.desc("score"), "vec_id").limit(k)


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of the same space for each query (query_id, space, embedding).

    Lengths are computed once for each vector. Queries are a stated, small set against all rows.
    """
    v = vectors.select("vec_id", "space", "embedding", fn.norm(F.col("embedding")).alias("len"))
    q = queries.select("query_id", "space", F.col("embedding").alias("q"), fn.norm(F.col("embedding")).alias("q_len"))
    scored = v.join(q, "space").select("query_id", "vec_id", F.round(fn.cosine(F.col("embedding"), F.col("q"), F.col("len"), F.col("q_len")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
