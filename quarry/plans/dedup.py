"""Queries of dedup operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import dedup as op
from quarry.registry import query
from quarry.sources import concepts as c


@query(c.with_(c.FILES) + """, t AS (SELECT sha256, max(mtime) AS newest FROM files GROUP BY 1), k AS (SELECT *, min(path) OVER (PARTITION BY sha256) AS canonical FROM files WHERE ext IN ('en', 'de'))
SELECT 'doc_' || left(sha256, 24) AS document_id, canonical, coalesce(list_sort(list(DISTINCT path) FILTER (path <> canonical)), []) AS aliases, any_value(newest) AS newest, any_value(bytes) AS bytes
FROM k JOIN t USING (sha256) GROUP BY sha256, canonical""")
def census_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with canonical path, aliases and newest time."""
    return op.census(c.files(spark, sf_dir), "ext in ('en', 'de')")


@query(c.with_(c.FILES) + "SELECT folder, count(*) AS files, sum(bytes)::BIGINT AS bytes, count(DISTINCT sha256) AS contents FROM files GROUP BY 1")
def census_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes by folder."""
    return op.summary(c.files(spark, sf_dir), "folder")


@query(c.with_(c.FILES) + "SELECT sha256, count(*) AS copies, min(path) AS first, (sum(bytes) - max(bytes))::BIGINT AS wasted FROM files GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of several files."""
    return op.duplicate_groups(c.files(spark, sf_dir))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction: the last row of each key."""
    return op.latest_rows(c.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def embeddings_pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no vector yet."""
    return op.pending(c.read(spark, sf_dir, "documents").select("doc_id"), c.read(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 97 NOT IN (SELECT doc_id % 97 FROM labels WHERE quality = 0) AND vec_id > 10")
def vector_gc_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old vectors that no mapping refers to."""
    refs = c.read(spark, sf_dir, "labels").where("quality = 0").select((F.col("doc_id") % 97).alias("ref"))
    vectors = c.read(spark, sf_dir, "embeddings").where("vec_id > 10").select("vec_id", "label", (F.col("vec_id") % 97).alias("ref"))
    return op.pending(vectors, refs, ["ref"]).select("vec_id", "label")


@query("""SELECT DISTINCT l_orderkey AS document FROM lineitem WHERE l_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40))""")
def document_ready_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents all of whose objects have a vector."""
    members = c.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), "l_partkey")
    have = c.read(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return op.complete(members, have, "document", ["l_partkey"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_retailprice + 2 WHEN p_partkey % 3 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price FROM part WHERE p_partkey < 1000
UNION ALL SELECT p_partkey, p_retailprice + CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 1 END FROM part WHERE p_partkey >= 1000 AND p_partkey % 3 = 0""")
def idempotent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New prices replace old ones of the same key; some keys come twice."""
    p = c.read(spark, sf_dir, "part")
    old = p.where("p_partkey < 1000").select("p_partkey", F.col("p_retailprice").alias("price"))
    new = lambda rows, more: p.where(rows).select("p_partkey", (F.col("p_retailprice") + more).alias("price"))
    return op.upsert(old, new("p_partkey % 3 = 0", 1).unionByName(new("p_partkey % 6 = 0", 2)), ["p_partkey"])


@query("""WITH n AS (SELECT p_partkey, p_name, CASE WHEN o.k IS NULL THEN 'created' WHEN o.name = p_name THEN 'unchanged' ELSE 'conflict' END AS outcome
  FROM part LEFT JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'old' ELSE p_name END AS name FROM part WHERE p_partkey % 2 = 0) o ON p_partkey = o.k)
SELECT outcome, count(*) AS n FROM n GROUP BY 1""")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created, unchanged and conflicting articles of an ingest."""
    p = c.read(spark, sf_dir, "part")
    old = p.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "old").otherwise(F.col("p_name")).alias("name"))
    outcome = F.when(F.col("name").isNull(), "created").when(F.col("name") == F.col("p_name"), "unchanged").otherwise("conflict")
    return p.join(old, "p_partkey", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def legacy_id_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts from several suppliers."""
    return op.several_sources(c.read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("""SELECT user_id AS id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE value > 50""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two candidate branches."""
    e = c.read(spark, sf_dir, "events")
    return e.where("event_type = 'purchase'").select(F.col("user_id").alias("id")).union(e.where("value > 50").select("user_id")).distinct()


@query("""SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS place FROM (
  SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2)""")
def ordered_context_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items once each, in the order of their first occurrence."""
    first = c.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
