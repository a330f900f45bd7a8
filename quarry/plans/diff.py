"""Queries of difference operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import diff as op
from quarry.registry import query
from quarry.sources import concepts as c

STATES = """old AS (SELECT p_partkey AS id, p_brand AS brand, p_size AS size, p_name AS name FROM part WHERE p_partkey % 11 <> 0),
new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'Brand#X' ELSE p_brand END AS brand, p_size + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS size, p_name AS name FROM part WHERE p_partkey % 13 <> 0)"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = c.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    new = p.where("id % 13 <> 0").withColumn("brand", F.when(F.col("id") % 6 == 0, "Brand#X").otherwise(F.col("brand"))).withColumn("size", F.col("size") + F.when(F.col("id") % 10 == 0, 1).otherwise(0))
    return p.where("id % 11 <> 0"), new


@query(c.with_(STATES) + """SELECT id, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.brand <> n.brand OR o.size <> n.size THEN 'changed' ELSE 'unchanged' END AS state,
  CASE WHEN o.name IS NULL OR n.name IS NULL THEN [] ELSE list_concat(CASE WHEN o.brand <> n.brand THEN ['brand'] ELSE [] END, CASE WHEN o.size <> n.size THEN ['size'] ELSE [] END) END AS fields FROM old o FULL JOIN new n USING (id)""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed objects of two snapshots."""
    old, new = _states(spark, sf_dir)
    return op.compare(old, new, "id", ["brand", "size"])


@query(c.with_(c.BOXES) + """, n AS (SELECT box_id, x0 + CASE WHEN box_id % 4 = 0 THEN 3 ELSE 0 END AS u0, y0 AS v0, x1 + CASE WHEN box_id % 4 = 0 THEN 3 ELSE 0 END + CASE WHEN box_id % 10 = 1 THEN 2 ELSE 0 END AS u1, y1 AS v1 FROM boxes)
SELECT box_id, box_id % 4 = 0 AS moved, box_id % 10 = 1 AS resized FROM boxes JOIN n USING (box_id) WHERE box_id % 4 = 0 OR box_id % 10 = 1""")
def moved_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that moved or changed their dimensions."""
    b = c.boxes(spark, sf_dir)
    k = F.col("box_id")
    shift, grow = F.when(k % 4 == 0, 3).otherwise(0), F.when(k % 10 == 1, 2).otherwise(0)
    n = b.select("box_id", (F.col("x0") + shift).alias("u0"), F.col("y0").alias("v0"), (F.col("x1") + shift + grow).alias("u1"), F.col("y1").alias("v1"))
    moved, resized = op.moved(*(F.col(x) for x in ("x0", "y0", "x1", "y1", "u0", "v0", "u1", "v1")))
    return b.join(n, "box_id").select("box_id", moved.alias("moved"), resized.alias("resized")).where("moved or resized")


@query("""WITH a AS (SELECT p_type AS label, count(*) AS left_n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), b AS (SELECT p_type AS label, count(*) AS right_n FROM part WHERE p_size > 20 GROUP BY 1)
SELECT label, coalesce(left_n, 0) AS left_n, coalesce(right_n, 0) AS right_n, coalesce(right_n, 0) - coalesce(left_n, 0) AS delta FROM a FULL JOIN b USING (label)""")
def inventory_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of two inventories by count."""
    p = c.read(spark, sf_dir, "part").withColumnRenamed("p_type", "label")
    return op.counts(p.where("p_partkey % 3 = 0"), p.where("p_size > 20"), "label")


@query("""WITH l AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE doc_id % 9 <> 0), r AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS d FROM documents WHERE doc_id % 8 <> 0)
SELECT doc_id, CASE WHEN r.d IS NULL THEN 'missing' WHEN l.d IS NULL THEN 'extra' WHEN l.d <> r.d THEN 'stale' ELSE 'current' END AS state FROM l FULL JOIN r USING (doc_id)""")
def inventory_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, extra and stale rows of a remote inventory."""
    d = c.read(spark, sf_dir, "documents").select("doc_id", "text")
    local = d.where("doc_id % 9 <> 0").select("doc_id", F.sha2("text", 256).alias("d"))
    remote = d.where("doc_id % 8 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("d"))
    return op.reconcile(local, remote, "doc_id", "d")


@query("""SELECT o_custkey, sha256(concat_ws(':', count(*), sum(('0x' || substr(x, 1, 15))::BIGINT::HUGEINT), sum(('0x' || substr(x, 17, 15))::BIGINT::HUGEINT))) AS digest FROM (SELECT o_custkey, md5(concat_ws('|', o_orderkey, o_orderstatus)) AS x FROM orders) GROUP BY 1""")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each customer's orders, whatever their order."""
    return op.digest(c.read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"])


@query("""SELECT p_partkey FROM part WHERE p_size < 25 INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49""")
def id_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference of id sets."""
    x = c.read(spark, sf_dir, "lineitem")
    ids = c.read(spark, sf_dir, "part").where("p_size < 25").select("p_partkey")
    return ids.intersect(x.where("l_returnflag = 'R'").select("l_partkey")).subtract(x.where("l_quantity > 49").select("l_partkey"))
