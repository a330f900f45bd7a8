"""Queries of temporal operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import temporal as op
from quarry.registry import query
from quarry.sources import concepts as c

AT = "1998-01-01"


def _instant() -> Column:
    return F.lit(AT).cast("timestamp_ntz")


@query(c.with_(c.RELATIONS) + f"""
SELECT r.relation_type, r.state, count(*) AS n, round(sum(r.confidence), 2) AS sum_confidence, count(DISTINCT e.c_nationkey) AS nations
FROM relations r JOIN customer e ON r.custkey = e.c_custkey JOIN orders o ON r.relation_id = o.o_orderkey
WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{AT}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}') GROUP BY 1, 2""")
def temporal_edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges valid at an instant with both ends, by type and state."""
    r = op.as_of(c.relations(spark, sf_dir), _instant())
    ends = c.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey")
    orders = c.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation_id"))
    return r.join(orders, "relation_id").join(ends, "custkey").groupBy("relation_type", "state").agg(
        F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("sum_confidence"), F.countDistinct("c_nationkey").alias("nations")
    )


@query(c.with_(c.RELATIONS) + f"""
SELECT relation_id, src, dst, state, confidence, valid_from, valid_to FROM relations
WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{AT}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')""")
def relations_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations valid at an instant, half-open."""
    return op.as_of(c.relations(spark, sf_dir), _instant()).select("relation_id", "src", "dst", "state", "confidence", "valid_from", "valid_to")


@query(c.with_(c.ENTITIES, c.STRUCTURE) + """, first AS (SELECT entity_key FROM entities WHERE entity_type <> 'part' ORDER BY entity_type DESC, entity_key LIMIT 500)
SELECT src, predicate, dst FROM structure WHERE src IN (SELECT entity_key FROM first) AND dst IN (SELECT entity_key FROM first)""")
def graph_induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the first 500 entities (the limit is the feature)."""
    return op.induced(c.entities(spark, sf_dir).where("entity_type <> 'part'"), c.structure(spark, sf_dir), "entity_key", [F.desc("entity_type"), F.asc("entity_key")], 500).select("src", "predicate", "dst")


@query(c.with_(c.RELATIONS) + """
SELECT relation_id, CASE WHEN valid_to IS NOT NULL THEN 'already_closed' WHEN valid_from > TIMESTAMP '1999-01-01' THEN 'before_start' ELSE 'closed' END AS outcome,
  CASE WHEN valid_to IS NULL AND valid_from <= TIMESTAMP '1999-01-01' THEN TIMESTAMP '1999-01-01' ELSE valid_to END AS valid_to FROM relations""")
def invalidate_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded closing of relations."""
    return op.invalidate(c.relations(spark, sf_dir), F.lit("1999-01-01").cast("timestamp_ntz")).select("relation_id", "outcome", "valid_to")


@query(c.with_(c.LAWS) + """
SELECT law_id, article, version_id, effective_from, effective_to FROM laws
WHERE effective_from <= DATE '1999-06-01' AND (effective_to IS NULL OR effective_to >= DATE '1999-06-01')
QUALIFY row_number() OVER (PARTITION BY law_id, article ORDER BY effective_from DESC, version_id DESC) = 1""")
def latest_version_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest article version in force on a day, closed intervals."""
    return op.newest_in_force(c.laws(spark, sf_dir), F.lit("1999-06-01").cast("date"), ["law_id", "article"], "version_id")


@query(c.with_(c.LAWS) + """, points AS (SELECT l_orderkey AS point_id, min(l_shipdate)::DATE AS day FROM lineitem GROUP BY 1),
asked AS (SELECT point_id, day, o_custkey AS law_id, o_orderpriority AS article FROM points JOIN orders ON point_id = o_orderkey),
hits AS (SELECT a.point_id, a.day, a.law_id, a.article, l.version_id, l.effective_from <= a.day AND (l.effective_to IS NULL OR l.effective_to >= a.day) AS inside
  FROM asked a LEFT JOIN laws l ON a.law_id = l.law_id AND a.article = l.article)
SELECT point_id, day, law_id, article, count(*) FILTER (inside) AS matches, CASE WHEN count(*) FILTER (inside) = 1 THEN max(version_id) FILTER (inside) END AS version_id,
  CASE count(*) FILTER (inside) WHEN 0 THEN 'none' WHEN 1 THEN 'resolved' ELSE 'overlapping' END AS reason FROM hits GROUP BY 1, 2, 3, 4""")
def version_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one version in force at each order's first shipment."""
    points = c.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("point_id")).agg(F.min("l_shipdate").cast("date").alias("day"))
    o = c.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("law_id"), F.col("o_orderpriority").alias("article"))
    return op.resolve_version(c.laws(spark, sf_dir), points.join(o, "point_id").select("point_id", "day", "law_id", "article"), ["law_id", "article"], "day")


@query(c.with_(c.RELATIONS) + """
SELECT relation_id, CASE WHEN valid_to <= TIMESTAMP '1998-01-01' THEN false WHEN relation_id % 5 = 0 THEN NULL ELSE valid_from <= TIMESTAMP '1998-01-01' END AS valid FROM relations""")
def undecidable_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued validity where every fifth start is unknown."""
    r = c.relations(spark, sf_dir).withColumn("valid_from", F.when(F.col("relation_id") % 5 != 0, F.col("valid_from")))
    return r.select("relation_id", op.decidable(_instant(), "valid_from", "valid_to").alias("valid"))
