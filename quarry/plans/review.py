"""Queries of review operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import review as op
from quarry.registry import query
from quarry.sources import concepts as c

LATEST = "latest AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY subject ORDER BY review_rev DESC, created_at DESC, event_id DESC) = 1)"
LEDGER = """votes AS (SELECT unnest(list_distinct(weight_keys)) AS weight_key, effect FROM latest WHERE effect IN ('approve', 'reject')),
ledger AS (SELECT weight_key, count(*) FILTER (effect = 'approve') - count(*) FILTER (effect = 'reject') AS net FROM votes GROUP BY 1)"""


@query(c.with_(c.REVIEWS, LATEST) + "SELECT subject, event_id, effect, review_rev, created_at FROM latest")
def latest_review_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last review event of each subject."""
    return op.latest_events(c.reviews(spark, sf_dir), "subject").select("subject", "event_id", "effect", "review_rev", "created_at")


@query(c.with_(c.REVIEWS, LATEST, LEDGER) + "SELECT weight_key, net, greatest(750, least(1250, 1000 + 50 * net)) AS thousandths FROM ledger")
def review_vote_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net votes and weight of each key."""
    return op.ledger(c.reviews(spark, sf_dir), "subject")


@query(c.with_(c.RELATIONS, c.REVIEWS, LATEST, LEDGER) + """, scored AS (
  SELECT relation_id, valid_from, CASE WHEN relation_id % 11 <> 0 THEN least(1.0, greatest(0.0, confidence)) * CASE WHEN net IS NULL THEN 1000 ELSE greatest(750, least(1250, 1000 + 50 * net)) END / 1000 END AS score
  FROM relations LEFT JOIN ledger ON weight_key = 'user:' || (relation_id % 10) WHERE state = 'unverified')
SELECT relation_id, round(least(1.0, score), 3) AS reported, row_number() OVER (ORDER BY score DESC NULLS FIRST, valid_from, relation_id) AS place FROM scored ORDER BY place LIMIT 100""")
def review_queue_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hundred of the review queue (the limit is the feature)."""
    votes = op.ledger(c.reviews(spark, sf_dir), "subject").select("weight_key", "thousandths")
    rows = c.relations(spark, sf_dir).where("state = 'unverified'").withColumn("weight_key", F.concat(F.lit("user:"), (F.col("relation_id") % 10).cast("string"))).join(votes, "weight_key", "left")
    scored = rows.select("relation_id", F.col("valid_from").alias("created_at"), F.when(F.col("relation_id") % 11 != 0, op.rank_value(F.col("confidence"), F.col("thousandths"))).alias("score"))
    top = scored.orderBy(*op.queue_order()).limit(100)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(*op.queue_order())).cast("long")  # over a hundred rows
    return top.select("relation_id", F.round(F.least(F.lit(1.0), "score"), 3).alias("reported"), place.alias("place"))


@query(c.with_(c.RELATIONS) + """SELECT relation_type, count(*) AS n, count(*) FILTER (state IN ('human_verified', 'machine_verified')) AS verified,
  count(*) FILTER (state = 'unverified') AS unverified, count(*) FILTER (state = 'rejected') AS rejected FROM relations GROUP BY 1""")
def review_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by review bucket."""
    s = F.col("state")
    return c.relations(spark, sf_dir).groupBy("relation_type").agg(
        F.count("*").alias("n"), F.count_if(s.isin("human_verified", "machine_verified")).alias("verified"), F.count_if(s == "unverified").alias("unverified"), F.count_if(s == "rejected").alias("rejected")
    )


@query(c.with_(c.REVIEWS) + """, steps AS (SELECT subject, review_rev, review_rev <= max(review_rev) OVER (PARTITION BY subject ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM reviews)
SELECT subject, count(*) AS decisions, count(*) FILTER (bad) AS inconsistent, max(review_rev) AS version FROM steps GROUP BY 1""")
def decision_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions replayed in order, with those that go back."""
    return op.replay(c.reviews(spark, sf_dir), "subject")


GRAPH = """graph AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS relation_id, 'customer:' || o_custkey AS src, l_returnflag AS type, 'part:' || l_partkey AS dst,
  CASE WHEN l_linestatus = 'F' THEN 'human_verified' ELSE 'unverified' END AS state, l_discount AS confidence, 'order:' || l_orderkey AS uri FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = c.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    text = lambda *parts: F.concat(*(F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(parts)))
    return c.read(spark, sf_dir, "lineitem").join(o, "l_orderkey").select(
        F.concat_ws("-", *(F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("relation_id"),
        text("customer:", "o_custkey").alias("src"),
        F.col("l_returnflag").alias("type"),
        text("part:", "l_partkey").alias("dst"),
        F.when(F.col("l_linestatus") == "F", "human_verified").otherwise("unverified").alias("state"),
        F.col("l_discount").alias("confidence"),
        text("order:", "l_orderkey").alias("uri"),
    )


@query(c.with_(c.ENTITIES, GRAPH) + """, ev AS (SELECT relation_id, string_agg('evidence: ' || uri, chr(10) ORDER BY uri) AS evidence FROM (SELECT DISTINCT relation_id, uri FROM graph) GROUP BY 1)
SELECT 'entity' AS kind, 'kg:entity:' || entity_key AS source_id, 'kg://entity/' || entity_key AS file_path, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, entity_type AS keywords, name || ' (' || entity_type || ')' || chr(10) || 'stable_key: ' || entity_key AS content, NULL::DOUBLE AS weight FROM entities
UNION ALL SELECT 'relation', 'kg:relation:' || g.relation_id, 'kg://relation/' || g.relation_id, src, dst, type,
  s.name || ' --' || type || '--> ' || d.name || chr(10) || 'stable_key: ' || g.relation_id || chr(10) || 'verification_state: ' || state || chr(10) || 'confidence: ' || confidence::VARCHAR || chr(10) || evidence,
  round(least(2.0, 1 + least(1.0, greatest(0.0, coalesce(confidence, 0))) + CASE WHEN state = 'human_verified' THEN 0.25 ELSE 0 END), 6)
FROM graph g JOIN entities s ON src = s.entity_key JOIN entities d ON dst = d.entity_key JOIN ev ON ev.relation_id = g.relation_id WHERE src <> dst""")
def custom_kg_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of entities and weighted relations for a retrieval index."""
    entities = c.entities(spark, sf_dir).select(F.col("entity_key").alias("key"), F.col("entity_type").alias("type"), "name")
    graph = _graph(spark, sf_dir)
    return op.custom_kg(entities, graph, graph)


PROPOSED = """p AS (SELECT o_custkey AS src, l_returnflag AS type, l_suppkey AS dst, l_discount AS confidence, l_partkey AS uri, l_linenumber AS locator, l_quantity, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ents AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0 UNION SELECT s_suppkey FROM supplier),
rel AS (SELECT src, type, dst, min(l_tax) < 0.04 AS candidate, CASE WHEN max(l_tax) < 0.02 THEN 'unverified' ELSE 'human_verified' END AS state, max(confidence) AS held FROM p WHERE l_quantity > 45 GROUP BY 1, 2, 3),
have AS (SELECT DISTINCT src, type, dst, uri, locator FROM p WHERE l_quantity > 45), h AS (SELECT src, type, dst, count(*) AS have FROM have GROUP BY 1, 2, 3),
f AS (SELECT src, type, dst, count(*) AS fresh FROM (SELECT DISTINCT src, type, dst, uri, locator FROM p EXCEPT SELECT * FROM have) GROUP BY 1, 2, 3),
m AS (SELECT src, type, dst, max(confidence) AS proposed FROM p GROUP BY 1, 2, 3),
j AS (SELECT m.*, held, coalesce(have, 0) AS have, coalesce(fresh, 0) AS fresh, CASE WHEN src NOT IN (SELECT key FROM ents) OR dst NOT IN (SELECT key FROM ents) THEN 'unknown endpoint' WHEN type NOT IN ('A', 'R') THEN 'unknown relation type' WHEN src = dst THEN 'typed self-loop'
  WHEN NOT candidate THEN 'relation already exists' WHEN state <> 'unverified' THEN 'already reviewed (' || state || ')' WHEN state IS NULL THEN 'created' ELSE 'updated' END AS outcome
  FROM m LEFT JOIN rel USING (src, type, dst) LEFT JOIN h USING (src, type, dst) LEFT JOIN f USING (src, type, dst)),
k AS (SELECT *, outcome IN ('created', 'updated') AS ok FROM j)"""


@query("WITH " + PROPOSED + """ SELECT src, type, dst, outcome, CASE WHEN ok THEN greatest(proposed, held) END AS confidence, (CASE WHEN ok THEN least(fresh, greatest(0, 25 - have)) ELSE 0 END)::BIGINT AS added,
  (CASE WHEN ok THEN have + least(fresh, greatest(0, 25 - have)) END)::BIGINT AS support FROM k""")
def store_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of customers' relations to suppliers: stored, merged or skipped with a reason."""
    o = c.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    x = c.read(spark, sf_dir, "lineitem").join(o, "l_orderkey")
    p = x.select("src", F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("dst"), F.col("l_discount").alias("confidence"), F.col("l_partkey").alias("uri"), F.col("l_linenumber").alias("locator"), "l_quantity", "l_tax")
    old = p.where("l_quantity > 45")
    state = F.when(F.max("l_tax") < 0.02, "unverified").otherwise("human_verified")
    relations = old.groupBy("src", "type", "dst").agg((F.min("l_tax") < 0.04).alias("candidate"), state.alias("state"), F.max("confidence").alias("confidence"))
    entities = c.read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")).unionByName(c.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")))
    types = spark.createDataFrame([("A",), ("R",)], "type string")
    return op.store(p, entities, types, relations, old)
