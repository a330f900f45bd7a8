"""Concept tables derived from the provided ones: one function and one SQL fragment for each, saying the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes: key, type and name."""
    parts = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))
    each = [read(spark, sf_dir, t).select(F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias("entity_key"), F.lit(t).alias("entity_type"), F.col(n).alias("name")) for t, k, n in parts]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


ENTITIES = """entities AS (
  SELECT 'region:' || r_regionkey AS entity_key, 'region' AS entity_type, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part)"""


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PART_OF edges, valid without bounds."""
    edge = lambda t, a, b, to: read(spark, sf_dir, t).select(F.concat(F.lit(f"{t}:"), F.col(a).cast("string")).alias("src"), F.lit("PART_OF").alias("predicate"), F.concat(F.lit(f"{to}:"), F.col(b).cast("string")).alias("dst"))
    return edge("nation", "n_nationkey", "n_regionkey", "region").unionByName(edge("customer", "c_custkey", "c_nationkey", "nation")).unionByName(edge("supplier", "s_suppkey", "s_nationkey", "nation"))


STRUCTURE = """structure AS (
  SELECT 'nation:' || n_nationkey AS src, 'PART_OF' AS predicate, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'PART_OF', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'PART_OF', 'nation:' || s_nationkey FROM supplier)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal edges from customers to their orders, with state and confidence."""
    o = read(spark, sf_dir, "orders")
    end = F.col("o_orderdate") + F.make_dt_interval(F.col("o_orderkey") % 400)
    return o.select(
        F.col("o_orderkey").alias("relation_id"),
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("dst"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderpriority").alias("relation_type"),
        F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("o_orderkey") % 7 != 0, end).alias("valid_to"),
        F.when(F.col("o_orderstatus") == "F", "human_verified").when(F.col("o_orderstatus") == "O", "unverified").otherwise("machine_verified").alias("state"),
        ((F.col("o_orderkey") % 101) / 100.0).alias("confidence"),
    )


RELATIONS = """relations AS (
  SELECT o_orderkey AS relation_id, 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, o_custkey AS custkey,
    o_orderpriority AS relation_type, o_orderdate AS valid_from,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_days((o_orderkey % 400)::INT) END AS valid_to,
    CASE o_orderstatus WHEN 'F' THEN 'human_verified' WHEN 'O' THEN 'unverified' ELSE 'machine_verified' END AS state,
    (o_orderkey % 101) / 100.0::DOUBLE AS confidence FROM orders)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for relations, one for each line."""
    x = read(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_returnflag") == "A", "human_verified").when(F.col("l_returnflag") == "N", "unverified").otherwise("rejected")
    return x.select(
        F.col("l_orderkey").alias("relation_id"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("source_uri"),
        F.col("l_linenumber").cast("long").alias("locator"),
        F.col("l_suppkey").alias("source_id"),
        state.alias("state"),
        F.col("l_quantity").alias("value"),
        F.col("l_shipdate").alias("seen_at"),
    )


EVIDENCE = """evidence AS (
  SELECT l_orderkey AS relation_id, 'part:' || l_partkey AS source_uri, l_linenumber::BIGINT AS locator, l_suppkey AS source_id,
    CASE l_returnflag WHEN 'A' THEN 'human_verified' WHEN 'N' THEN 'unverified' ELSE 'rejected' END AS state,
    l_quantity AS value, l_shipdate AS seen_at FROM lineitem)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogued elements: kind, block, layer, document and whether a model inferred them."""
    x, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return x.join(p, x["l_partkey"] == p["p_partkey"]).select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("object_id"),
        F.col("l_orderkey").alias("document"),
        F.col("p_type").alias("kind"),
        F.col("p_brand").alias("block"),
        F.col("l_returnflag").alias("layer"),
        F.when(F.col("l_linestatus") == "F", "AI_INFERRED").otherwise("OBSERVED").alias("state"),
        F.col("p_name").alias("label"),
        F.col("l_quantity").alias("quantity"),
        F.col("p_size").alias("size"),
    )


OBJECTS = """objects AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS object_id, l_orderkey AS document, p_type AS kind,
    p_brand AS block, l_returnflag AS layer, CASE WHEN l_linestatus = 'F' THEN 'AI_INFERRED' ELSE 'OBSERVED' END AS state,
    p_name AS label, l_quantity AS quantity, p_size AS size FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A census of files: path, folder, extension, size, time and content hash."""
    return read(spark, sf_dir, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"),
        F.col("source").alias("folder"),
        F.col("lang").alias("ext"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.col("doc_id").alias("mtime"),
        F.sha2("text", 256).alias("sha256"),
    )


FILES = """files AS (
  SELECT source || '/' || doc_id || '.' || lang AS path, source AS folder, lang AS ext, strlen(text)::BIGINT AS bytes,
    doc_id AS mtime, sha256(text) AS sha256 FROM documents)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review events: subject, effect, revision and weight keys."""
    return as_reviews(read(spark, sf_dir, "events"))


def as_reviews(events: DataFrame) -> DataFrame:
    """Events, in a batch or a stream, as review events."""
    return events.select(
        "event_id",
        F.col("user_id").alias("subject"),
        F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").otherwise("none").alias("effect"),
        F.get_json_object("props", "$.k").cast("int").alias("review_rev"),
        F.col("ts").alias("created_at"),
        F.array(F.concat(F.lit("day:"), F.dayofmonth("ts").cast("string")), F.concat(F.lit("user:"), (F.col("user_id") % 10).cast("string"))).alias("weight_keys"),
    )


REVIEWS = """reviews AS (
  SELECT event_id, user_id AS subject, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'none' END AS effect,
    (props->>'$.k')::INT AS review_rev, ts AS created_at,
    ['day:' || day(ts), 'user:' || (user_id % 10)] AS weight_keys FROM events)"""


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article versions: closed intervals, the last one open."""
    o = read(spark, sf_dir, "orders")
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_custkey").alias("law_id"),
        F.col("o_orderpriority").alias("article"),
        F.col("o_orderkey").alias("version_id"),
        F.col("o_orderdate").cast("date").alias("effective_from"),
        F.date_sub(F.lead("o_orderdate").over(w).cast("date"), 1).alias("effective_to"),
    )


LAWS = """laws AS (
  SELECT o_custkey AS law_id, o_orderpriority AS article, o_orderkey AS version_id, o_orderdate::DATE AS effective_from,
    (lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey))::DATE - 1 AS effective_to FROM orders)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal facts; several values for one subject and path occur."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("fact_id"),
        F.col("l_orderkey").alias("subject"),
        F.concat(F.lit("p."), F.col("l_linenumber").cast("string")).alias("path"),
        F.col("l_quantity").alias("value"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_suppkey")).alias("evidence"),
        F.when(F.col("l_returnflag") == "R", "DISPUTED").when(F.col("l_discount") == 0, "UNKNOWN").otherwise("OBSERVED").alias("status"),
        F.col("l_shipdate").alias("recorded_at"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate") + F.make_dt_interval(F.col("l_partkey") % 900)).alias("superseded_at"),
        F.when(F.col("l_partkey") % 11 != 0, F.date_sub(F.col("l_shipdate").cast("date"), (F.col("l_suppkey") % 300).cast("int"))).alias("valid_from"),
        F.when(F.col("l_partkey") % 5 == 0, F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_partkey") % 700).cast("int"))).alias("valid_to"),
    )


FACTS = """facts AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id, l_orderkey AS subject, 'p.' || l_linenumber AS path,
    l_quantity AS value, CASE WHEN l_partkey % 13 <> 0 THEN l_suppkey END AS evidence,
    CASE WHEN l_returnflag = 'R' THEN 'DISPUTED' WHEN l_discount = 0 THEN 'UNKNOWN' ELSE 'OBSERVED' END AS status,
    l_shipdate AS recorded_at, CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_days((l_partkey % 900)::INT) END AS superseded_at,
    CASE WHEN l_partkey % 11 <> 0 THEN l_shipdate::DATE - (l_suppkey % 300)::INT END AS valid_from,
    CASE WHEN l_partkey % 5 = 0 THEN l_shipdate::DATE + (l_partkey % 700)::INT END AS valid_to FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes on a plan for each brand."""
    p = read(spark, sf_dir, "part")
    x, y = (F.col("p_partkey") * 17 % 1009).cast("double"), (F.col("p_partkey") * 31 % 997).cast("double")
    return p.select(F.col("p_partkey").alias("box_id"), F.col("p_brand").alias("plan"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size")).alias("x1"), (y + F.col("p_size") % 7 + 1).alias("y1"))


BOXES = """boxes AS (
  SELECT p_partkey AS box_id, p_brand AS plan, (p_partkey * 17 % 1009)::DOUBLE AS x0, (p_partkey * 31 % 997)::DOUBLE AS y0,
    (p_partkey * 17 % 1009)::DOUBLE + p_size AS x1, (p_partkey * 31 % 997)::DOUBLE + p_size % 7 + 1 AS y1 FROM part)"""


def with_(*parts: str) -> str:
    """A WITH clause of fragments."""
    return "WITH " + ",\n".join(parts) + "\n"
