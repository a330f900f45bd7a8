"""Queries of ranking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import ranking as op
from quarry.registry import query
from quarry.sources import concepts as c


@query("SELECT o_custkey AS project, o_orderkey AS work, o_orderdate AS updated_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_work_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order of each customer."""
    rows = c.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("work"), F.col("o_orderdate").alias("updated_at"))
    return op.first_by(rows, ["project"], [F.desc("updated_at"), F.asc("work")])


@query("""SELECT o_custkey AS series, o_orderkey AS revision, row_number() OVER w AS place, lag(o_orderkey) OVER w AS supersedes,
  o_orderkey = last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, predecessor and latest mark of each revision."""
    w = Window.partitionBy("series").orderBy("o_orderdate", "revision")
    rows = c.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("revision"), "o_orderdate")
    return rows.select("series", "revision", F.row_number().over(w).cast("long").alias("place"), F.lag("revision").over(w).alias("supersedes"), F.lead("revision").over(w).isNull().alias("latest"))


@query(c.with_(c.EVIDENCE) + """SELECT relation_id, source_uri, locator, source_id, count(*) OVER (PARTITION BY relation_id) AS total FROM evidence
QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY seen_at, source_uri, locator, source_id) <= 3""")
def evidence_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three evidences of each relation, and how many there are."""
    rows = c.evidence(spark, sf_dir).withColumn("total", F.count("*").over(Window.partitionBy("relation_id")))
    return op.first_by(rows, ["relation_id"], [F.col(x) for x in ("seen_at", "source_uri", "locator", "source_id")], 3).select("relation_id", "source_uri", "locator", "source_id", "total")


RANKS = """ranks AS (
  SELECT u.user_id AS asker, u.source, u.item, u.weight, row_number() OVER (PARTITION BY u.user_id, u.source ORDER BY u.event_id)::BIGINT AS place FROM (
    SELECT user_id, event_id, event_type AS source, (event_id * 7 % 23) AS item,
      CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.7 WHEN 'purchase' THEN 1.2 ELSE 0.6 END::DOUBLE AS weight FROM events) u)"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = c.read(spark, sf_dir, "events")
    weight = F.when(F.col("source") == "click", 1.0).when(F.col("source") == "view", 0.7).when(F.col("source") == "purchase", 1.2).otherwise(0.6)
    rows = e.select(F.col("user_id").alias("asker"), "event_id", F.col("event_type").alias("source"), (F.col("event_id") * 7 % 23).alias("item")).withColumn("weight", weight)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("asker", "source").orderBy("event_id")).cast("long")).drop("event_id")


@query(c.with_(RANKS) + """, first AS (SELECT asker, source, item, min(place) AS place, max(weight) AS weight FROM ranks GROUP BY 1, 2, 3)
SELECT asker, item, round(sum(weight / (60 + place)), 9) AS score, count(*) AS channels FROM first GROUP BY 1, 2""")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rank fusion of channels."""
    return op.fuse(_ranks(spark, sf_dir), ["asker"])


@query(c.with_(RANKS) + """, first AS (SELECT asker, source, item, min(place) AS place, max(weight) AS weight FROM ranks GROUP BY 1, 2, 3),
fused AS (SELECT asker, item, round(sum(weight / (60 + place)), 9) AS s, count(*) AS channels FROM first GROUP BY 1, 2)
SELECT asker, item, channels, round(s * (1 + 0.15::DOUBLE * (channels - 1)), 6) AS score FROM fused""")
def rrf_channel_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank fusion raised by the number of channels."""
    return op.boosted(op.fuse(_ranks(spark, sf_dir), ["asker"])).select("asker", "item", "channels", "score")


@query(c.with_(RANKS) + """, lists AS (SELECT asker, source, list(item ORDER BY place) AS items FROM ranks WHERE place <= 3 GROUP BY 1, 2),
pairs AS (SELECT a.asker, sum(len(list_intersect(a.items, b.items))::DOUBLE / len(list_distinct(list_concat(a.items, b.items)))) AS shared, count(*) AS pairs
  FROM lists a JOIN lists b ON a.asker = b.asker AND a.source < b.source GROUP BY 1),
tops AS (SELECT asker, count(*) AS sources, count(DISTINCT items[1]) AS tops FROM lists GROUP BY 1)
SELECT asker, sources, CASE WHEN sources < 2 THEN 'single_source' WHEN tops = 1 THEN 'confirmed' WHEN shared > 0 THEN 'partial' ELSE 'conflict' END AS verdict,
  round(shared / pairs, 6) AS jaccard FROM tops LEFT JOIN pairs USING (asker)""")
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do channels' first three items agree?"""
    top = _ranks(spark, sf_dir).where("place <= 3").groupBy("asker", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("items"))
    return op.agreement(top, "asker")


@query("""WITH t AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
first AS (SELECT user_id, min(pos) FILTER (event_type = 'purchase') AS rank, user_id % 5 AS grp FROM t GROUP BY user_id)
SELECT grp, count(*) AS queries, count(*) FILTER (rank <= 1) AS hits_1, count(*) FILTER (rank <= 3) AS hits_3, count(*) FILTER (rank <= 10) AS hits_10,
  round(sum(coalesce(1.0::DOUBLE / rank, 0)), 6) AS reciprocal_sum FROM first GROUP BY 1""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates and reciprocal ranks of the first relevant result."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    t = c.read(spark, sf_dir, "events").select("user_id", "event_type", pos.alias("pos"))
    first = t.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("pos"))).alias("rank")).withColumn("grp", F.col("user_id") % 5)
    return op.hits(first, ["grp"], "rank")


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS x FROM events GROUP BY 1)
SELECT event_type, x[round_even(0.5 * (len(x) - 1), 0)::INT + 1] AS p50, x[round_even(0.95 * (len(x) - 1), 0)::INT + 1] AS p95, x[greatest(1, ceil(0.95 * len(x)))::INT] AS gate_p95 FROM s""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by nearest rank, in both roundings."""
    return op.percentiles(c.read(spark, sf_dir, "events"), "event_type", "value", {"p50": (0.5, "nearest"), "p95": (0.95, "nearest"), "gate_p95": (0.95, "ceiling")})


@query("""WITH cases AS (SELECT l_orderkey AS case_id, count(*) AS hits, count(DISTINCT l_partkey) AS distinct_hits, count(DISTINCT l_partkey) FILTER (l_returnflag = 'A') AS found,
  count(*) FILTER (l_returnflag = 'R') AS leaked, count(*) FILTER (l_linestatus = 'F') AS stale FROM lineitem GROUP BY 1)
SELECT count(*) AS cases, round(sum(found::DOUBLE / distinct_hits), 4) AS recall_sum, sum(leaked)::BIGINT AS leaked, sum(stale)::BIGINT AS stale, sum(hits - distinct_hits)::BIGINT AS duplicates,
  count(*) FILTER (leaked = 0) AS clean_cases FROM cases""")
def rag_gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, leakage, staleness and duplicates over benchmark cases."""
    cases = c.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("hits"),
        F.countDistinct("l_partkey").alias("distinct_hits"),
        F.countDistinct(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("found"),
        F.count_if(F.col("l_returnflag") == "R").alias("leaked"),
        F.count_if(F.col("l_linestatus") == "F").alias("stale"),
    )
    return cases.agg(
        F.count("*").alias("cases"),
        F.round(F.sum(F.col("found") / F.col("distinct_hits")), 4).alias("recall_sum"),
        F.sum("leaked").alias("leaked"),
        F.sum("stale").alias("stale"),
        F.sum(F.col("hits") - F.col("distinct_hits")).alias("duplicates"),
        F.count_if(F.col("leaked") == 0).alias("clean_cases"),
    )


@query("""SELECT date_trunc('hour', ts) AS hour, count(*) AS jobs, count(*) FILTER (event_type = 'error') AS failed,
  round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS failure_rate FROM events GROUP BY 1""")
def hourly_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and failure rate by hour."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    failed = F.count_if(F.col("event_type") == "error")
    return c.read(spark, sf_dir, "events").groupBy(hour.alias("hour")).agg(F.count("*").alias("jobs"), failed.alias("failed"), F.round(failed / F.count("*"), 6).alias("failure_rate"))


@query("""SELECT left(regexp_replace(lower(text), '[0-9]+', 'N', 'g'), 120) AS message, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, message LIMIT 5""")
def top_errors_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five messages without their numbers (the limit is the feature)."""
    message = F.left(F.regexp_replace(F.lower("text"), "[0-9]+", "N"), F.lit(120))
    return c.read(spark, sf_dir, "conversations").where("role = 'user'").groupBy(message.alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(5)


@query("""WITH t AS (SELECT user_id, event_type, ts, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS claimed FROM events)
SELECT user_id, ts AS done_at, claimed AS claimed_at, (epoch_us(ts) - epoch_us(claimed))::BIGINT AS micros FROM t WHERE event_type = 'click' AND claimed IS NOT NULL""")
def worker_pairing_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each completion with the last claim before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    t = c.read(spark, sf_dir, "events").withColumn("claimed_at", F.last(F.when(F.col("event_type") == "view", F.col("ts")), ignorenulls=True).over(w))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("claimed_at").cast("timestamp"))
    return t.where("event_type = 'click' and claimed_at is not null").select("user_id", F.col("ts").alias("done_at"), "claimed_at", micros.alias("micros"))
