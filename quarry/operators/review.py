"""Review decisions, vote ledgers and the proposal queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neutral weight, step of a vote, and bounds, in thousandths.
NEUTRAL, STEP, LEAST, MOST = 1000, 50, 750, 1250


def latest_events(events: DataFrame, by: str) -> DataFrame:
    """The last event of each subject: by revision, then those with a time, then time and id."""
    order = [F.desc("review_rev"), F.desc(F.col("created_at").isNotNull()), F.desc_nulls_last("created_at"), F.desc("event_id")]
    return events.withColumn("__nr", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__nr = 1").drop("__nr")


def ledger(events: DataFrame, by: str) -> DataFrame:
    """Net votes and weight of each key: only a subject's last event votes, once for each of its distinct keys."""
    votes = latest_events(events, by).where("effect in ('approve', 'reject')").select(F.explode(F.array_distinct("weight_keys")).alias("weight_key"), "effect")
    net = F.count_if(F.col("effect") == "approve") - F.count_if(F.col("effect") == "reject")
    weight = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.lit(NEUTRAL) + STEP * F.col("net")))
    return votes.groupBy("weight_key").agg(net.alias("net")).withColumn("thousandths", weight)


def rank_value(confidence: Column, thousandths: Column) -> Column:
    """Confidence within 0 and 1 times the weight of the first key."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * F.coalesce(thousandths, F.lit(NEUTRAL)) / 1000


def queue_order() -> list[Column]:
    """Unscored first, then by score, time and id."""
    return [F.desc_nulls_first("score"), F.asc_nulls_last("created_at"), F.asc("relation_id")]


def relation_weight(confidence: Column, state: Column) -> Column:
    """Weight of a projected relation: 1 plus confidence, more if a human verified it, 2 at most."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    return F.least(F.lit(2.0), 1 + conf + F.when(state == "human_verified", 0.25).otherwise(0.0))


def replay(events: DataFrame, by: str) -> DataFrame:
    """Versions after each subject's decisions: one that repeats a revision or goes back is inconsistent."""
    w = Window.partitionBy(by).orderBy("created_at", "event_id")
    before = F.max("review_rev").over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = events.withColumn("__bad", F.col("review_rev") <= before)
    return steps.groupBy(by).agg(F.count("*").alias("decisions"), F.count_if("__bad").alias("inconsistent"), F.max("review_rev").alias("version"))


def store(proposals: DataFrame, entities: DataFrame, types: DataFrame, relations: DataFrame, evidence: DataFrame, keep: int = 25) -> DataFrame:
    """What becomes of proposals, a row for each (src, type, dst): outcome, confidence, evidence added and support.

    ``proposals`` has a row for each span (src, type, dst, confidence, uri, locator); entities (key), types (type), relations
    (src, type, dst, candidate, state, confidence) and evidence (src, type, dst, uri, locator) are what is stored, with one
    row for each relation. The first reason that holds skips a proposal. Others create a candidate or update it: the
    confidence never falls, and new spans are added while the relation has fewer than ``keep``.
    """
    key = ["src", "type", "dst"]
    merged = proposals.groupBy(*key).agg(F.max("confidence").alias("proposed"))
    there = lambda name, side: entities.select(F.col("key").alias(side)).distinct().withColumn(name, F.lit(True))
    known = relations.select(*key, "candidate", "state", F.col("confidence").alias("held"))
    rows = merged.join(there("has_src", "src"), "src", "left").join(there("has_dst", "dst"), "dst", "left")
    rows = rows.join(types.select("type").distinct().withColumn("has_type", F.lit(True)), "type", "left").join(known, key, "left")
    outcome = (
        F.when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "unknown endpoint")
        .when(F.col("has_type").isNull(), "unknown relation type")
        .when((F.col("src") == F.col("dst")) & (F.col("type") != "RELATED_TO"), "typed self-loop")
        .when(~F.col("candidate"), "relation already exists")
        .when(F.col("state") != "unverified", F.concat(F.lit("already reviewed ("), "state", F.lit(")")))
        .when(F.col("state").isNull(), "created")
        .otherwise("updated")
    )
    spans = [*key, "uri", "locator"]
    have = evidence.select(*spans).distinct().groupBy(*key).agg(F.count("*").alias("have"))
    fresh = proposals.select(*spans).distinct().join(evidence.select(*spans).distinct(), spans, "left_anti").groupBy(*key).agg(F.count("*").alias("fresh"))
    rows = rows.withColumn("outcome", outcome).join(have, key, "left").join(fresh, key, "left").fillna(0, ["have", "fresh"])
    stored = F.col("outcome").isin("created", "updated")
    added = F.when(stored, F.least("fresh", F.greatest(F.lit(0).cast("long"), F.lit(keep) - F.col("have")))).otherwise(F.lit(0).cast("long"))
    return rows.select(
        *key, "outcome", F.when(stored, F.greatest("proposed", "held")).alias("confidence"), added.alias("added"), F.when(stored, F.col("have") + added).alias("support")
    )


def stored_evidence(proposals: DataFrame, evidence: DataFrame, keep: int = 25) -> DataFrame:
    """The new spans (src, type, dst, uri, locator) that ``store`` adds: the first of each relation, up to ``keep`` with what it has."""
    key = ["src", "type", "dst"]
    spans = [*key, "uri", "locator"]
    have = evidence.select(*spans).distinct().groupBy(*key).agg(F.count("*").alias("have"))
    fresh = proposals.select(*spans).distinct().join(evidence.select(*spans).distinct(), spans, "left_anti").join(have, key, "left")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("uri", "locator"))
    return fresh.withColumn("place", place).where(F.col("place") + F.coalesce("have", F.lit(0)) <= keep).select(*spans)


def custom_kg(entities: DataFrame, relations: DataFrame, evidence: DataFrame, lines: int = 5) -> DataFrame:
    """Chunks of a knowledge graph for a retrieval index: (kind, source_id, file_path, src, dst, keywords, content, weight).

    Entities are (key, type, name); relations (relation_id, src, type, dst, state, confidence), of which those between two
    known, different entities stay; evidence is (relation_id, uri), the first of each relation being named.
    """
    line = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    c = F.col
    nodes = entities.select(
        F.lit("entity").alias("kind"), line("kg:entity:", c("key")).alias("source_id"), line("kg://entity/", c("key")).alias("file_path"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"),
        c("type").alias("keywords"), F.concat_ws("\n", line(c("name"), " (", c("type"), ")"), line("stable_key: ", c("key"))).alias("content"), F.lit(None).cast("double").alias("weight"),
    )
    place = F.row_number().over(Window.partitionBy("relation_id").orderBy("uri"))
    first = evidence.select("relation_id", "uri").distinct().withColumn("place", place).where(c("place") <= lines)
    named = first.groupBy("relation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("uri")), lambda u: F.concat(F.lit("evidence: "), u)), "\n").alias("evidence"))
    side = lambda x: entities.select(c("key").alias(x), c("name").alias(f"{x}_name"))
    rows = relations.where("src <> dst").join(side("src"), "src").join(side("dst"), "dst").join(named, "relation_id", "left")
    content = F.concat_ws("\n", line(c("src_name"), " --", c("type"), "--> ", c("dst_name")), line("stable_key: ", c("relation_id")), line("verification_state: ", c("state")), line("confidence: ", c("confidence").cast("string")), c("evidence"))
    edges = rows.select(
        F.lit("relation").alias("kind"), line("kg:relation:", c("relation_id")).alias("source_id"), line("kg://relation/", c("relation_id")).alias("file_path"), "src", "dst",
        c("type").alias("keywords"), content.alias("content"), F.round(relation_weight(c("confidence"), c("state")), 6).alias("weight"),
    )
    return nodes.unionByName(edges)
