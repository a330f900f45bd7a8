"""Building, storing and checking the knowledge graph and its side tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.lineage import cut
from quarry.operators.ranking import first_by, with_firsts

STATES = {"verified": ("human_verified", "machine_verified"), "unverified": ("unverified", "candidate"), "rejected": ("rejected",)}


def in_bucket(state: str, *buckets: str) -> Column:
    """States of named buckets; an unknown name raises."""
    unknown = set(buckets) - set(STATES)
    if unknown:
        raise ValueError(f"unknown review bucket {sorted(unknown)}")
    return F.col(state).isin([s for b in buckets for s in STATES[b]])


def secure_view(relations: DataFrame, evidence: DataFrame, valid: Column, project: Column) -> DataFrame:
    """Verified relations of one project, in force, with verified evidence."""
    proven = evidence.where(in_bucket("state", "verified")).select("relation_id").distinct()
    return relations.where(in_bucket("state", "verified") & valid & project).join(proven, "relation_id", "left_semi")


def without_private(nodes: DataFrame, edges: DataFrame, private: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without private keys and edges that touch none."""
    gone = private.select("key").distinct()
    kept = nodes.join(gone, "key", "left_anti")
    free = edges.join(gone.withColumnRenamed("key", "src"), "src", "left_anti").join(gone.withColumnRenamed("key", "dst"), "dst", "left_anti")
    return kept, free


def low_trust(marks: Column, methods: Column) -> Column:
    """Marked as candidate, or known from co-occurrence alone."""
    return F.array_contains(marks, "candidate") | ((F.size(methods) > 0) & (F.size(F.array_except(methods, F.array(F.lit("cooccurrence")))) == 0))


def active(sources: DataFrame, revisions: DataFrame) -> DataFrame:
    """Records of each source's current revision."""
    return revisions.join(sources.select("source_id", F.col("current").alias("revision")), ["source_id", "revision"], "left_semi")


def first_related(rows: DataFrame, edges: DataFrame, predicate: str) -> DataFrame:
    """Each row with its least related id over a predicate; the reference order being undefined, the least is ours."""
    lookup = edges.where(F.col("predicate") == predicate).groupBy("src").agg(F.min("dst").alias("related"))
    return rows.join(lookup, rows["key"] == lookup["src"], "left").drop("src")


def resolve(refs: DataFrame, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first of successive lookups (ref, target) that knows a reference, and which it was."""
    out = refs
    for i, (_, table) in enumerate(steps):
        out = out.join(table.groupBy("ref").agg(F.min("target").alias(f"__t{i}")), "ref", "left")
    how = F.lit("unresolved")
    for i in reversed(range(len(steps))):
        how = F.when(F.col(f"__t{i}").isNotNull(), steps[i][0]).otherwise(how)
    return out.select(*refs.columns, F.coalesce(*(F.col(f"__t{i}") for i in range(len(steps)))).alias("target"), how.alias("how"))


def attach(relations: DataFrame, evidence: DataFrame, keep: int) -> DataFrame:
    """Relations with their first evidences by source and place."""
    first = first_by(evidence, ["relation_id"], [F.asc("source_uri"), F.asc("locator")], keep)
    per = first.groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("source_uri", "locator"))).alias("evidences"))
    none = F.expr("cast(array() as array<struct<source_uri:string,locator:bigint>>)")
    return relations.join(per, "relation_id", "left").withColumn("evidences", F.coalesce("evidences", none))


def current_or_last(groups: DataFrame, by: list[str]) -> DataFrame:
    """Groups that are not wholly superseded; where none of a key is left, all of them come back."""
    left = F.max((F.col("current") > 0).cast("int")).over(Window.partitionBy(*by))
    return groups.withColumn("__left", left).where((F.col("current") > 0) | (F.col("__left") == 0)).drop("__left")


def queue_order() -> list[Column]:
    """Priority, newest file first, unknown times last, then age and id."""
    return [F.asc("priority"), F.desc_nulls_last("mtime"), F.asc("created_at"), F.asc("job_id")]


def merged_entities(rows: DataFrame, key: str, keep: int) -> DataFrame:
    """Occurrences of each canonical key: count, first values and first ids."""
    totals = rows.groupBy(key).agg(F.count("*").alias("occurrences"))
    return with_firsts(totals, rows, [key], ["id", "area"], keep, {"areas": F.col("area"), "ids": F.col("id")})


def build(parts: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several parts, each key and edge once; the first part by name wins a key."""
    nodes = edges = None
    for name in sorted(parts):
        n, e = (x.withColumn("__part", F.lit(name)) for x in parts[name])
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    fields = [x for x in nodes.columns if x not in ("key", "__part")]
    once = nodes.groupBy("key").agg(F.min_by(F.struct(*fields), "__part").alias("__row")).select("key", "__row.*")
    return once, edges.drop("__part").distinct()


def fingerprint(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """A project's fingerprint: what has it unchanged needs no rebuild."""
    from quarry.operators.diff import digest

    return digest(rows, by, fields)


def reembed(objects: DataFrame, known: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> tuple[DataFrame, DataFrame]:
    """Vectors of texts (content_hash, text) that are not known yet, each text once, and all objects' mapping.

    ``embed`` works on batches of texts on the executors.
    """
    hashed = objects.withColumn("content_hash", F.sha2("text", 256))
    fresh = hashed.select("content_hash", "text").dropDuplicates(["content_hash"]).join(known.select("content_hash"), "content_hash", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"content_hash": part["content_hash"], "embedding": embed(part["text"].tolist())})

    return fresh.mapInPandas(run, "content_hash string, embedding array<double>"), hashed.select("object_id", "content_hash")


def backfill(rows: DataFrame, ladder: list[tuple[str, DataFrame]]) -> DataFrame:
    """Missing storeys from successive lookups, the first that knows one; each is (column to join on, table of it and storey)."""
    out = rows
    for i, (on, table) in enumerate(ladder):
        out = out.join(table.groupBy(on).agg(F.min("storey").alias(f"__s{i}")), on, "left")
    found = F.coalesce(F.nullif("storey", F.lit("")), *(F.col(f"__s{i}") for i in range(len(ladder))))
    return out.withColumn("storey", found).drop(*(f"__s{i}" for i in range(len(ladder))))


def supersede(facts: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Append facts and close those that they replace (same subject and path, still open)."""
    keys = new.select("subject", "path").distinct().withColumn("__new", F.lit(True))
    closed = facts.join(keys, ["subject", "path"], "left").withColumn("superseded_at", F.when(F.col("__new") & F.col("superseded_at").isNull(), at).otherwise(F.col("superseded_at"))).drop("__new")
    return closed.unionByName(new)


def problems(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Names of the checks that fail, in order; rows without any are left out."""
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return rows.select(key, found.alias("problems")).where("size(problems) > 0")


def lexicographic_best(rows: DataFrame, gate: Column, order: list[Column]) -> DataFrame:
    """Providers that pass the gate and are best by the first order, then the next; equal ones are all kept."""
    w = Window.orderBy(*order)  # a row for each provider
    return rows.where(gate).withColumn("place", F.rank().over(w)).where("place = 1")


def active_records(records: DataFrame) -> DataFrame:
    """Records that no other one supersedes or revokes (record_id, supersedes array, revoked)."""
    replaced = records.select(F.explode("supersedes").alias("record_id")).distinct()
    return records.where(~F.col("revoked")).join(replaced, "record_id", "left_anti")


def latest_evidence(rows: DataFrame, by: str, kind: str, active: Column, required: list[str]) -> DataFrame:
    """Latest active evidence of every required kind of each owner, whether several compete, and null where it is missing."""
    held = rows.where(active & F.col(kind).isin(required))
    best = held.groupBy(by, kind).agg(F.min(F.struct((-F.unix_micros("seen_at")).alias("age"), "evidence_id")).alias("best"), (F.count("*") > 1).alias("conflict"))
    owners = rows.select(by).distinct().withColumn(kind, F.explode(F.array(*map(F.lit, required))))
    return owners.join(best, [by, kind], "left").select(by, kind, F.col("best.evidence_id").alias("evidence_id"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that edges (src, dst) reach from roots (node), until nothing new appears."""
    seen = frontier = cut(roots.select("node").distinct())
    while not frontier.isEmpty():
        reached = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen, "node", "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def prioritised(parts: list[DataFrame], key: str, limit: int) -> DataFrame:
    """Rows of the first part that has them, in order of parts and keys, up to a limit."""
    out = None
    for i, p in enumerate(parts):
        x = p.select(key).withColumn("__part", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return out.groupBy(key).agg(F.min("__part").alias("part")).orderBy("part", key).limit(limit)


def votes(rows: DataFrame, by: str, code: str, n: str, least: int) -> DataFrame:
    """Most voted code of each key with enough votes, the least code of equal ones, and the confidence in it."""
    per = rows.groupBy(by, code).agg(F.sum(n).alias("n"))
    best = per.groupBy(by).agg(F.sum("n").alias("votes"), F.min(F.struct((-F.col("n")).alias("n"), F.col(code).alias("code"))).alias("b")).where(F.col("votes") >= least)
    return best.select(by, "votes", F.col("b.code").alias("code"), F.round(F.least(F.lit(0.8), 0.5 + 0.3 * (-F.col("b.n")) / F.col("votes")), 6).alias("confidence"))


def search_text(fields: list[str], longest: int = 2000) -> Column:
    """Fields in one line, white space collapsed, cut at a length."""
    return F.left(F.trim(F.regexp_replace(F.concat_ws(" ", *(F.col(x).cast("string") for x in fields)), r"\s+", " ")), F.lit(longest))


def pack_problems(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, prefix: str) -> DataFrame:
    """Why a knowledge pack may not be loaded, a row for each (problem, key); none if it may.

    Nodes (id, type, name) need all three, ids with the pack's prefix that occur once; edges (src, predicate, dst) need a
    predicate and known ends, aliases (alias, node_id) a known node.
    """
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    problem = lambda rows, name, key: rows.select(F.lit(name).alias("problem"), F.col(key).alias("key"))
    ids = nodes.where(F.col("id").isNotNull()).select("id").distinct()
    unknown = lambda rows, end: rows.join(ids, F.col(end) == F.col("id"), "left_anti")
    parts = [
        problem(nodes.where(blank("id") | blank("type") | blank("name")), "incomplete node", "id"),
        problem(nodes.where(~blank("id") & ~F.col("id").startswith(prefix)), "foreign id", "id"),
        problem(nodes.where(~blank("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate id", "id"),
        problem(unknown(edges, "src"), "unknown source", "src"),
        problem(unknown(edges, "dst"), "unknown target", "dst"),
        problem(edges.where(blank("predicate")), "edge without predicate", "src"),
        problem(unknown(aliases, "node_id"), "unknown alias node", "alias"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def load_pack(rows: DataFrame, problems: DataFrame, path: str, pack: str) -> None:
    """Replace a pack's partition of a table, and no other; a pack with problems is refused."""
    if first := problems.first():
        raise ValueError(f"{pack}: {first['problem']} {first['key']}")
    rows.withColumn("pack", F.lit(pack)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pack").parquet(path)


def unload_pack(spark: SparkSession, path: str, pack: str) -> bool:
    """Delete a pack's partition; whether there was one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/pack={pack}")
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


REGISTRY: dict[str, Callable] = {}


def plugin(name: str) -> Callable[[Callable], Callable]:
    """Register a reader, rule or embedder under a name that is not taken."""

    def add(f: Callable) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"{name} is taken")
        REGISTRY[name] = f
        return f

    return add
