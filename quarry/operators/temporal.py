"""Validity of edges, versions and facts in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_open(at: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """start <= at < end; a null bound is none."""
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at))


def closed(at: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    """start <= at <= end; only the end may be open."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) >= at))


def decidable(at: Column, start: str, end: str) -> Column:
    """As half_open, but null where the start is unknown and the end does not rule it out."""
    return F.when(F.col(end).isNotNull() & (F.col(end) <= at), F.lit(False)).when(F.col(start).isNull(), F.lit(None).cast("boolean")).otherwise(F.col(start) <= at)


def as_of(relations: DataFrame, at: Column) -> DataFrame:
    """Relations valid at an instant."""
    return relations.where(half_open(at))


def induced(nodes: DataFrame, edges: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Edges with both ends among the first nodes; a total order makes it repeatable."""
    first = nodes.orderBy(*order).limit(limit).select(F.col(key))
    return edges.join(first.withColumnRenamed(key, "src"), "src", "left_semi").join(first.withColumnRenamed(key, "dst"), "dst", "left_semi")


def invalidate(relations: DataFrame, at: Column) -> DataFrame:
    """Close relations at an instant: the new end and the outcome, refused if closed already or not begun."""
    outcome = F.when(F.col("valid_to").isNotNull(), "already_closed").when(F.col("valid_from") > at, "before_start").otherwise("closed")
    return relations.withColumn("outcome", outcome).withColumn("valid_to", F.when(F.col("outcome") == "closed", at).otherwise(F.col("valid_to")))


def newest_in_force(versions: DataFrame, at: Column, by: list[str], tie: str) -> DataFrame:
    """The newest version in force of each key."""
    w = Window.partitionBy(*by).orderBy(F.col("effective_from").desc(), F.col(tie).desc())
    return versions.where(closed(at)).withColumn("__nr", F.row_number().over(w)).where("__nr = 1").drop("__nr")


def resolve_version(versions: DataFrame, points: DataFrame, by: list[str], at: str) -> DataFrame:
    """The one version in force at each point: none or several resolve to none, with the reason."""
    hit = points.join(versions, by, "left").withColumn("__in", closed(F.col(at)))
    found = hit.groupBy(*points.columns).agg(
        F.count_if("__in").alias("matches"),
        F.max(F.when(F.col("__in"), F.col("version_id"))).alias("__version"),
        F.max(F.when(F.col("version_id").isNotNull() & F.col("effective_from").isNull(), 1).otherwise(0)).alias("__unknown"),
    )
    one = (F.col("matches") == 1) & (F.col("__unknown") == 0)
    reason = F.when(F.col("__unknown") == 1, "undecidable").when(F.col("matches") == 0, "none").when(F.col("matches") > 1, "overlapping").otherwise("resolved")
    return found.withColumn("version_id", F.when(one, F.col("__version"))).withColumn("reason", reason).drop("__version", "__unknown")
