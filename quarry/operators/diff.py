"""Differences between two states of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Added, removed, changed and unchanged keys, with the fields that changed."""
    o = old.select(key, *(F.col(x).alias(f"__old_{x}") for x in fields)).withColumn("__o", F.lit(True))
    n = new.select(key, *(F.col(x).alias(f"__new_{x}") for x in fields)).withColumn("__n", F.lit(True))
    differs = lambda x: ~F.col(f"__old_{x}").eqNullSafe(F.col(f"__new_{x}"))
    changed = F.filter(F.array(*(F.when(differs(x), F.lit(x)) for x in fields)), lambda v: v.isNotNull())
    state = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    none = F.expr("cast(array() as array<string>)")
    return o.join(n, key, "full").select(key, state.alias("state"), F.when(F.col("__o").isNotNull() & F.col("__n").isNotNull(), changed).otherwise(none).alias("fields"))


def moved(x0: Column, y0: Column, x1: Column, y1: Column, u0: Column, v0: Column, u1: Column, v1: Column) -> tuple[Column, Column]:
    """(moved, resized) of a box: moved keeps its dimensions and shifts its centre, resized changes them."""
    same = (F.abs((x1 - x0) - (u1 - u0)) < 1e-9) & (F.abs((y1 - y0) - (v1 - v0)) < 1e-9)
    shifted = (F.abs((x0 + x1) - (u0 + u1)) > 1e-9) | (F.abs((y0 + y1) - (v0 + v1)) > 1e-9)
    return same & shifted, ~same


def counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of each label in two inventories, with what only one has."""
    a, b = left.groupBy(key).agg(F.count("*").alias("left_n")), right.groupBy(key).agg(F.count("*").alias("right_n"))
    return a.join(b, key, "full").select(key, F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n")).withColumn("delta", F.col("right_n") - F.col("left_n"))


def reconcile(local: DataFrame, remote: DataFrame, key: str, digest: str) -> DataFrame:
    """Missing, extra, stale and current rows of a remote inventory."""
    a, b = local.select(key, F.col(digest).alias("__a")), remote.select(key, F.col(digest).alias("__b"))
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("__a") != F.col("__b"), "stale").otherwise("current")
    return a.join(b, key, "full").select(key, state.alias("state"))


def digest(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """A digest of each group that does not depend on the order of rows: of their number and two sums of row digests."""
    line = F.md5(F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("~")) for x in fields)))
    part = lambda at: F.sum(F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return rows.groupBy(by).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(17)), 256).alias("digest"))


def all_of(tests: list[Column]) -> Column:
    """Conjunction; true of none."""
    return reduce(Column.__and__, tests, F.lit(True))
