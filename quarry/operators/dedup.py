"""Files, vectors and keys that occur more than once, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def census(files: DataFrame, wanted: str | None = None) -> DataFrame:
    """One row for each content: the least path, the other paths, and the newest time over all paths.

    ``wanted`` filters which paths may stand for the content; the time looks at all of them.
    """
    times = files.groupBy("sha256").agg(F.max("mtime").alias("newest"))
    rows = files if wanted is None else files.where(wanted)
    paths = rows.groupBy("sha256").agg(F.min("path").alias("canonical"), F.array_sort(F.collect_list("path")).alias("__all"), F.first("bytes").alias("bytes"))
    return paths.join(times, "sha256").select(
        F.concat(F.lit("doc_"), F.left("sha256", F.lit(24))).alias("document_id"), "canonical", F.array_except("__all", F.array("canonical")).alias("aliases"), "newest", "bytes"
    )


def summary(files: DataFrame, by: str) -> DataFrame:
    """Files and bytes of each group."""
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.countDistinct("sha256").alias("contents"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Contents that several files have, and the bytes that one copy would save."""
    return files.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("path").alias("first"), (F.sum("bytes") - F.max("bytes")).alias("wasted")).where("copies > 1")


def latest_rows(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    fields = [x for x in rows.columns if x not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*fields), order).alias("__row")).select(*key, "__row.*")


def pending(wanted: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a counterpart."""
    return wanted.join(have.select(*on).distinct(), on, "left_anti")


def complete(members: DataFrame, have: DataFrame, group: str, on: list[str]) -> DataFrame:
    """Groups all of whose members have a counterpart: what is missing first, then groups without anything missing."""
    missing = pending(members, have, on).select(group).distinct()
    return members.select(group).distinct().join(missing, group, "left_anti")


def _once(rows: DataFrame, key: list[str]) -> DataFrame:
    rest = [x for x in rows.columns if x not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("row")).select(*key, "row.*").select(*rows.columns) if rest else rows.distinct()


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; of new rows of one key, the greatest in its other columns stays."""
    once = _once(new, key)
    return old.join(once.select(*key), key, "left_anti").unionByName(once)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key is not there yet, one of each key as in ``upsert``."""
    return _once(new, key).join(old.select(*key), key, "left_anti")


def several_sources(rows: DataFrame, key: str, source: str) -> DataFrame:
    """Keys that come from more than one source."""
    return rows.groupBy(key).agg(F.countDistinct(source).alias("sources")).where("sources > 1")
