"""Records, packs and proposals: small compositions over normalised rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def rates(rows: DataFrame, by: str, tests: dict[str, Column]) -> DataFrame:
    """How many rows of each group pass each test, of those where it is not null."""
    cells = [x for n, t in tests.items() for x in (F.count_if(t).alias(n), F.count(t).alias(f"{n}_of"))]
    return rows.groupBy(by).agg(F.count("*").alias("cases"), *cells)


def by_priority(rows: DataFrame, catalog: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Each row's catalog entry by the first of several keys that finds one, and which did.

    Each key joins once; a row that an earlier key found is not looked up again.
    """
    out, left = None, rows
    for name, key in keys:
        table = catalog.groupBy(key).agg(F.min("entry").alias("entry")).where(F.col(key).isNotNull())
        hit = left.join(table, key).withColumn("how", F.lit(name)).select(*rows.columns, "entry", "how")
        out = hit if out is None else out.unionByName(hit)
        left = left.join(table.select(key), key, "left_anti").select(*rows.columns)
    return out.unionByName(left.withColumn("entry", F.lit(None).cast(catalog.schema["entry"].dataType)).withColumn("how", F.lit("unmatched")))


def projected(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with both ends among the nodes and no self-loop."""
    keys = nodes.select("key").distinct()
    return relations.where("src <> dst").join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")


def choices(rows: DataFrame, key: str, allowed: Column, order: list[Column], limit: int) -> DataFrame:
    """Allowed choices once each, numbered in order, up to a limit."""
    once = rows.where(allowed).groupBy(key).agg(F.min(F.struct(*order)).alias("__order"))
    top = once.orderBy("__order", key).limit(limit)
    return top.withColumn("number", F.row_number().over(Window.orderBy("__order", key))).drop("__order")  # over limit rows


def compare_and_set(writes: DataFrame, by: str, start: int | None = None) -> DataFrame:
    """Whether each write (source, expected, revision, at, event_id) was accepted, in the order of its source.

    A source's first write is accepted (with ``start``, if it expects or repeats that), then what repeats its current revision or expects it. A refused write leaves
    the current revision as it is, so the order is a fold: rows of a source pass one task in order, and only its
    current revision is held.
    """
    at = [writes.columns.index(x) for x in (by, "expected", "revision")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, head = object(), None
        for part in parts:
            accepted = []
            for key, expected, revision in zip(*(part.column(i).to_pylist() for i in at), strict=True):
                first = key != source
                if first:
                    source, head = key, start
                good = (first and start is None) or revision == head or expected == head
                if good:
                    head = revision
                accepted.append(good)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(accepted, pa.bool_())], [*part.schema.names, "accepted"])

    schema = StructType([*writes.schema.fields, StructField("accepted", BooleanType())])
    return writes.repartition(by).sortWithinPartitions(by, "at", "event_id").mapInArrow(run, schema)


def unpivot(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One fact for each field that is not null."""
    pairs = F.array(*(F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value")) for f in fields))
    return rows.select(key, F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("x")).select(key, "x.*")


def joined_texts(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """Distinct texts of each group in one line."""
    return rows.groupBy(*by).agg(F.concat_ws("; ", F.array_sort(F.collect_set(text))).alias("texts"), F.count("*").alias("n"))


def rebuilt(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of parts in which the last part that has a key wins it."""
    numbered = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, numbered)
    fields = [x for x in parts[0].columns if x != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), "__part").alias("__row")).select(key, "__row.*")


def most_used(rows: DataFrame, by: str, item: str, n: int) -> DataFrame:
    """The n most used items of each group, by count and name."""
    counts = rows.groupBy(by, item).agg(F.count("*").alias("uses"))
    w = Window.partitionBy(by).orderBy(F.desc("uses"), item)
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
