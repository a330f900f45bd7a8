"""Element catalogs: counts by kind, block, layer and document, filters and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import with_firsts


def wildcard(column: str, pattern: str) -> Column:
    """``*`` and ``?`` match any run and any character, in either case; a pattern without them must be equal."""
    if "*" not in pattern and "?" not in pattern:
        return F.upper(column) == pattern.upper()
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return F.col(column).ilike(like)


def literal(column: str, text: str) -> Column:
    """The text occurs in the column, in either case, whatever characters it has."""
    return F.lower(column).contains(text.lower())


def overlaps(x0: float, y0: float, x1: float, y1: float) -> Column:
    """Closed boxes touch or overlap."""
    return (F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0)


def any_of(objects: DataFrame, key: str, branches: list[DataFrame]) -> DataFrame:
    """Objects whose key is in any branch: a union and one semi-join instead of OR-ed EXISTS."""
    ids = reduce(DataFrame.unionByName, (b.select(key) for b in branches)).distinct()
    return objects.join(ids, key, "left_semi")


def find(objects: DataFrame, kind: str | None = None, block: str | None = None, text: str | None = None, state: str | None = None, layer: str | None = None) -> DataFrame:
    """Conjunction of the filters that are given."""
    tests = []
    if kind is not None:
        tests.append(wildcard("kind", kind))
    if block is not None:
        tests.append(wildcard("block", block))
    if text is not None:
        tests.append(literal("label", text))
    if state is not None:
        tests.append(F.col("state") == state)
    if layer is not None:
        tests.append(wildcard("layer", layer))
    return objects.where(reduce(Column.__and__, tests, F.lit(True)))


def page(rows: DataFrame, key: str, cursor: str | None, size: int) -> DataFrame:
    """Keyset page: the rows after a cursor, one more than the page to tell whether another follows."""
    after = rows if cursor is None else rows.where(F.col(key) > cursor)
    return after.orderBy(key).limit(size + 1)


def kinds(objects: DataFrame, by: list[str]) -> DataFrame:
    """Count, distinct documents and inferred objects of each kind."""
    return objects.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("document").alias("documents"), F.count_if(F.col("state") == "AI_INFERRED").alias("inferred"))


def rollup(objects: DataFrame, category: str, kind: str) -> DataFrame:
    """Categories: counts add up, distinct documents take the greatest, since documents recur among kinds."""
    return kinds(objects, [category, kind]).groupBy(category).agg(F.sum("n").alias("n"), F.max("documents").alias("documents"), F.array_sort(F.collect_set(kind)).alias("kinds"))


def layer_counts(objects: DataFrame, top: int) -> DataFrame:
    """The top layers and kinds by count."""
    return objects.groupBy("layer", "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "layer", "kind").limit(top)


def scalars(objects: DataFrame) -> DataFrame:
    """Filtered aggregates over all objects in one pass."""
    inferred = F.col("state") == "AI_INFERRED"
    return objects.agg(
        F.count_if(inferred).alias("inferred"),
        F.count_if(~inferred).alias("observed"),
        F.countDistinct(F.when(inferred, F.col("block"))).alias("inferred_blocks"),
        F.countDistinct(F.when(F.col("layer") == "R", F.col("document"))).alias("rejected_documents"),
    )


def blocks(objects: DataFrame) -> DataFrame:
    """Block catalog: instances, the most common kind (first by name among equals), sets and sums."""
    per = objects.groupBy("block", "kind").agg(
        F.count("*").alias("n"), F.collect_set("layer").alias("layers"), F.sum("quantity").alias("quantity"), F.bool_or(F.col("state") == "AI_INFERRED").alias("inferred")
    )
    ranked = per.withColumn("__first", F.min(F.struct((-F.col("n")).alias("n"), F.col("kind").alias("kind"))).over(Window.partitionBy("block")))
    return ranked.groupBy("block").agg(
        F.sum("n").alias("instances"),
        F.first("__first.kind").alias("kind"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("layers")))).alias("layers"),
        F.sum("quantity").alias("quantity"),
        F.bool_or("inferred").alias("inferred"),
    )


def groups(objects: DataFrame, by: list[str], keep: int) -> DataFrame:
    """Groups with their first object ids and the count of inferred ones."""
    totals = objects.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "AI_INFERRED").alias("inferred"))
    return with_firsts(totals, objects, by, ["object_id"], keep, {"first_ids": F.col("object_id")})


def drawing_index(objects: DataFrame) -> DataFrame:
    """Per document: counts by layer as ordered pairs, and all."""
    per = objects.groupBy("document", "layer").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat("layer", F.lit("="), F.col("n").cast("string"))))
    return per.groupBy("document").agg(pairs.alias("by_layer"), F.sum("n").alias("n"))


def json_keys(rows: DataFrame, column: str) -> DataFrame:
    """How often each key of JSON objects occurs."""
    return rows.select(F.explode(F.json_object_keys(column)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def path(column: str, *paths: str) -> Column:
    """First JSON path that holds something other than blank."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(column, p)), F.lit("")) for p in paths))


def status_counts(rows: DataFrame, by: str, status: str, known: tuple[str, ...]) -> DataFrame:
    """One column for each known status, and one for all others."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in known), F.count_if(F.col(status).isNull() | ~F.col(status).isin(*known)).alias("n_other"))


def byte_budget(rows: DataFrame, by: str, order: list[str], body: str, budget: int) -> DataFrame:
    """Rows of each page whose running size stays in a budget of bytes."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(F.octet_length(body)).over(w)).where(F.col("used") <= budget)
