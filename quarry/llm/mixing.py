"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Targets share a total by weight; a source's target stops at a multiple of its size and the excess is shared again.
Within a source each document expects target / size copies. Expected copies are summed along the source, one offset
is added, and a document is emitted once for every integer that the sum crosses on it. Along a source documents
stand by size, so that every stretch of the sum holds a fair share of long and short ones and the words taken come
near the target.

Place along a source is found from counts: of the sizes before, of the ids before within a size, and of the rows before
within an id; no task sees a whole source. Equal rows are counted and stand for each other.

Defined results: a null or blank text has size 0 and takes 0 words; a null source is one source, last in order; rows of
equal id, source and size share their expectation and may differ by a copy; ``emit`` shares their copies out by a digest
of the whole row; a source without words has target 0 and is not emitted; an empty table gives an empty result; further
columns, of whatever name, stay on emitted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expanded, n_words, settle, skew_join, small, unused

# Fixed values of the registered query: weights by place of the source, share of all words, and the cap.
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
#: Ids of one source and size, and digests of one id, are numbered in so many groups at once.
BUCKETS = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target of each source, from (source, total).

    With sources by cap over weight, those before some place stop at their caps and the rest share what is left: the
    first source whose cap holds its fair share of the rest begins that part.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row of a few bytes for each source
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    by = sizes.select("source", "total", weight.alias("weight"), (F.col("total") * F.lit(cap)).alias("most"))
    ranked = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rest = by.withColumns({
        "mass": F.sum("weight").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "spent": F.coalesce(F.sum("most").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "all": F.sum("total").over(everything) * F.lit(share),
    })
    level = F.when(F.col("most") * F.col("mass") >= (F.col("all") - F.col("spent")) * F.col("weight"), (F.col("all") - F.col("spent")) / F.col("mass"))
    return rest.withColumn("level", F.max(level).over(everything)).select(
        "source", F.col("total").alias("source_size"), F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).alias("target")
    )


def offset(source: Column, seed: str) -> Column:
    """A source's offset in [0, 1), the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def _before(rows: DataFrame, within: list[str], by: list[Column]) -> Column:
    """Rows counted in n before each one within a group."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(ids: DataFrame, seed: str = "mix", **kind) -> DataFrame:
    """Add source_size, target, each (copies expected of a row), shift and start to settled (doc_id, source, size, n).

    ``start`` counts the source's rows before these n. The order is by size, group of ids, and id, nulls last.
    """
    rows = ids.withColumns({"key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")), "bucket": F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(BUCKETS))})
    per_bucket = rows.groupBy("key", "size", "bucket").agg(F.sum("n").alias("n"))
    per_size = per_bucket.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sizes = per_size.select("key", "size", _before(per_size, ["key"], [F.col("size")]).alias("before_size"))
    buckets = per_bucket.select("key", "size", "bucket", _before(per_bucket, ["key", "size"], [F.col("bucket")]).alias("before_bucket"))
    total = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    goal = small(settle(targets(total, **kind).select(key.alias("key"), "source_size", "target")), 200)
    sums = buckets.join(sizes, ["key", "size"]).join(goal, "key").select("key", "size", "bucket", (F.col("before_size") + F.col("before_bucket")).alias("before"), "source_size", "target")
    own = _before(rows, ["key", "size", "bucket"], [F.col("doc_id").asc_nulls_last()])
    return rows.withColumn("own", own).join(sums, ["key", "size", "bucket"]).select(
        "doc_id",
        "source",
        "size",
        "n",
        "source_size",
        "target",
        F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("each"),
        offset(F.col("source"), seed).alias("shift"),
        (F.col("before") + F.col("own")).alias("start"),
    )


def crossed(first: Column, n: Column | int) -> Column:
    """Integers that the shifted sum of expected copies crosses on n rows from a place on."""
    at = lambda x: F.floor(x.cast("double") * F.col("each") + F.col("shift"))
    return at(first + n) - at(first)


def _sized(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")]


def plan(docs: DataFrame, **kind) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and words taken of each document."""
    ids = settle(docs.select(*_sized(docs)).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    rows = expanded(settle(placed(ids, **kind)), "n", "i").withColumn("copies", crossed(F.col("start") + F.col("i"), 1))
    return rows.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, **kind) -> DataFrame:
    """The mixed documents, each as often as it is taken, with the columns that they had.

    Copies are decided on ids, sizes and a digest of the row, and joined back to the texts; equal rows are emitted
    from one of them.
    """
    digest = F.xxhash64(*docs.columns)
    rows = settle(docs.select(*_sized(docs), digest.alias("digest")).groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n")))
    ids = settle(rows.groupBy("doc_id", "source", "size").agg(F.sum("n").alias("n")))
    id_key = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(f"k_{c}") for c in ("doc_id", "source")]
    places = placed(ids, **kind).select(*id_key, F.col("source").isNull().alias("k_null"), F.col("size").alias("k_size"), "each", "shift", "start")
    keyed = rows.select("*", *id_key, F.col("source").isNull().alias("k_null"), F.col("size").alias("k_size"), F.pmod("digest", F.lit(BUCKETS)).alias("part"))
    key = ["k_doc_id", "k_source", "k_null", "k_size"]
    parts = keyed.groupBy(*key, "part").agg(F.sum("n").alias("n"))
    parts = parts.withColumn("before", _before(parts, key, [F.col("part")])).drop("n")
    own = keyed.withColumn("own", _before(keyed, [*key, "part"], [F.col("digest")])).join(parts, [*key, "part"])
    decided = skew_join(settle(own), places, key, ["digest"]).select("doc_id", "digest", "n", crossed(F.col("start") + F.col("before") + F.col("own"), F.col("n")).alias("copies"))
    wanted = settle(decided.where("copies > 0"))

    k_id, k_digest, k_n, k_copies, k_copy = unused(docs, "quarry_id", "quarry_digest", "quarry_n", "quarry_copies", "quarry_copy")
    with_keys = docs.withColumns({k_id: F.col("doc_id").cast("long"), k_digest: digest})
    named = wanted.select(F.col("doc_id").alias(f"{k_id}w"), F.col("digest").alias(f"{k_digest}w"), F.col("n").alias(k_n), F.col("copies").alias(k_copies))
    joined = with_keys.join(small(named, 40), (F.col(k_digest) == F.col(f"{k_digest}w")) & F.col(k_id).eqNullSafe(F.col(f"{k_id}w")))
    copies = lambda df: df.withColumn(k_copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(k_copies)))).select(*docs.columns)
    out = copies(joined.where(F.col(k_n) == 1))
    if wanted.where("n > 1").isEmpty():
        return out
    repeated = joined.where(F.col(k_n) > 1).groupBy(k_id, k_digest).agg(F.first(F.struct(*docs.columns)).alias("row"), F.first(k_copies).alias("copies"))
    return out.unionByName(expanded(settle(repeated.select("row", "copies")), "copies", "copy").select("row.*"))


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS total, list_value(5, 2, 1)[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM rows GROUP BY source
), ranked AS (
  SELECT *, total * 2.0::DOUBLE AS most,
    sum(weight) OVER (ORDER BY total * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass,
    coalesce(sum(total * 2.0::DOUBLE) OVER (ORDER BY total * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(total) OVER () * 1.5::DOUBLE AS whole FROM per
), goal AS (
  SELECT source, total AS source_size,
    least(most, coalesce(max(CASE WHEN most * mass >= (whole - spent) * weight THEN (whole - spent) / mass END) OVER (), 'inf'::DOUBLE) * weight) AS target FROM ranked
), placed AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, g.target / nullif(g.source_size, 0) AS each,
    row_number() OVER (PARTITION BY r.source ORDER BY r.size, coalesce(r.doc_id, 0) % 64, r.doc_id)::DOUBLE AS pos,
    (('0x' || substr(md5('mix' || coalesce(r.source, '')), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM rows r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (coalesce(floor(pos * each + shift) - floor((pos - 1) * each + shift), 0)::BIGINT * size)::BIGINT AS taken FROM placed
"""
