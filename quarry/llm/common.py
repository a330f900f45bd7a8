"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every contract's word: a run without space, tab, newline, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of text per Arrow batch; with very long texts a larger batch would not fit a small executor.
BATCH_ROWS = 1000
#: Words whose hashes a Python worker keeps: some 60 MB, so that two workers fit beside a small executor's heap.
CACHED_WORDS = 300_000
#: A side may be broadcast below this many estimated bytes; beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20
MASK = (1 << 64) - 1

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(spark: SparkSession) -> None:
    """Keep the batches that Python workers get small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only if none is set and all runs in one JVM."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    return path


#: Spark's setting under which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and losing an executor loses nothing.

    The shuffle files of the write go as soon as it ends. ``checkpoint()`` would compute the last stage twice, and its
    files are not compressed.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in settled:
        _delete(df.sparkSession, df.settled_at)
        _written.pop(df.settled_at, None)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first; its folder goes with it
            return


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that the table does not have, in any case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a settled table for broadcast if its counted rows fit in BROADCAST_BYTES, else leave the join to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (splitmix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        """The hashes of words, in order."""
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two runs made into those of both in this order."""
    out = a * np.uint64(0x9E3779B97F4A7C15) + b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One well-mixed hash for each run of n consecutive word hashes; none if there are fewer.

    Runs double in length while they fit, and two that overlap make up the rest.
    """
    if len(h) < n:
        return h[:0]
    with np.errstate(over="ignore"):
        out, m = h, 1
        while 2 * m <= n:
            out, m = _join(out[:-m], out[m:]), 2 * m
        if m < n:
            out = _join(out[: m - n], out[n - m :])
        return mix(out)


#: Equal rows that one task makes of a group.
CHUNK = 100_000


def expanded(groups: DataFrame, n: str, at: str) -> DataFrame:
    """Settled groups as often as they have rows, numbered from 0; groups of more than CHUNK rows are dealt out in pieces."""
    count = F.col(n)
    few = groups.where(count <= CHUNK).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    many = groups.where(count > CHUNK)
    if many.isEmpty():
        return few
    (piece,) = unused(groups, "piece")
    pieces = many.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), count - 1, F.lit(CHUNK).cast("long")))).repartition(piece)
    each = F.explode(F.sequence(F.col(piece), F.least(F.col(piece) + CHUNK, count) - 1))
    return few.unionByName(pieces.withColumn(at, each).drop(piece))


#: A key is hot from so many rows on, and never are more than HOT_KEYS keys; a hot key's rows are dealt to SALTS tasks.
HOT_ROWS, HOT_KEYS, SALTS = 200, 10_000, 64


def skew_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """Join a settled table with one that has a row or few for each key, dealing out the rows of hot keys.

    Hot keys are those with HOT_ROWS rows or, in large tables, the HOT_KEYS-th part of all; so they are few enough to
    send everywhere. Rows of a hot key on the left go to SALTS tasks by a hash of ``spread``, and the key's rows on
    the right to each of these.
    """
    least = max(HOT_ROWS, left.count() // HOT_KEYS + 1)
    keys = left.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n").dropna().collect()
    if not keys:
        return left.join(right, on, how)
    schema = left.select(*on).schema
    hot = F.broadcast(left.sparkSession.createDataFrame(keys, schema).withColumn("__hot", F.lit(True)))
    many = left.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    few = right.join(hot, on, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return many.join(few, [*on, "__salt"], how).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of edges (a, b), the component being the least id that is reachable.

    Alternates large stars and small stars: each node's greater neighbours, then its lesser ones, are tied to the
    least node of its neighbourhood, until nothing changes. The edges never become more.
    """

    def stars(e: DataFrame, least: DataFrame) -> DataFrame:
        return skew_join(e, least, ["u"], ["v"])

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(e)
    while before[0]:
        both = settle(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        discard(e)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settle(stars(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        discard(both)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = stars(large, least)
        e = settle(tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(large)
        now = state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = settle(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots))
    discard(e)
    return out
