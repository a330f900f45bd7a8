"""Secret scans over an incremental ledger of blobs, in DataFrame operations alone.

Every version of every path is addressed by the SHA-256 of its content. Only pairs of a blob and a rule version
that the ledger has not seen are scanned, each blob once however many paths hold it; what was found is appended to
the ledger, and the ledger's findings go back to all paths by address. A ledger is a folder of batches, and a batch
counts once it is whole, so that a scan that failed leaves nothing behind but work to do again.

Defined results: a null text is the empty blob; an empty blob has no findings; equal rows get equal findings;
a blob that a ledger holds more than once counts once; an empty table gives an empty result; a null path is kept as it
is; columns other than the path and the text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, expanded, scratch, settle, skew_join

#: The rules, in the order in which kinds at one start are listed. Each has its pattern and the least
#: length of the group that counts.
RULES = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
}
#: Changes with RULES; a ledger's entries of other versions are not reused.
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:12]
#: Versions of the corpus that ``report`` takes in one after the other.
INCREMENTS = 2
SPANS = "array<struct<start:int,nr:int,kind:string,end:int>>"


def _hits(text: Column, kind: str) -> Column:
    """Array of (nr, i, gap, hit, val) for one rule: lengths of the piece before each match, of the match, and of what counts.

    Matches and the pieces between them are cut by the same pattern, so that their lengths add up to the starts.
    """
    pattern, group, _ = RULES[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), counted.alias("val"))
    nr = list(RULES).index(kind)
    sizes = F.transform(
        parts, lambda x, i: F.struct(F.lit(nr).alias("nr"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["val"]).alias("val"))
    )
    none = F.expr("cast(array() as array<struct<nr:int,i:int,gap:int,hit:int,val:int>>)")
    return F.when(text.rlike(pattern), F.filter(sizes, lambda x: x["hit"].isNotNull())).otherwise(none)


def scan(blobs: DataFrame) -> DataFrame:
    """Findings of blobs (blob, text), grouped by blob: blob, rule_version and spans by start, then kind.

    Lengths are summed along each blob's matches of a rule, in time linear in the matches.
    """
    hits = blobs.select("blob", F.explode_outer(F.concat(*(_hits(F.col("text"), kind) for kind in RULES))).alias("x")).select("blob", "x.*")
    along = Window.partitionBy("blob", "nr").orderBy("i")
    ended = hits.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(along).cast("int"))
    kinds, least = (F.array(*map(F.lit, x)) for x in (RULES, (r[2] for r in RULES.values())))
    span = F.struct((F.col("end") - F.col("hit")).alias("start"), "nr", F.get(kinds, F.col("nr")).alias("kind"), "end")
    good = F.when(F.col("val") >= F.get(least, F.col("nr")), span)
    return ended.groupBy("blob").agg(F.lit(RULE_VERSION).alias("rule_version"), F.array_sort(F.collect_list(good)).cast(SPANS).alias("spans"))


class Ledger:
    """Batches of (blob, rule_version, spans) under one folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _batches(self) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or ()
        return sorted(x.getPath().getParent().toString() for x in found)

    def read(self) -> DataFrame | None:
        """What the ledger holds, or nothing."""
        whole = self._batches()
        return self.spark.read.schema(f"blob string, rule_version string, spans {SPANS}").parquet(*whole) if whole else None

    def append(self, found: DataFrame) -> None:
        """Add a batch."""
        found.write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")


def known(ledger: DataFrame) -> DataFrame:
    """Blobs of this rule version and their findings, as often as the ledger holds them."""
    return ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "spans")


def addressed(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, blob, text) of versions."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob"), body.alias("text"))


def unseen(held: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Findings of the blobs of (path, blob, text) that a ledger lacks, each scanned once."""
    blobs = held.select("blob", "text")
    if ledger is not None:
        blobs = blobs.join(known(ledger).select("blob"), "blob", "left_anti")
    return scan(blobs.groupBy("blob").agg(F.first("text").alias("text")))


def to_paths(held: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, blob, spans): a ledger's findings for every row of (path, blob, ...), as often as the row is there."""
    rows = settle(held.groupBy("path", "blob").agg(F.count("*").alias("n")))
    hits = known(ledger).where(F.size("spans") > 0).dropDuplicates(["blob"])
    found = settle(skew_join(rows, hits, ["blob"], ["path"], "left").select("path", "blob", "n", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans")))
    discard(rows)
    return expanded(found, "n", "copy").select("path", "blob", "spans")


def update(versions: DataFrame, ledger: Ledger, path: str = "path", text: str = "text") -> DataFrame:
    """Scan what the ledger lacks, append it, and return (path, blob, spans) for all rows.

    ``versions`` has a row for each historical version of a path.
    """
    held = addressed(versions, path, text)
    ledger.append(unseen(held, ledger.read()))
    return to_paths(held, ledger.read())


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Counts, digest and spans of each document.

    Documents are taken in as INCREMENTS successive versions of the corpus, of which each scans only what the ledger
    lacks. Without a ledger a new, empty one is used, so that a call does all of its work; one that is handed in is kept.
    """
    ledger = ledger or Ledger(docs.sparkSession, scratch(docs.sparkSession))
    held = addressed(docs, "doc_id")
    for i in range(INCREMENTS):
        ledger.append(unseen(held.where(F.pmod(F.xxhash64("path"), F.lit(INCREMENTS)) == i), ledger.read()))
    found = to_paths(held, ledger.read())
    base = ("assign", "access", "hex")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").cast("long").alias("doc_id"),
        *map(count, base),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
