"""Sharding by a hierarchical weighted hash tree, law ``key``.

Shards hang in racks and racks in regions; the weight of a rack or region is the sum of its shards'. At each level every
child draws -ln(u) / weight, u being a hash of the document's id, the level and the child, and the document descends to
the child of the least draw: first the region, then one of its racks, then one of its shards. A changed weight changes the draws
of that shard, its rack and its region alone, so documents move only into (or out of) these subtrees; what stays in
the region keeps its rack unless that one's weight changed, and so on down.

The first BASE shards make up the fixed part of the tree. A shard added later opens a region of its own, so that
what a growing tree moves goes into the new shard and nowhere else.

Defined results: a null text has size 1 and CRC 0; all documents of a null id fall together, since the id decides;
equal rows get the same shard and different slots; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expanded, settle

SHARDS = 16
#: Shards that the fixed part of the tree holds.
BASE = 16
#: Shards of a rack and racks of a region.
RACK, REGION = 4, 2
#: A shard's documents are numbered in so many groups at once.
BUCKETS = 1024

#: A node is a shard number, or a list of nodes; a rack or region goes by the number of its first shard.
Tree = list[list[list[int]]]


def tree(n: int) -> Tree:
    """Regions of racks of shards."""
    fixed = range(min(n, BASE))
    racks = [list(fixed[i : i + RACK]) for i in range(0, len(fixed), RACK)]
    return [racks[i : i + REGION] for i in range(0, len(racks), REGION)] + [[[s]] for s in range(BASE, n)]


def draw(key: Column, level: int, node: int, weight: float) -> Column:
    """A node's exponential draw for a key: from 53 bits of the hash, never 0."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11).cast("double") + 0.5) * 2.0**-53
    return -F.log(u) / weight


def _descend(key: Column, level: int, nodes: list[tuple[int, float]]) -> Column:
    """The node of the least draw; of equal draws, the least number."""
    if len(nodes) == 1:
        return F.lit(nodes[0][0])
    return F.array_min(F.array(*(F.struct(draw(key, level, s, w).alias("draw"), F.lit(s).alias("node")) for s, w in nodes)))["node"]


def _choose(chosen: Column, options: dict[int, Column]) -> Column:
    """The option of the node that was chosen."""
    out = None
    for node, option in options.items():
        out = F.when(chosen == node, option) if out is None else out.when(chosen == node, option)
    return out


def shard(docs: DataFrame, key: str, n: int, out: str, weights: list[float] | None = None) -> DataFrame:
    """Add a column with the shard of each row; shards without weight take none. The key counts as a long."""
    weight = [float(w) for w in (weights or [1.0] * n)]
    shape = [[[s for s in rack if weight[s] > 0] for rack in region] for region in tree(n)]
    shape = [[rack for rack in region if rack] for region in shape if any(region)]
    of_rack = lambda rack: (rack[0], sum(weight[s] for s in rack))
    of_region = lambda region: (region[0][0], sum(of_rack(rack)[1] for rack in region))
    k = F.col(key).cast("long")
    region = _descend(k, 0, [of_region(x) for x in shape])
    rack = lambda at: _choose(at, {x[0][0]: _descend(k, 1, [of_rack(y) for y in x]) for x in shape})
    leaf = lambda at: _choose(at, {y[0]: _descend(k, 2, [(s, weight[s]) for s in y]) for x in shape for y in x})
    # a projection for each level, so that a choice is made once
    return docs.withColumn(out, region).withColumn(out, rack(F.col(out))).withColumn(out, leaf(F.col(out)).cast("int"))


def assign(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """Shard, slot and next shard of each document.

    Equal rows are counted first. A slot is a shard's count in the groups before, plus the rows before in the
    document's own group of hashed rows, so that no task numbers a whole shard or all rows of one id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    groups = shard(shard(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "doc_id", n, "shard"), "doc_id", n + 1, "grown_shard")
    groups = settle(groups.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(BUCKETS)).cast("int")))
    prior = lambda by, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = groups.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = counts.select("shard", "bucket", prior(["shard"], "bucket").alias("before"))
    own = prior(["shard", "bucket"], "doc_id", "size", "text_crc32")
    placed = groups.withColumn("own", own).join(F.broadcast(before), ["shard", "bucket"])  # at most n * BUCKETS rows
    slot = (F.col("before") + F.col("own") + F.col("i")).cast("long").alias("slot")
    return expanded(settle(placed), "n", "i").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
