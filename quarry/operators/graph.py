"""Neighbourhoods, closures, communities and integrity of edge tables (src, predicate, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.lineage import cut


def directed(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: node, other, predicate and direction."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "predicate", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "predicate", F.lit("in").alias("direction")))


def one_hop(edges: DataFrame, roots: DataFrame, cap: int) -> DataFrame:
    """The first edges of each root (node) in both directions."""
    w = Window.partitionBy("node").orderBy("predicate", "direction", "other")
    return directed(edges).join(roots, "node", "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def two_hops(edges: DataFrame, roots: DataFrame, container: str, end: str, cap: int) -> DataFrame:
    """Edges within two steps of each root (node).

    The second step starts at nodes first seen in the first, and does not fan out from a container to its members: an
    edge of the container predicate is skipped where the frontier node is its container, which stands at the end
    ``src`` or ``dst``. The cap counts both steps.
    """
    every = directed(edges)
    outward = "out" if end == "src" else "in"
    first = every.join(roots.distinct(), "node").select(F.col("node").alias("root"), "node", "other", "predicate", "direction", F.lit(1).alias("hop"))
    frontier = first.where("other <> root").select("root", F.col("other").alias("node")).distinct()
    second = every.join(frontier, "node").where(~((F.col("predicate") == container) & (F.col("direction") == outward))).where("other <> root")
    second = second.select("root", "node", "other", "predicate", "direction", F.lit(2).alias("hop"))
    w = Window.partitionBy("root").orderBy("hop", F.col("predicate") == container, "predicate", "node", "other", "direction")
    return first.unionByName(second).withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def expand(edges: DataFrame, roots: DataFrame, follow: list[str], depth: int) -> DataFrame:
    """Nodes that directed edges of some predicates reach, with the least depth and weight 0.5^(depth - 1)."""
    steps = edges.where(F.col("predicate").isin(follow)).select(F.col("src").alias("at"), "dst")
    seen = roots.select(F.col("node").alias("root"), F.col("node").alias("at"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.join(steps, "at").select("root", F.col("dst").alias("at")).distinct()
        frontier = cut(reached.join(seen, ["root", "at"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0").select("root", F.col("at").alias("node"), "depth", F.pow(F.lit(0.5), F.col("depth") - 1).alias("weight"))


def closure(references: DataFrame, known: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Reference closure of roots (key): every key once with its least depth, and whether it is resolved, capped or unknown.

    ``references`` has (key, target); a key first reached beyond the depth is capped.
    """
    seen = roots.select(F.col("key"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 2):
        reached = frontier.join(references, "key").select(F.col("target").alias("key")).distinct()
        frontier = cut(reached.join(seen, "key", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    there = known.select("key").distinct().withColumn("__there", F.lit(True))
    state = F.when(F.col("depth") > depth, "capped").when(F.col("__there"), "resolved").otherwise("unresolved")
    return seen.join(there, "key", "left").select("key", "depth", state.alias("state"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Duplicate node keys, self-loops and ends without a node."""
    keys = nodes.select(F.col("key"))
    duplicate = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("problem"), "key")
    loops = edges.where("src = dst").select(F.lit("self_loop").alias("problem"), F.col("src").alias("key"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct().join(keys, "key", "left_anti")
    return duplicate.unionByName(loops).unionByName(ends.select(F.lit("dangling").alias("problem"), "key")).distinct()


def community_facts(members: DataFrame, by: str, attribute: str, top: int) -> DataFrame:
    """Size of each community and its most common attributes, by count and name."""
    per = members.groupBy(by, attribute).agg(F.count("*").alias("n"))
    ranked = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(attribute).alias("v")))), 1, top), lambda x: F.concat(x["v"], F.lit("="), (-x["n"]).cast("string")))
    return per.groupBy(by).agg(F.sum("n").alias("size"), ranked.alias("top"))


def refresh(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """New, changed, unchanged and removed communities by the digest of their inputs."""
    o, n = old.select(key, F.col(digest).alias("__old")), new.select(key, F.col(digest).alias("__new"))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, state.alias("state"))


def label_communities(edges: DataFrame, rounds: int) -> DataFrame:
    """Communities by label propagation: each node takes the label that most neighbours have, the least of equal ones.

    A deterministic stand-in for modularity methods; labels start as the nodes' own names.
    """
    both = directed(edges).select("node", "other").distinct()
    labels = both.select("node", F.col("node").alias("label")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("label").alias("label"))).alias("best")).select("node", F.col("best.label").alias("label")))
    return labels


def ancestors_by_depth(rows: DataFrame, by: str, order: str, depth: str, name: str) -> DataFrame:
    """Parents in a pre-order list with depths: the last row before with a depth one less.

    Rows meet the rows one level up in one window over each level, so that no row carries what comes before it.
    """
    key = lambda d: F.col(depth) + d
    own = F.struct(*rows.columns)
    above = rows.select(F.col(by).alias("in"), key(0).alias("level"), F.col(order).alias("at"), F.lit(0).alias("child"), F.struct(F.col(name).alias("name")).alias("parent"), F.lit(None).alias("row"))
    below = rows.select(F.col(by).alias("in"), key(-1).alias("level"), F.col(order).alias("at"), F.lit(1).alias("child"), F.lit(None).alias("parent"), own.alias("row"))
    w = Window.partitionBy("in", "level").orderBy("at", "child").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = above.unionByName(below).withColumn("parent", F.last("parent", ignorenulls=True).over(w)).where("child = 1")
    return found.select("row.*", F.col("parent.name").alias("parent"))


def waves(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Topological waves of a small DAG of (before, after); a cycle raises. Runs on the driver, as a plan of jobs does."""
    nodes = {n for e in edges for n in e}
    before = {n: {a for a, b in edges if b == n} for n in nodes}
    out: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(nodes):
        now = sorted(n for n in nodes - done if before[n] <= done)
        if not now:
            raise ValueError("the graph has a cycle")
        out.append(now)
        done |= set(now)
    return out


def downstream(edges: list[tuple[str, str]], changed: set[str]) -> set[str]:
    """All nodes after changed ones."""
    out = set(changed)
    while more := {b for a, b in edges if a in out} - out:
        out |= more
    return out - changed
