"""Queries of graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph as op
from quarry.registry import query
from quarry.sources import concepts as c

BOTH = """both_ways AS (SELECT src AS node, dst AS other, predicate, 'out' AS direction FROM structure UNION ALL SELECT dst, src, predicate, 'in' FROM structure)"""


@query(c.with_(c.STRUCTURE, BOTH) + """SELECT node, other, predicate, direction, place::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY predicate, direction, other) AS place FROM both_ways WHERE starts_with(node, 'nation:')) WHERE place <= 20""")
def neighbourhood_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First twenty edges of each nation (the limit is the feature)."""
    roots = c.entities(spark, sf_dir).where("entity_type = 'nation'").select(F.col("entity_key").alias("node"))
    return op.one_hop(c.structure(spark, sf_dir), roots, 20)


@query(c.with_(c.STRUCTURE, BOTH) + """, r AS (SELECT 'customer:' || c_custkey AS node FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation),
one AS (SELECT b.node AS root, b.node, b.other, b.predicate, b.direction, 1 AS hop FROM both_ways b JOIN r USING (node)),
two AS (SELECT f.root, b.node, b.other, b.predicate, b.direction, 2 AS hop FROM both_ways b JOIN (SELECT DISTINCT root, other AS node FROM one WHERE other <> root) f ON b.node = f.node
  WHERE NOT (b.predicate = 'PART_OF' AND b.direction = 'in') AND b.other <> f.root)
SELECT root, node, other, predicate, direction, hop, place::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY root ORDER BY hop, predicate = 'PART_OF', predicate, node, other, direction) AS place FROM (SELECT * FROM one UNION ALL SELECT * FROM two)) WHERE place <= 40""")
def neighbourhood_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hop neighbourhoods of customers and nations, forty edges each (the limit is the feature)."""
    roots = c.entities(spark, sf_dir).where("entity_type in ('customer', 'nation')").select(F.col("entity_key").alias("node"))
    return op.two_hops(c.structure(spark, sf_dir), roots, "PART_OF", "dst", 40)


REFS = "refs AS (SELECT p_partkey AS key, (p_partkey * 3 + p_size) % 2100 AS target FROM part)"


@query("WITH RECURSIVE " + REFS + """, walk(key, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 100 = 0 UNION SELECT r.target, w.depth + 1 FROM walk w JOIN refs r ON w.key = r.key WHERE w.depth <= 4),
least AS (SELECT key, min(depth) AS depth FROM walk GROUP BY 1)
SELECT key, depth, CASE WHEN depth > 4 THEN 'capped' WHEN key IN (SELECT p_partkey FROM part) THEN 'resolved' ELSE 'unresolved' END AS state FROM least""")
def reference_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closure of references to depth four."""
    p = c.read(spark, sf_dir, "part")
    refs = p.select(F.col("p_partkey").alias("key"), ((F.col("p_partkey") * 3 + F.col("p_size")) % 2100).alias("target"))
    return op.closure(refs, p.select(F.col("p_partkey").alias("key")), p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("key")), 4)


@query("WITH RECURSIVE " + c.STRUCTURE + """, walk(root, node, depth) AS (SELECT src, dst, 1 FROM structure WHERE starts_with(src, 'supplier:') UNION SELECT w.root, s.dst, w.depth + 1 FROM walk w JOIN structure s ON w.node = s.src WHERE w.depth < 3)
SELECT root, node, min(depth) AS depth, pow(0.5::DOUBLE, min(depth) - 1) AS weight FROM walk GROUP BY 1, 2""")
def directed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers are part of, within three steps."""
    roots = c.entities(spark, sf_dir).where("entity_type = 'supplier'").select(F.col("entity_key").alias("node"))
    return op.expand(c.structure(spark, sf_dir), roots, ["PART_OF"], 3)


@query("""SELECT DISTINCT s_suppkey AS provision, l_partkey AS rule, o_custkey AS work FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
WHERE s_suppkey % 10 = 3 AND l_returnflag = 'R' AND o_orderstatus = 'P'""")
def impact_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that changed provisions reach through rules and evaluations."""
    s = c.read(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("provision"))
    x = c.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("provision"), F.col("l_partkey").alias("rule"), "l_orderkey")
    o = c.read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("work"))
    return x.join(s, "provision").join(o, "l_orderkey").select("provision", "rule", "work").distinct()


@query("""WITH per AS (SELECT c_nationkey AS community, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT community, sum(n)::BIGINT AS size, list(v || '=' || n ORDER BY n DESC, v)[1:3] AS top FROM per GROUP BY 1""")
def community_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and commonest segments of each nation's customers."""
    members = c.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_mktsegment").alias("segment"))
    return op.community_facts(members, "community", "segment", 3)


@query("""WITH old AS (SELECT c_custkey % 60 AS community, sum(c_nationkey)::BIGINT AS digest FROM customer WHERE c_custkey % 60 < 50 GROUP BY 1),
new AS (SELECT c_custkey % 60 AS community, sum(c_nationkey)::BIGINT AS digest FROM customer WHERE c_custkey % 60 > 9 AND NOT (c_custkey % 4 = 0 AND c_custkey > 1000) GROUP BY 1)
SELECT community, CASE WHEN o.digest IS NULL THEN 'new' WHEN n.digest IS NULL THEN 'removed' WHEN o.digest = n.digest THEN 'unchanged' ELSE 'changed' END AS state FROM old o FULL JOIN new n USING (community)""")
def community_refresh_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities whose inputs changed."""
    x = c.read(spark, sf_dir, "customer").withColumn("community", F.col("c_custkey") % 60)
    digest = F.sum("c_nationkey").alias("digest")
    old = x.where("community < 50").groupBy("community").agg(digest)
    new = x.where("community > 9 and not (c_custkey % 4 = 0 and c_custkey > 1000)").groupBy("community").agg(digest)
    return op.refresh(old, new, "community", "digest")


@query("""WITH n AS (SELECT p_partkey % 1800 AS key FROM part), e AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 20 AS dst FROM lineitem)
SELECT 'duplicate' AS problem, key FROM n GROUP BY key HAVING count(*) > 1 UNION SELECT 'self_loop', src FROM e WHERE src = dst
UNION SELECT 'dangling', k FROM (SELECT src AS k FROM e UNION SELECT dst FROM e) WHERE k NOT IN (SELECT key FROM n)""")
def integrity_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate keys, self-loops and dangling ends."""
    nodes = c.read(spark, sf_dir, "part").select((F.col("p_partkey") % 1800).alias("key"))
    edges = c.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 20).alias("dst")).distinct()
    return op.integrity(nodes, edges)


@query(c.with_(c.ENTITIES, c.STRUCTURE) + """SELECT s.src, e.name AS src_name, s.predicate, s.dst, f.name AS dst_name FROM structure s JOIN entities e ON s.src = e.entity_key JOIN entities f ON s.dst = f.entity_key
WHERE s.src = 'nation:3' OR s.dst = 'nation:3'""")
def node_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of one node with the names of both ends."""
    e = c.structure(spark, sf_dir).where("src = 'nation:3' or dst = 'nation:3'")
    names = c.entities(spark, sf_dir).select("entity_key", "name")
    side = lambda x: names.select(F.col("entity_key").alias(x), F.col("name").alias(f"{x}_name"))
    return e.join(side("src"), "src").join(side("dst"), "dst").select("src", "src_name", "predicate", "dst", "dst_name")


@query("""WITH g AS (SELECT * FROM conversations), n AS (SELECT 'session:' || conv_id AS key, 'session' AS type FROM g UNION SELECT 'role:' || role, 'role' FROM g)
SELECT type, count(*) AS n FROM n GROUP BY 1 UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT conv_id, role FROM g)""")
def session_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of sessions and their roles, counted."""
    g = c.read(spark, sf_dir, "conversations").select("conv_id", "role")
    nodes = g.select(F.concat(F.lit("session:"), F.col("conv_id").cast("string")).alias("key"), F.lit("session").alias("type")).union(g.select(F.concat(F.lit("role:"), "role"), F.lit("role"))).distinct()
    edges = g.distinct().agg(F.count("*").alias("n")).select(F.lit("edge").alias("type"), "n")
    return nodes.groupBy("type").agg(F.count("*").alias("n")).unionByName(edges)


@query(r"""SELECT host, link, count(*) AS n FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""")
def page_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages by host."""
    links = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    return c.read(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), links.alias("link")).groupBy("host", "link").agg(F.count("*").alias("n"))


@query(None)
def label_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the structure by label propagation (invariants are tested)."""
    return op.label_communities(c.structure(spark, sf_dir), 3)


@query("""SELECT conv_id, turn, role, text, CASE WHEN turn > 0 THEN turn - 1 END AS parent FROM (SELECT conv_id, turn, any_value(role) AS role, length(any_value(text)) AS text FROM conversations GROUP BY 1, 2 HAVING count(*) = 1)
WHERE turn = 0 OR (conv_id, turn - 1) IN (SELECT (conv_id, turn) FROM (SELECT conv_id, turn FROM conversations GROUP BY 1, 2 HAVING count(*) = 1))""")
def turn_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents in a pre-order list whose depth is the turn."""
    rows = c.read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.first("role").alias("role"), F.first(F.length("text")).cast("long").alias("text")).where("n = 1")
    return op.ancestors_by_depth(rows, "conv_id", "turn", "turn", "turn").where("turn = 0 or parent is not null").select("conv_id", "turn", "role", "text", "parent")
