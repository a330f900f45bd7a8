"""Queries of knowledge-graph maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.operators import knowledge as op
from quarry.operators.temporal import half_open
from quarry.registry import query
from quarry.sources import concepts as c



@query(c.with_(c.RELATIONS, c.EVIDENCE) + """SELECT relation_id, src, dst FROM relations WHERE state IN ('human_verified', 'machine_verified') AND valid_from <= TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01')
AND custkey % 2 = 0 AND EXISTS (SELECT 1 FROM evidence e WHERE e.relation_id = relations.relation_id AND e.state IN ('human_verified', 'machine_verified'))""")
def scoped_secure_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified relations of a project, in force, with verified evidence."""
    return op.secure_view(c.relations(spark, sf_dir), c.evidence(spark, sf_dir), half_open(F.lit("1998-01-01").cast("timestamp_ntz")), F.col("custkey") % 2 == 0).select("relation_id", "src", "dst")


@query(c.with_(c.STRUCTURE) + """, private AS (SELECT 'customer:' || c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'nation:7') SELECT src, predicate, dst FROM structure WHERE src NOT IN (SELECT key FROM private) AND dst NOT IN (SELECT key FROM private)""")
def scoped_private_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch no private key."""
    private = c.read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key")).union(spark.range(1).select(F.lit("nation:7")))
    _, edges = op.without_private(c.entities(spark, sf_dir).withColumnRenamed("entity_key", "key"), c.structure(spark, sf_dir), private)
    return edges.select("src", "predicate", "dst")


@query("""SELECT event_id, event_type = 'error' OR event_type = 'view' AS low FROM events""")
def low_trust_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by mark or by co-occurrence alone."""
    e = F.col("event_type")
    marks = F.when(e == "error", F.array(F.lit("candidate"))).otherwise(F.array(F.lit("x")))
    methods = F.when(e == "view", F.array(F.lit("cooccurrence"))).when(e == "click", F.array(F.lit("cooccurrence"), F.lit("rule"))).otherwise(F.expr("cast(array() as array<string>)"))
    return c.read(spark, sf_dir, "events").select("event_id", op.low_trust(marks, methods).alias("low"))


@query("""WITH cur AS (SELECT user_id, max((props->>'$.k')::INT) AS r FROM events GROUP BY 1) SELECT event_id, e.user_id FROM events e JOIN cur ON e.user_id = cur.user_id AND (props->>'$.k')::INT = r""")
def active_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each source's current revision."""
    e = c.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source_id"), F.get_json_object("props", "$.k").cast("int").alias("revision"))
    return op.active(e.groupBy("source_id").agg(F.max("revision").alias("current")), e).select("event_id", F.col("source_id").alias("user_id"))


@query("""SELECT p_partkey, min(l_suppkey) FILTER (l_returnflag = 'R') AS related FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1""")
def lateral_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least related supplier of each part over one predicate."""
    edges = c.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").alias("dst"))
    rows = c.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    return op.first_related(rows, edges, "R").select(F.col("key").alias("p_partkey"), "related")


@query("""SELECT l_orderkey AS ref, CASE WHEN l_orderkey < 500 THEN l_orderkey WHEN l_orderkey % 2 = 0 THEN -l_orderkey END AS target, CASE WHEN l_orderkey < 500 THEN 'object' WHEN l_orderkey % 2 = 0 THEN 'document' ELSE 'unresolved' END AS how FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def subject_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved by the first lookup that knows them."""
    refs = c.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref")).distinct()
    o = c.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"))
    return op.resolve(refs, [("object", o.where("ref < 500").withColumn("target", F.col("ref"))), ("document", o.where("ref % 2 = 0").withColumn("target", -F.col("ref")))])


@query(c.with_(c.RELATIONS, c.EVIDENCE) + """, e AS (SELECT relation_id, list(source_uri || '@' || locator ORDER BY source_uri, locator)[1:2] AS evidences FROM evidence GROUP BY 1) SELECT r.relation_id, coalesce(evidences, []) AS evidences FROM relations r LEFT JOIN e USING (relation_id) WHERE state <> 'unverified'""")
def evidence_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with their first two evidences."""
    out = op.attach(c.relations(spark, sf_dir).where("state <> 'unverified'"), c.evidence(spark, sf_dir), 2)
    return out.select("relation_id", F.transform("evidences", lambda e: F.concat(e["source_uri"], F.lit("@"), e["locator"].cast("string"))).alias("evidences"))


@query("""WITH g AS (SELECT l_suppkey AS project, l_partkey % 10 AS kind, l_partkey % 30 AS grp, count(*) FILTER (l_linestatus = 'O' AND l_suppkey % 4 <> 0) AS current FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2, 3)
SELECT project, kind, grp, current FROM g QUALIFY current > 0 OR max(CASE WHEN current > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY project, kind) = 0""")
def superseded_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that are not wholly superseded, or all where none is left."""
    x = c.read(spark, sf_dir, "lineitem").where("l_quantity > 45")
    g = x.groupBy(F.col("l_suppkey").alias("project"), (F.col("l_partkey") % 10).alias("kind"), (F.col("l_partkey") % 30).alias("grp")).agg(F.count_if((F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 4 != 0)).alias("current"))
    return op.current_or_last(g, ["project", "kind"])


@query("""SELECT o_orderkey AS job_id FROM orders ORDER BY o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END DESC NULLS LAST, o_orderdate, o_orderkey LIMIT 100""")
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hundred jobs of a queue (the limit is the feature)."""
    jobs = c.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("mtime"), F.col("o_orderdate").alias("created_at"))
    return jobs.orderBy(*op.queue_order()).limit(100).select("job_id")


@query("""SELECT p_name AS key, count(*) AS occurrences, list(p_size ORDER BY p_partkey)[1:10] AS areas, list(p_partkey ORDER BY p_partkey)[1:10] AS ids FROM part GROUP BY 1""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each name with the first ten areas and ids."""
    return op.merged_entities(c.read(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("id"), F.col("p_size").alias("area")), "key", 10)


@query("""WITH n AS (SELECT 'b:' || p_brand AS key, p_brand AS name FROM part UNION SELECT 't:' || p_type, p_type FROM part), e AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT 'node' AS part, key, name FROM n UNION ALL SELECT 'edge', 'b:' || p_brand, 't:' || p_type FROM e""")
def kg_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of brands and types, each once."""
    p = c.read(spark, sf_dir, "part")
    node = lambda x, y: p.select(F.concat(F.lit(f"{x}:"), y).alias("key"), F.col(y).alias("name"))
    edges = p.select(F.concat(F.lit("b:"), "p_brand").alias("src"), F.concat(F.lit("t:"), "p_type").alias("dst"))
    nodes, links = op.build({"brands": (node("b", "p_brand"), edges), "types": (node("t", "p_type"), edges.limit(0))})
    return nodes.select(F.lit("node").alias("part"), "key", "name").unionByName(links.select(F.lit("edge").alias("part"), F.col("src").alias("key"), F.col("dst").alias("name")))


@query("""SELECT l.object_id, coalesce(nullif(own, ''), d.s, p.s) AS storey FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS object_id, l_orderkey, l_partkey, CASE WHEN l_linenumber = 1 THEN '1F' ELSE '' END AS own FROM lineitem) l
LEFT JOIN (SELECT o_orderkey, '2F' AS s FROM orders WHERE o_orderkey % 3 = 0) d ON l_orderkey = o_orderkey LEFT JOIN (SELECT p_partkey, 'B' || (p_partkey % 3 + 1) AS s FROM part WHERE p_partkey % 2 = 0) p ON l_partkey = p_partkey""")
def storey_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing storeys from the document, then from the part."""
    x = c.read(spark, sf_dir, "lineitem").select(F.concat_ws("-", *(F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("object_id"), "l_orderkey", "l_partkey", F.when(F.col("l_linenumber") == 1, "1F").otherwise("").alias("storey"))
    by_doc = c.read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("2F").alias("storey"))
    by_part = c.read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("B"), (F.col("p_partkey") % 3 + 1).cast("string")).alias("storey"))
    return op.backfill(x, [("l_orderkey", by_doc), ("l_partkey", by_part)]).select("object_id", "storey")


@query(c.with_(c.FACTS) + """SELECT fact_id, CASE WHEN superseded_at IS NULL AND subject % 10 = 0 THEN TIMESTAMP '2002-01-01' ELSE superseded_at END AS superseded_at FROM facts
UNION ALL SELECT 'new-' || fact_id, NULL FROM facts WHERE subject % 10 = 0""")
def fact_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New facts close the open ones that they replace."""
    f = c.facts(spark, sf_dir)
    new = f.where("subject % 10 = 0").withColumn("fact_id", F.concat(F.lit("new-"), "fact_id")).withColumn("superseded_at", F.lit(None).cast("timestamp_ntz"))
    return op.supersede(f, new, F.lit("2002-01-01").cast("timestamp_ntz")).select("fact_id", "superseded_at")


@query("""SELECT p_partkey, list_concat(CASE WHEN p_size > 45 THEN ['too_large'] ELSE [] END, CASE WHEN p_name LIKE 'small%' THEN ['vague_name'] ELSE [] END, CASE WHEN p_retailprice > 1000 THEN ['dear'] ELSE [] END) AS problems FROM part WHERE p_size > 45 OR p_name LIKE 'small%' OR p_retailprice > 1000""")
def metadata_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of failed checks of each row."""
    return op.problems(c.read(spark, sf_dir, "part"), "p_partkey", {"too_large": F.col("p_size") > 45, "vague_name": F.col("p_name").startswith("small"), "dear": F.col("p_retailprice") > 1000})


@query("""WITH s AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A')::DOUBLE / count(*) AS recall, sum(l_quantity) AS mrr, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey FROM s WHERE n >= 5 QUALIFY rank() OVER (ORDER BY round(recall, 2) DESC, mrr DESC) = 1""")
def provider_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best provider behind a gate by recall, then by rank quality."""
    s = c.read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") == "A") / F.count("*")).alias("recall"), F.sum("l_quantity").alias("mrr"), F.count("*").alias("n"))
    return op.lexicographic_best(s, F.col("n") >= 5, [F.desc(F.round("recall", 2)), F.desc("mrr")]).select("l_suppkey")


@query("""WITH r AS (SELECT p_partkey AS record_id, CASE WHEN p_partkey % 4 = 0 THEN [p_partkey + 1, p_partkey + 2] ELSE [] END AS supersedes, p_partkey % 9 = 0 AS revoked FROM part) SELECT record_id FROM r WHERE NOT revoked AND record_id NOT IN (SELECT unnest(supersedes) FROM r)""")
def active_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that nothing supersedes or revokes."""
    k = F.col("p_partkey")
    r = c.read(spark, sf_dir, "part").select(k.alias("record_id"), F.when(k % 4 == 0, F.array(k + 1, k + 2)).otherwise(F.expr("cast(array() as array<bigint>)")).alias("supersedes"), (k % 9 == 0).alias("revoked"))
    return op.active_records(r).select("record_id")


@query("""WITH e AS (SELECT l_partkey, l_returnflag, l_suppkey AS evidence_id, count(*) OVER (PARTITION BY l_partkey, l_returnflag) > 1 AS conflict FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R') QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_shipdate DESC, l_suppkey) = 1),
o AS (SELECT DISTINCT l_partkey, k AS l_returnflag FROM lineitem, (VALUES ('A'), ('R')) t(k)) SELECT l_partkey, l_returnflag, evidence_id, coalesce(conflict, false) AS conflict FROM o LEFT JOIN e USING (l_partkey, l_returnflag)""")
def latest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest active evidence of each required kind, whether others compete, and what is missing."""
    x = c.read(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", F.col("l_suppkey").alias("evidence_id"), F.col("l_shipdate").cast("timestamp").alias("seen_at"))
    return op.latest_evidence(x, "l_partkey", "l_returnflag", F.col("l_linestatus") == "F", ["A", "R"])


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 3 + 1 AS dst FROM part), walk(node) AS (SELECT p_partkey FROM part WHERE p_partkey < 3 UNION SELECT dst FROM walk JOIN e ON node = src) SELECT node FROM walk""")
def definition_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that roots reach, however deep."""
    k = F.col("p_partkey")
    p = c.read(spark, sf_dir, "part")
    return op.reachable(p.select(k.alias("src"), (k * 3 + 1).alias("dst")), p.where("p_partkey < 3").select(k.alias("node")))


@query("""SELECT key, min(part)::INT AS part FROM (SELECT p_partkey AS key, 0 AS part FROM part WHERE p_size = 7 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_brand = 'Brand#2' UNION ALL SELECT p_partkey, 2 FROM part WHERE p_type = 'ECONOMY') GROUP BY 1 ORDER BY part, key LIMIT 150""")
def scoped_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required, then matching, then filling rows, 150 at most (the limit is the feature)."""
    p = c.read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "key")
    return op.prioritised([p.where("p_size = 7"), p.where("p_brand = 'Brand#2'"), p.where("p_type = 'ECONOMY'")], "key", 150)


@query("""WITH v AS (SELECT l_partkey, l_returnflag AS code, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_partkey, sum(n)::BIGINT AS votes, first(code ORDER BY n DESC, code) AS code, max(n) AS top FROM v GROUP BY 1)
SELECT l_partkey, votes, code, round(least(0.8::DOUBLE, 0.5::DOUBLE + 0.3::DOUBLE * top / votes), 6) AS confidence FROM t WHERE votes >= 5""")
def layer_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most voted code of each part."""
    return op.votes(c.read(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", "l_linenumber", 5)


@query(r"""SELECT p_partkey, left(trim(regexp_replace(concat_ws(' ', p_name, '  ' || p_brand, p_size), '\s+', ' ', 'g')), 2000) AS text FROM part""")
def node_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search text of nodes, collapsed and cut (the length is the feature)."""
    p = c.read(spark, sf_dir, "part").withColumn("brand", F.concat(F.lit("  "), "p_brand"))
    return p.select("p_partkey", op.search_text(["p_name", "brand", "p_size"], 2000).alias("text"))


@query("""SELECT c_nationkey AS project, count(DISTINCT o_orderkey) AS drawings, count(DISTINCT o_orderpriority) AS disciplines, count(DISTINCT o_orderstatus) AS file_types FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def project_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings, disciplines and file types of each project."""
    x = c.read(spark, sf_dir, "customer").join(c.read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return x.groupBy(F.col("c_nationkey").alias("project")).agg(F.countDistinct("o_orderkey").alias("drawings"), F.countDistinct("o_orderpriority").alias("disciplines"), F.countDistinct("o_orderstatus").alias("file_types"))


@query("""WITH t AS (SELECT c_nationkey AS project, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT project, c_mktsegment AS kind, n FROM t QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, kind) <= 3""")
def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three largest kinds of each project, as questions with known answers."""
    t = c.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n"))
    return t.withColumn("nr", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "kind"))).where("nr <= 3").drop("nr")


@query("""SELECT l_orderkey, bool_and(p_partkey IS NOT NULL AND l_orderkey % 7 <> 0) AS valid FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 50 GROUP BY 1""")
def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every citation of an answer exists and belongs."""
    p = c.read(spark, sf_dir, "part").where("p_size < 50").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("there"))
    x = c.read(spark, sf_dir, "lineitem").join(p, "l_partkey", "left")
    return x.groupBy("l_orderkey").agg(F.bool_and(F.col("there").isNotNull() & (F.col("l_orderkey") % 7 != 0)).alias("valid"))


PACK = """pn AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN 'x:' ELSE 'kb:' END || CASE WHEN p_partkey % 53 = 0 THEN 1 ELSE p_partkey END AS id, p_type AS type, CASE WHEN p_partkey % 89 <> 0 THEN p_name END AS name FROM part),
pe AS (SELECT 'kb:' || l_partkey AS src, CASE WHEN l_quantity < 50 THEN l_returnflag ELSE '' END AS predicate, 'kb:' || l_suppkey AS dst FROM lineitem), pa AS (SELECT p_name AS alias, 'kb:' || (p_partkey + p_size) AS node_id FROM part)"""


@query("WITH " + PACK + """ SELECT 'incomplete node' AS problem, id AS key FROM pn WHERE coalesce(id, '') = '' OR coalesce(type, '') = '' OR coalesce(name, '') = ''
UNION SELECT 'foreign id', id FROM pn WHERE NOT starts_with(id, 'kb:') UNION SELECT 'duplicate id', id FROM pn GROUP BY id HAVING count(*) > 1
UNION SELECT 'unknown source', src FROM pe WHERE src NOT IN (SELECT id FROM pn) UNION SELECT 'unknown target', dst FROM pe WHERE dst NOT IN (SELECT id FROM pn)
UNION SELECT 'edge without predicate', src FROM pe WHERE coalesce(predicate, '') = '' UNION SELECT 'unknown alias node', alias FROM pa WHERE node_id NOT IN (SELECT id FROM pn)""")
def pack_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a pack made of parts and lines may not be loaded."""
    k = F.col("p_partkey")
    number = F.when(k % 53 == 0, 1).otherwise(k).cast("string")
    p = c.read(spark, sf_dir, "part")
    nodes = p.select(F.concat(F.when(k % 97 == 0, "x:").otherwise("kb:"), number).alias("id"), F.col("p_type").alias("type"), F.when(k % 89 != 0, F.col("p_name")).alias("name"))
    of = lambda x: F.concat(F.lit("kb:"), F.col(x).cast("string"))
    edges = c.read(spark, sf_dir, "lineitem").select(of("l_partkey").alias("src"), F.when(F.col("l_quantity") < 50, F.col("l_returnflag")).otherwise("").alias("predicate"), of("l_suppkey").alias("dst"))
    aliases = p.select(F.col("p_name").alias("alias"), F.concat(F.lit("kb:"), (k + F.col("p_size")).cast("string")).alias("node_id"))
    return op.pack_problems(nodes, edges, aliases, "kb:")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 3 = 0 THEN ' ' || (p_size % 9 + 1) ELSE '' END END AS name, CASE WHEN p_partkey % 3 <> 2 THEN (100 + p_size)::VARCHAR END AS number,
  CASE WHEN p_partkey % 3 <> 2 THEN p_size + 0.5::DOUBLE END AS area, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) || (p_size % 9 + 1) END AS compact FROM part WHERE split_part(p_name, ' ', 2) IN ('ring', 'bolt', 'gear')""")
def room_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms parsed from labels; some labels are none."""
    k, size = F.col("p_partkey"), F.col("p_size")
    word = F.element_at(F.split("p_name", " "), 2)
    tail = F.concat(F.lit(" ("), size.cast("string"), F.lit(",5 m2)"))
    number = F.concat((size + 100).cast("string"), F.lit("호 "))
    text = F.when(k % 3 == 0, F.concat(number, word, F.lit(" "), (size % 9 + 1).cast("string"), tail)).when(k % 3 == 1, F.concat(number, word, tail)).otherwise(F.concat(F.lit("detail of the "), word))
    rows = c.read(spark, sf_dir, "part").where(word.isin("ring", "bolt", "gear")).withColumn("room", rules.room(text, ["ring", "bolt", "gear"]))
    return rows.select("p_partkey", "room.name", "room.number", "room.area", F.get("room.aliases", 1).alias("compact"))
