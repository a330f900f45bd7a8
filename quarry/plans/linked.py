"""Queries that follow links between tables: scopes, owners, citations, sessions and audited decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as text_fn
from quarry.functions import vector as vec
from quarry.operators import records, text
from quarry.registry import query
from quarry.sources import concepts as c


@query("""WITH n AS (SELECT p_partkey, '["' || p_brand || '","' || p_type || '","' || split_part(p_name, ' ', 2) || '"]' AS names FROM part)
SELECT p_partkey FROM n WHERE EXISTS (SELECT 1 FROM (SELECT unnest(from_json(names, '["VARCHAR"]')) AS name) WHERE name IN ('ring', 'PROMO'))""")
def json_array_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts one of whose names, a JSON array, is asked for."""
    names = F.concat(F.lit('["'), "p_brand", F.lit('","'), "p_type", F.lit('","'), F.element_at(F.split("p_name", " "), 2), F.lit('"]'))
    asked = F.array(F.lit("ring"), F.lit("PROMO"))
    return c.read(spark, sf_dir, "part").where(F.arrays_overlap(F.from_json(names, "array<string>"), asked)).select("p_partkey")


@query("""SELECT c_nationkey AS storey, count(*) AS objects, coalesce(list(c_name || '=' || c_custkey ORDER BY c_name, c_custkey) FILTER (c_mktsegment = 'MACHINERY'), []) AS spaces FROM customer GROUP BY 1""")
def spaces_per_storey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each storey, and its spaces in order of their names."""
    space = F.when(F.col("c_mktsegment") == "MACHINERY", F.struct("c_name", "c_custkey"))
    rows = c.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("storey")).agg(F.count("*").alias("objects"), F.array_sort(F.collect_list(space)).alias("s"))
    return rows.select("storey", "objects", F.transform("s", lambda x: F.concat(x["c_name"], F.lit("="), x["c_custkey"].cast("string"))).alias("spaces"))


@query("""WITH acl AS (SELECT s_suppkey AS member, s_nationkey AS project FROM supplier WHERE s_acctbal > 0)
SELECT a.member, o_orderkey AS work, o_custkey AS owner FROM orders JOIN customer ON o_custkey = c_custkey JOIN acl a ON a.project = c_nationkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""")
def works_with_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open works of the projects that each member may see."""
    acl = c.read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("member"), F.col("s_nationkey").alias("c_nationkey"))
    owners = c.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    works = c.read(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").join(owners, "o_custkey")
    return works.join(acl, "c_nationkey").select("member", F.col("o_orderkey").alias("work"), F.col("o_custkey").alias("owner"))


@query(c.with_(c.OBJECTS, c.BOXES) + """, cites AS (SELECT l_orderkey AS answer, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS object_id, l_partkey AS box_id, CASE WHEN l_quantity > 40 THEN l_orderkey + 1 ELSE l_orderkey END AS cited FROM lineitem)
SELECT x.answer, x.object_id, CASE WHEN o.object_id IS NULL OR d.o_orderkey IS NULL THEN 'missing' WHEN o.document <> x.cited THEN 'elsewhere' WHEN b.box_id IS NULL THEN 'no box' ELSE 'verified' END AS state, b.x0, b.y0
FROM cites x LEFT JOIN (SELECT DISTINCT object_id, document FROM objects WHERE state = 'OBSERVED') o ON o.object_id = x.object_id LEFT JOIN orders d ON d.o_orderkey = x.cited LEFT JOIN (SELECT * FROM boxes WHERE x1 - x0 > 10) b ON b.box_id = x.box_id""")
def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations followed from the object to its document and box, with what is wrong."""
    cited = F.when(F.col("l_quantity") > 40, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey"))
    object_id = F.concat_ws("-", *(F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    cites = c.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), object_id.alias("object_id"), F.col("l_partkey").alias("box_id"), cited.alias("cited"))
    objects = c.objects(spark, sf_dir).where("state = 'OBSERVED'").select("object_id", "document").distinct()
    documents = c.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cited"), F.lit(True).alias("there"))
    boxes = c.boxes(spark, sf_dir).where("x1 - x0 > 10").select("box_id", "x0", "y0")
    rows = cites.join(objects, "object_id", "left").join(documents, "cited", "left").join(boxes, "box_id", "left")
    state = F.when(F.col("document").isNull() | F.col("there").isNull(), "missing").when(F.col("document") != F.col("cited"), "elsewhere").when(F.col("x0").isNull(), "no box").otherwise("verified")
    return rows.select("answer", "object_id", state.alias("state"), "x0", "y0")


@query(c.with_(c.FILES) + """, asked AS (SELECT sha256(text) AS sha256 FROM documents WHERE doc_id % 20 = 0) SELECT f.sha256, min(f.path) AS owner, count(*) AS copies FROM files f WHERE f.sha256 IN (SELECT sha256 FROM asked) GROUP BY 1""")
def owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner and copies of the contents that are asked for, every twentieth document's."""
    asked = c.read(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.sha2("text", 256).alias("sha256")).distinct()
    return c.files(spark, sf_dir).join(asked, "sha256", "left_semi").groupBy("sha256").agg(F.min("path").alias("owner"), F.count("*").alias("copies"))


@query("WITH RECURSIVE n AS (SELECT event_id, user_id AS subject, value::BIGINT % 6 AS expected, event_type AS decision, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr FROM events), " + """walk(event_id, subject, nr, head, ok) AS (
  SELECT event_id, subject, nr, CASE WHEN expected = 0 THEN 1 ELSE 0 END, expected = 0 OR expected + 1 = 0 FROM n WHERE nr = 1 UNION ALL
  SELECT n.event_id, n.subject, n.nr, CASE WHEN n.expected = w.head OR n.expected + 1 = w.head THEN n.expected + 1 ELSE w.head END, n.expected = w.head OR n.expected + 1 = w.head FROM walk w JOIN n ON n.subject = w.subject AND n.nr = w.nr + 1)
SELECT w.event_id, w.subject, n.decision, ok AS accepted, CASE WHEN ok THEN head END AS version FROM walk w JOIN n ON n.event_id = w.event_id""")
def decision_compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions that name the version they were made on: which were accepted, and the version each made."""
    e = c.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("decision"), F.col("ts").alias("at"), (F.bround("value").cast("long") % 6).alias("expected"))
    rows = records.compare_and_set(e.withColumn("revision", F.col("expected") + 1), "subject", 0)
    return rows.select("event_id", "subject", "decision", "accepted", F.when(F.col("accepted"), F.col("revision")).alias("version"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn, role, length(text) AS n FROM conversations)
SELECT 'node' AS part, 'session:' || conv_id AS src, 'Session' AS type, NULL::VARCHAR AS dst FROM t UNION SELECT 'node', 'agent:' || role, 'Agent', NULL FROM t UNION SELECT 'node', 'turn:' || conv_id || '/' || turn, 'Turn', NULL FROM t
UNION SELECT 'edge', 'session:' || conv_id, 'HAS_TURN', 'turn:' || conv_id || '/' || turn FROM t UNION SELECT 'edge', 'turn:' || conv_id || '/' || turn, 'BY', 'agent:' || role FROM t
UNION SELECT 'edge', 'turn:' || a.conv_id || '/' || a.turn, 'NEXT', 'turn:' || b.conv_id || '/' || b.turn FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def session_graph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of sessions: their turns, who speaks and what follows."""
    t = c.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    text_of = lambda kind, *cols: F.concat(F.lit(f"{kind}:"), F.concat_ws("/", *(x.cast("string") for x in cols)))
    session, agent = text_of("session", F.col("conv_id")), text_of("agent", F.col("role"))
    turn, following = text_of("turn", F.col("conv_id"), F.col("turn")), text_of("turn", F.col("conv_id"), F.col("turn") + 1)
    node = lambda key, kind: F.struct(F.lit("node").alias("part"), key.alias("src"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("dst"))
    edge = lambda src, kind, dst: F.struct(F.lit("edge").alias("part"), src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
    rows = t.select(F.explode(F.array(node(session, "Session"), node(agent, "Agent"), node(turn, "Turn"), edge(session, "HAS_TURN", turn), edge(turn, "BY", agent))).alias("x")).select("x.*")
    has_next = t.select("conv_id", "turn").distinct().join(t.select("conv_id", (F.col("turn") - 1).alias("turn")).distinct(), ["conv_id", "turn"], "left_semi")
    return rows.unionByName(has_next.select(F.lit("edge").alias("part"), turn.alias("src"), F.lit("NEXT").alias("type"), following.alias("dst"))).distinct()


@query("""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 1) SELECT d.doc_id, e.vec_id, round(coalesce(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0), 6) AS score
FROM documents d CROSS JOIN q LEFT JOIN (SELECT doc_id % 700 AS content, doc_id FROM documents) m ON m.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = m.content""")
def object_vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by the vector of their content; those without one score 0."""
    probe = c.read(spark, sf_dir, "embeddings").where("vec_id = 1").first()["embedding"]
    scores = c.read(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("vec_id").alias("content"), vec.cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in probe))).alias("score"))
    mapping = c.read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 700).alias("content"))
    return mapping.join(scores, "content", "left").select("doc_id", "vec_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


TOKENS = r"toks AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS tokens FROM documents)"


@query("WITH " + TOKENS + """, q AS (SELECT unnest(['token', 'password', 'secret']) AS term), post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), w AS (SELECT count(*) AS docs, avg(len(tokens)::DOUBLE) AS avg_len FROM toks),
s AS (SELECT doc_id, source, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tokens)::DOUBLE / avg_len)))), 6) AS score FROM post JOIN df USING (term) JOIN toks USING (doc_id) CROSS JOIN w GROUP BY 1, 2),
acl AS (SELECT DISTINCT role AS member, source FROM conversations, (SELECT DISTINCT source FROM documents) WHERE length(role) % 2 = length(source) % 2 OR role = 'system')
SELECT member, doc_id, score, row_number() OVER (PARTITION BY member ORDER BY score DESC, doc_id)::INT AS place FROM s JOIN acl USING (source) QUALIFY place <= 10""")
def scoped_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for a question among those that each member may read (the limit is the feature)."""
    d = c.read(spark, sf_dir, "documents")
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.array(*map(F.lit, ("token", "password", "secret"))).alias("terms"))
    scored = text.bm25(d.select("doc_id", text_fn.tokens(F.col("text")).alias("tokens")), asked).join(d.select("doc_id", "source"), "doc_id")
    sources = d.select("source").distinct()
    may = (F.length("role") % 2 == F.length("source") % 2) | (F.col("role") == "system")
    acl = c.read(spark, sf_dir, "conversations").select("role").distinct().join(sources, may).select(F.col("role").alias("member"), "source")
    return text.top(scored.join(acl, "source"), "member", 10, "doc_id").select("member", "doc_id", "score", "place")


@query("""WITH o AS (SELECT p_partkey, p_size % 4 AS known, p_size % 3 AS hit FROM part) SELECT p_partkey, 'flood' AS overlay, CASE WHEN hit = 0 THEN 'present' ELSE 'absent' END AS state FROM o WHERE known <> 0
UNION ALL SELECT p_partkey, 'heritage', CASE WHEN hit = 1 THEN 'present' ELSE 'absent' END FROM o WHERE known > 1 OR hit = 1""")
def overlay_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether overlays cover a parcel; where a layer is not known to be complete, absence is withheld."""
    known, hit = F.col("p_size") % 4, F.col("p_size") % 3
    state = lambda there, complete: F.when(there, "present").when(complete, "absent")
    flood = F.struct(F.lit("flood").alias("overlay"), F.when(known != 0, state(hit == 0, F.lit(True))).alias("state"))
    heritage = F.struct(F.lit("heritage").alias("overlay"), state(hit == 1, known > 1).alias("state"))
    rows = c.read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(flood, heritage)).alias("x")).select("p_partkey", "x.*")
    return rows.where("state is not null")


@query(
    """WITH live AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN p_name || '!' ELSE p_name END AS name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS brand, p_size AS size FROM part WHERE p_partkey % 10 <> 0)
SELECT p_partkey AS key, list_filter([CASE WHEN p_name IS DISTINCT FROM name THEN 'name' END, CASE WHEN p_brand IS DISTINCT FROM brand THEN 'brand' END, CASE WHEN p_size IS DISTINCT FROM size THEN 'size' END], lambda x: x IS NOT NULL) AS reasons,
  CASE WHEN key IS NULL THEN 'missing' WHEN p_name IS DISTINCT FROM name OR p_brand IS DISTINCT FROM brand OR p_size IS DISTINCT FROM size THEN 'mismatch' ELSE 'match' END AS state FROM part LEFT JOIN live ON key = p_partkey"""
)
def identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether live rows are what their sources say, and in which fields they are not."""
    p, k = c.read(spark, sf_dir, "part"), F.col("p_partkey")
    live = p.where("p_partkey % 10 <> 0").select(k, F.when(k % 7 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("name"), F.when(k % 11 != 0, F.col("p_brand")).alias("brand"), F.col("p_size").alias("size"), F.lit(True).alias("there"))
    differs = lambda field: F.when(~F.col(f"p_{field}").eqNullSafe(F.col(field)), field)
    rows = p.join(live, "p_partkey", "left").withColumn("reasons", F.array_compact(F.array(*map(differs, ("name", "brand", "size")))))
    return rows.select(k.alias("key"), "reasons", F.when(F.col("there").isNull(), "missing").when(F.size("reasons") > 0, "mismatch").otherwise("match").alias("state"))


@query(
    c.with_(c.OBJECTS)
    + """SELECT DISTINCT left(sha256(object_id || '|' || document), 16) AS record_id, lower(kind) AS kind, label || ' ' || block || ' on ' || layer AS text, 'doc/' || document || '#' || layer AS locator, state = 'OBSERVED' AS citable FROM objects"""
)
def record_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a snapshot as records with text, locator and whether they may be cited."""
    o, at = c.objects(spark, sf_dir), lambda x: F.col(x).cast("string")
    return o.select(
        F.left(F.sha2(F.concat_ws("|", "object_id", at("document")), 256), F.lit(16)).alias("record_id"),
        F.lower("kind").alias("kind"),
        F.concat(F.concat_ws(" ", "label", "block"), F.lit(" on "), "layer").alias("text"),
        F.concat(F.lit("doc/"), at("document"), F.lit("#"), "layer").alias("locator"),
        (F.col("state") == "OBSERVED").alias("citable"),
    ).distinct()


@query(
    c.with_(c.FILES)
    + """SELECT 'empty' AS finding, path FROM files WHERE bytes = 0 UNION ALL SELECT 'oversize', path FROM files WHERE bytes > 20000 UNION ALL SELECT 'unsupported', path FROM files WHERE ext NOT IN ('en', 'de', 'fr')
UNION ALL SELECT 'duplicate', path FROM files QUALIFY count(*) OVER (PARTITION BY sha256) > 1 AND path <> min(path) OVER (PARTITION BY sha256)"""
)
def preflight_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collection's files fail before they are taken in."""
    f = c.files(spark, sf_dir)
    first = f.groupBy("sha256").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = f.join(first, "sha256").where("path <> first").select(F.lit("duplicate").alias("finding"), "path")
    tests = {"empty": F.col("bytes") == 0, "oversize": F.col("bytes") > 20000, "unsupported": ~F.col("ext").isin("en", "de", "fr")}
    found = f.select("path", F.explode(F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))).alias("finding"))
    return found.select("finding", "path").unionByName(copies)


@query(
    """WITH levels AS (SELECT r_name AS level, r_regionkey * 12 AS low, r_regionkey * 12 + 12 AS high FROM region)
SELECT p_partkey, level, CASE WHEN p_name LIKE '%bolt%' OR p_name LIKE '%gear%' THEN 'steel' WHEN p_name LIKE '%ring%' THEN 'glass' ELSE 'other' END AS material, CASE WHEN p_type = 'SMALL' THEN CASE WHEN p_size < 20 THEN 'Window' ELSE 'Door' END ELSE p_type END AS element
FROM part LEFT JOIN levels ON p_size >= low AND p_size < high"""
)
def build_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of elements: the level whose heights hold theirs, a material class and what openings really are."""
    levels = c.read(spark, sf_dir, "region").select(F.col("r_name").alias("level"), (F.col("r_regionkey") * 12).alias("low"), (F.col("r_regionkey") * 12 + 12).alias("high"))
    # levels are found by the cells of heights that they cover
    cells = levels.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / 10), F.floor((F.col("high") - 1) / 10))))
    p = c.read(spark, sf_dir, "part").withColumn("cell", F.floor(F.col("p_size") / 10))
    inside = (p["cell"] == cells["cell"]) & (F.col("p_size") >= F.col("low")) & (F.col("p_size") < F.col("high"))
    element = F.when(F.col("p_type") == "SMALL", F.when(F.col("p_size") < 20, "Window").otherwise("Door")).otherwise(F.col("p_type"))
    return p.join(cells, inside, "left").select("p_partkey", "level", text_fn.first_match(F.col("p_name"), [("bolt|gear", "steel"), ("ring", "glass")], "other").alias("material"), element.alias("element"))


@query(
    c.with_(c.OBJECTS)
    + """, o AS (SELECT DISTINCT 'obj:' || object_id AS obj, 'doc:' || document AS doc, 'block:' || block AS block FROM objects),
n AS (SELECT obj AS key, 'Instance' AS type FROM o UNION SELECT doc, 'Model' FROM o UNION SELECT block, 'Definition' FROM o), e AS (SELECT doc AS src, 'contains' AS type, obj AS dst FROM o UNION SELECT obj, 'instanceOf', block FROM o)
SELECT 'nodes' AS part, type, count(*) AS n, count(DISTINCT key) AS keys FROM n GROUP BY 2 UNION ALL SELECT 'edges', type, count(*), count(DISTINCT src) FROM e GROUP BY 2"""
)
def model_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of models, instances and definitions, counted by type."""
    key = lambda kind, x: F.concat(F.lit(f"{kind}:"), F.col(x).cast("string"))
    o = c.objects(spark, sf_dir).select(key("obj", "object_id").alias("obj"), key("doc", "document").alias("doc"), key("block", "block").alias("block")).distinct()
    node = lambda x, kind: F.struct(F.lit("nodes").alias("part"), F.lit(kind).alias("type"), F.col(x).alias("key"), F.lit("").alias("dst"))
    edge = lambda a, kind, b: F.struct(F.lit("edges").alias("part"), F.lit(kind).alias("type"), F.col(a).alias("key"), F.col(b).alias("dst"))
    rows = o.select(F.explode(F.array(node("obj", "Instance"), node("doc", "Model"), node("block", "Definition"), edge("doc", "contains", "obj"), edge("obj", "instanceOf", "block"))).alias("x")).select("x.*").distinct()
    return rows.groupBy("part", "type").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query(
    """WITH l AS (SELECT doc_id, i - 1 AS pos, trim(s) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i FROM documents) WHERE trim(s) <> '')
SELECT 'doc:' || doc_id AS src, 'HAS_SECTION' AS type, 'sec:' || doc_id || '/' || pos AS dst, sha256(s) AS digest FROM l
UNION ALL SELECT 'sec:' || doc_id || '/' || prior, 'NEXT', 'sec:' || doc_id || '/' || pos, NULL FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM l) WHERE prior IS NOT NULL"""
)
def document_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their lines as edges: what a document holds, and what follows what."""
    lines = c.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    doc, sec = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), lambda at: F.concat(F.lit("sec:"), F.concat_ws("/", F.col("doc_id").cast("string"), F.col(at).cast("string")))
    rows = lines.select("doc_id", "at", F.sha2("s", 256).alias("digest")).withColumn("prior", F.lag("at").over(Window.partitionBy("doc_id").orderBy("at")))
    holds = rows.select(doc.alias("src"), F.lit("HAS_SECTION").alias("type"), sec("at").alias("dst"), "digest")
    follows = rows.where("prior is not null").select(sec("prior").alias("src"), F.lit("NEXT").alias("type"), sec("at").alias("dst"), F.lit(None).cast("string").alias("digest"))
    return holds.unionByName(follows)


@query(
    """WITH s AS (SELECT p_brand AS project, CASE WHEN p_size % 6 = 0 THEN -(p_size // 6) ELSE p_size END AS floor, p_type FROM part)
SELECT project, max(floor)::INT AS highest, CASE WHEN min(floor) < 0 THEN -min(floor)::INT END AS deepest, count(DISTINCT p_type) AS types, count(*) AS objects FROM s GROUP BY 1"""
)
def project_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest and deepest floor of each project, and what it holds."""
    size = F.col("p_size")
    storey = F.when(size % 6 == 0, F.concat(F.lit("B"), F.floor(size / 6).cast("string"))).otherwise(F.concat(size.cast("string"), F.lit("F")))
    number = F.regexp_extract("storey", r"(\d+)", 1).cast("int")
    rows = c.read(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), storey.alias("storey"), "p_type").withColumn("floor", F.when(F.col("storey").startswith("B"), -number).otherwise(number))
    lowest = F.min("floor")
    return rows.groupBy("project").agg(F.max("floor").alias("highest"), F.when(lowest < 0, -lowest).alias("deepest"), F.countDistinct("p_type").alias("types"), F.count("*").alias("objects"))
