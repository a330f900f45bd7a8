"""Readers and sinks over the provided tables: what is written in a format and read back, against the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as text_fn
from quarry.functions import vector as vec
from quarry.operators import dedup, knowledge
from quarry.operators.lineage import scratch
from quarry.registry import query
from quarry.sources import concepts as c
from quarry.sources import readers, sinks
from quarry.streaming import events as streaming


def _written(values: DataFrame, each: str | None = None) -> str:
    """Path of a folder of text files of ``value``; with ``each``, a file for each of its values."""
    path = scratch(values.sparkSession)
    if each is None:
        values.select("value").write.text(path)
    else:
        values.select("value", each).repartition(each).write.partitionBy(each).text(path)
    return path


def _line(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("SELECT event_id, event_type, value FROM events")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, with blank and torn lines between them, and read."""
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    lines = c.read(spark, sf_dir, "events").select(F.explode(F.array(line, F.lit(""), F.left(line, F.lit(9)))).alias("value"))
    return readers.jsonl(spark, _written(lines), "event_id long, event_type string, value double")


@query("""SELECT path, max(mtime) AS mtime, arg_max(bytes, mtime) AS bytes FROM (SELECT source || '/' || lang AS path, doc_id AS mtime, n_chars AS bytes FROM documents) GROUP BY 1""")
def census_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A census log read from JSON lines, the last line of each path winning."""
    d = c.read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("bytes"))
    path = _written(d.select(F.to_json(F.struct("*")).alias("value")))
    return dedup.latest_rows(readers.jsonl(spark, path, "path string, mtime long, bytes long"), ["path"], "mtime").select("path", "mtime", "bytes")


@query("""SELECT 'txt' AS ext, length(n_name) + 7 AS bytes, sha256('AC1032' || n_name || chr(10)) AS sha256, 'AC1032' AS version FROM nation""")
def file_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder with their sizes, hashes and version marks."""
    n = c.read(spark, sf_dir, "nation").select(_line("AC1032", F.col("n_name")).alias("value"), "n_nationkey")
    return readers.wanted(readers.census(spark, _written(n, "n_nationkey")), ["txt"]).select("ext", "bytes", "sha256", "version")


STEP_TYPES = """CASE p_size % 4 WHEN 0 THEN 'IFCWALL' WHEN 1 THEN 'IFCDOOR' WHEN 2 THEN 'IFCRELAGGREGATES' ELSE 'IFCTHING' END"""


def _step(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size") % 4
    kind = F.when(size == 0, "IFCWALL").when(size == 1, "IfcDoor").when(size == 2, "IFCRELAGGREGATES").otherwise("IFCTHING")
    lines = c.read(spark, sf_dir, "part").select(_line("#", k, "= ", kind, "('g", k, "',#", k + 1, ",'", F.col("p_name"), "',$);").alias("value"))
    return readers.step(spark, _written(lines))


@query(f"""SELECT p_partkey AS id, {STEP_TYPES} AS type, p_partkey + 1 AS target FROM part""")
def step_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of STEP files and what they refer to."""
    e = _step(spark, sf_dir)
    return e.join(readers.step_references(e).select(F.col("src").alias("id"), F.col("dst").alias("target")), "id").select("id", "type", "target")


@query(
    f"""WITH s AS (SELECT 'g' || p_partkey AS source_id, p_name AS name, {STEP_TYPES} AS t FROM part)
SELECT left(sha256('p|IFCEntity|IFC|' || source_id), 24) AS object_id, source_id, CASE t WHEN 'IFCWALL' THEN 'Wall' WHEN 'IFCDOOR' THEN 'Door' ELSE 'IFCEntity' END AS type, t AS schema_type, name,
  CASE WHEN t = 'IFCTHING' THEN 0.65::DOUBLE ELSE 1.0 END AS confidence, CASE WHEN t = 'IFCTHING' THEN 'REQUIRES_REVIEW' ELSE 'AUTO_ACCEPT' END AS state, 'ifc://project/p/' || source_id AS geometry_ref FROM s WHERE t <> 'IFCRELAGGREGATES'"""
)
def ifc_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building objects of STEP entities, with those of unknown types for review."""
    return readers.ifc_objects(_step(spark, sf_dir), "p")


@query(c.with_(c.BOXES) + "SELECT box_id::VARCHAR AS name, 'LineString' AS type, x0, y0, x1, y1 FROM boxes")
def geojson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of GeoJSON files, one file a plan, with the bounds of their coordinates."""
    x0, y0, x1, y1 = (F.col(x) for x in ("x0", "y0", "x1", "y1"))
    feature = _line('{"type":"Feature","properties":{"name":"', F.col("box_id"), '"},"geometry":{"type":"LineString","coordinates":[[', x1, ",", y0, "],[", x0, ",", y1, "]]}}")
    files = c.boxes(spark, sf_dir).groupBy("plan").agg(_line('{"type":"FeatureCollection","features":[', F.array_join(F.collect_list(feature), ","), "]}").alias("value"))
    return readers.geojson(spark, _written(files, "plan"))


def _drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("box_id") % 3 == 0, "LINE").otherwise("TEXT")
    entity = F.concat_ws("\n", F.lit("0"), kind, F.lit("8"), _line("layer", F.col("box_id") % 4), F.lit("5"), F.col("box_id").cast("string"), F.lit("10"), F.col("x0").cast("string"), F.lit("20"), F.col("y0").cast("string"))
    body = F.concat_ws("\n", F.lit("0\nSECTION\n2\nENTITIES"), F.array_join(F.collect_list(entity), "\n"), F.lit("0\nENDSEC\n0\nEOF"))
    return readers.dxf(spark, _written(c.boxes(spark, sf_dir).groupBy("plan").agg(body.alias("value")), "plan"))


@query(c.with_(c.BOXES) + "SELECT CASE WHEN box_id % 3 = 0 THEN 'LINE' ELSE 'TEXT' END AS kind, 'layer' || (box_id % 4) AS layer, box_id::VARCHAR AS handle, x0 AS x, y0 AS y FROM boxes")
def dxf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of text drawings, one drawing a plan."""
    return _drawings(spark, sf_dir).select("kind", "layer", "handle", "x", "y")


@query(c.with_(c.BOXES) + "SELECT kind, n, count(*) AS drawings FROM (SELECT plan, CASE WHEN box_id % 3 = 0 THEN 'LINE' ELSE 'TEXT' END AS kind, count(*) AS n FROM boxes GROUP BY 1, 2) GROUP BY 1, 2")
def dxf_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many drawings have so many entities of a kind."""
    return readers.dxf_census(_drawings(spark, sf_dir)).groupBy("kind", "n").agg(F.count("*").alias("drawings"))


@query("""SELECT 'r' || n_regionkey AS src, 'holds' AS predicate, 'n' || n_nationkey AS dst, n_name AS name FROM nation""")
def graph_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of graph JSON, one file a region, with the names of the nodes that they lead to."""
    node = _line('{"id":"n', F.col("n_nationkey"), '","label":"', F.col("n_name"), '"}')
    link = _line('{"source":"r', F.col("n_regionkey"), '","target":"n', F.col("n_nationkey"), '","type":"holds"}')
    body = _line('{"nodes":[', F.array_join(F.collect_list(node), ","), '],"links":[', F.array_join(F.collect_list(link), ","), "]}")
    nodes, edges = readers.graph_json(spark, _written(c.read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(body.alias("value")), "n_regionkey"))
    return edges.join(nodes.select(F.col("key").alias("dst"), "name"), "dst").select("src", "predicate", "dst", "name")


@query("""SELECT 'p' || (conv_id % 2) AS provider, conv_id::VARCHAR AS session_id, list_sort(list(DISTINCT role)) AS tools, list_sort(list(DISTINCT 'a' || (turn % 3))) AS artifacts, count(*) FILTER (role = 'user') AS n_decisions FROM conversations GROUP BY 1, 2""")
def session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of agent logs with their tools, artifacts and decisions."""
    row = F.struct(
        F.col("conv_id").cast("string").alias("session_id"),
        _line("p", F.col("conv_id") % 2).alias("provider"),
        F.col("role").alias("tool"),
        _line("a", F.col("turn") % 3).alias("artifact"),
        F.when(F.col("role") == "user", F.left("text", F.lit(9))).alias("decision"),
        F.lpad(F.col("turn").cast("string"), 6, "0").alias("at"),
    )
    path = _written(c.read(spark, sf_dir, "conversations").select(F.to_json(row).alias("value")))
    return readers.sessions(spark, path).select("provider", "session_id", "tools", "artifacts", F.size("decisions").cast("long").alias("n_decisions"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return c.entities(spark, sf_dir).select(F.col("entity_key").alias("key"), "name"), c.structure(spark, sf_dir)


@query(c.with_(c.STRUCTURE) + "SELECT src, dst FROM structure")
def graphml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph, written as GraphML and read."""
    nodes, edges = _graph(spark, sf_dir)
    keys, found = readers.graphml(spark, _written(sinks.graphml(nodes, edges).coalesce(1)))
    return found.join(keys.select(F.col("key").alias("src")), "src", "left_semi").join(keys.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "dst")


@query(
    c.with_(c.ENTITIES, c.STRUCTURE)
    + """SELECT '<http://x/' || replace(entity_key, ':', '%3A') || '> <http://www.w3.org/2000/01/rdf-schema#label> "' || name || '" .' AS value FROM entities
UNION ALL SELECT '<http://x/' || replace(src, ':', '%3A') || '> <http://x/' || predicate || '> <http://x/' || replace(dst, ':', '%3A') || '> .' FROM structure"""
)
def turtle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as triples."""
    return sinks.turtle(*_graph(spark, sf_dir), "http://x/")


@query(
    c.with_(c.ENTITIES, c.STRUCTURE)
    + """SELECT 'MERGE (n:Entity {key: ''' || entity_key || '''}) SET n.name = ''' || name || ''';' AS value FROM entities
UNION ALL SELECT 'MATCH (a:Entity {key: ''' || src || '''}), (b:Entity {key: ''' || dst || '''}) MERGE (a)-[:' || predicate || ']->(b);' FROM structure"""
)
def cypher_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as statements that make it."""
    return sinks.cypher(*_graph(spark, sf_dir))


@query("""SELECT 'INSERT INTO nation (n_nationkey, n_name) VALUES (' || n_nationkey || ', ''' || n_name || ''');' AS value FROM nation""")
def insert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as INSERT statements."""
    return sinks.inserts(c.read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "nation")


@query(c.with_(c.STRUCTURE) + """SELECT '  ' || replace(src, ':', '_') || ' -->|' || predicate || '| ' || replace(dst, ':', '_') AS value FROM structure""")
def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as a flowchart."""
    return sinks.mermaid(c.structure(spark, sf_dir))


@query(
    """WITH o AS (SELECT event_id, (event_id % 6)::INT AS attempts, CASE WHEN event_id % 4 <> 0 THEN ts END AS last_try, event_type = 'purchase' AS acked FROM events)
SELECT event_id, CASE WHEN acked THEN 'done' WHEN attempts >= 5 THEN 'dead' WHEN last_try IS NULL OR epoch_us(date_trunc('second', last_try)) + (pow(2, attempts)::BIGINT * 1000000) <= epoch_us(TIMESTAMP '2024-01-03 00:00:00') THEN 'send' ELSE 'wait' END AS state FROM o"""
)
def outbox_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an outbox sends now, keeps waiting, has sent or gives up."""
    last = F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp"))
    e = c.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6).cast("int").alias("attempts"), last.alias("last_try"), (F.col("event_type") == "purchase").alias("acked"))
    return streaming.outbox(e, "2024-01-03 00:00:00").select("event_id", "state")


@query(
    r"""WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_brand), '[\p{L}\p{N}_]+')) AS w FROM part), h AS (SELECT p_partkey, ('0x' || left(sha256(w), 8))::BIGINT AS d FROM t),
s AS (SELECT p_partkey, d % 64 AS place, sum(CASE WHEN (d // 64) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS n FROM h GROUP BY 1, 2)
SELECT p.p_partkey, list(coalesce(s.n, 0) ORDER BY r.i) AS vector FROM part p CROSS JOIN range(64) r(i) LEFT JOIN s ON s.p_partkey = p.p_partkey AND s.place = r.i GROUP BY 1"""
)
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed counts of hashed words, in 64 places."""
    tokens = text_fn.tokens(F.concat_ws(" ", "p_name", "p_brand"))
    return c.read(spark, sf_dir, "part").select("p_partkey", vec.hash_embedding(tokens).cast("array<bigint>").alias("vector"))


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("r"))] for t in texts]


@query(
    """SELECT sha256(p_name) AS content_hash, length(p_name)::DOUBLE AS size, (length(p_name) - length(replace(p_name, 'r', '')))::DOUBLE AS marks, count(*) AS objects
FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0) GROUP BY p_name"""
)
def reembedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of texts that are not known yet, each text once, and how many objects share them."""
    p = c.read(spark, sf_dir, "part")
    known = p.where("p_partkey % 50 = 0").select(F.sha2("p_name", 256).alias("content_hash")).distinct()
    fresh, mapping = knowledge.reembed(p.select(F.col("p_partkey").alias("object_id"), F.col("p_name").alias("text")), known, _lengths)
    objects = mapping.groupBy("content_hash").agg(F.count("*").alias("objects"))
    return fresh.select("content_hash", F.get("embedding", 0).alias("size"), F.get("embedding", 1).alias("marks")).join(objects, "content_hash")
