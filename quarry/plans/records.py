"""Queries of records, packs and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import records as op
from quarry.operators import regulation, spatial
from quarry.registry import query
from quarry.sources import concepts as c


@query("""SELECT l_returnflag AS route, count(*) AS cases, count(*) FILTER (l_quantity > 10) AS answered, count(l_quantity > 10) AS answered_of, count(*) FILTER (l_discount > 0.05) AS cited, count(l_discount > 0.05) AS cited_of,
  count(*) FILTER (l_linenumber % 2 = 1 AND l_linestatus = 'F') AS refused, count(CASE WHEN l_linenumber % 2 = 1 THEN 1 END) AS refused_of FROM lineitem GROUP BY 1""")
def graphrag_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, citations and refusals by route."""
    x = c.read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "route")
    return op.rates(x, "route", {"answered": F.col("l_quantity") > 10, "cited": F.col("l_discount") > 0.05, "refused": F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linestatus") == "F")})


@query(c.with_(c.FILES) + "SELECT folder, ext, count(*) AS files, count(DISTINCT sha256) AS unique_files, sum(bytes)::BIGINT AS bytes FROM files GROUP BY 1, 2")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and unique files by folder and kind."""
    return c.files(spark, sf_dir).groupBy("folder", "ext").agg(F.count("*").alias("files"), F.countDistinct("sha256").alias("unique_files"), F.sum("bytes").alias("bytes"))


@query("""SELECT p_brand AS project, count(*) AS cases, count(*) FILTER (p_size > 0) AS sized, count(p_size > 0) AS sized_of, count(*) FILTER (length(p_name) > 8) AS named, count(length(p_name) > 8) AS named_of,
  round((count(*) FILTER (p_size > 0) + count(*) FILTER (length(p_name) > 8))::DOUBLE / (2 * count(*)), 6) AS score FROM part GROUP BY 1""")
def validation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed checks of each project."""
    rows = op.rates(c.read(spark, sf_dir, "part").withColumnRenamed("p_brand", "project"), "project", {"sized": F.col("p_size") > 0, "named": F.length("p_name") > 8})
    return rows.withColumn("score", F.round((F.col("sized") + F.col("named")) / (2 * F.col("cases")), 6))


@query("""WITH cat AS (SELECT p_partkey AS entry, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS exact, p_type || p_size AS nominal FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey AS id, p_name AS exact, p_type || p_size AS nominal FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT exact, min(entry) AS entry FROM cat WHERE exact IS NOT NULL GROUP BY 1), n AS (SELECT nominal, min(entry) AS entry FROM cat GROUP BY 1)
SELECT id, coalesce(e.entry, n.entry) AS entry, CASE WHEN e.entry IS NOT NULL THEN 'exact' WHEN n.entry IS NOT NULL THEN 'nominal' ELSE 'unmatched' END AS how FROM r LEFT JOIN e USING (exact) LEFT JOIN n USING (nominal)""")
def section_catalog_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries by exact, then by nominal key."""
    p = c.read(spark, sf_dir, "part").withColumn("nominal", F.concat("p_type", F.col("p_size").cast("string")))
    cat = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("entry"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("exact"), "nominal")
    rows = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("exact"), "nominal")
    return op.by_priority(rows, cat, [("exact", "exact"), ("nominal", "nominal")]).select("id", "entry", "how")


@query(c.with_(c.RELATIONS) + """, n AS (SELECT 'customer:' || c_custkey AS key FROM customer WHERE c_acctbal > 0 UNION SELECT 'order:' || o_orderkey FROM orders WHERE o_orderkey % 4 <> 0) SELECT relation_id FROM relations WHERE src <> dst AND src IN (SELECT key FROM n) AND dst IN (SELECT key FROM n)""")
def projected_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose ends are both projected."""
    key = lambda t, k: F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias("key")
    nodes = c.read(spark, sf_dir, "customer").where("c_acctbal > 0").select(key("customer", "c_custkey")).union(c.read(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(key("order", "o_orderkey")))
    return op.projected(c.relations(spark, sf_dir), nodes).select("relation_id")


@query(c.with_(c.BOXES) + """, p AS (SELECT a.box_id AS a, b.box_id AS b, round(abs(a.y0 - b.y0), 6) AS distance FROM boxes a JOIN boxes b ON a.plan = b.plan WHERE a.box_id % 2 = 0 AND b.box_id % 2 = 1 AND a.x0 BETWEEN b.x0 - 30 AND b.x1 + 30 AND abs(a.y0 - b.y0) <= 60)
SELECT a, b, distance FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) = 1""")
def dimension_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line beside each dimension text."""
    boxes = c.boxes(spark, sf_dir)
    texts = boxes.where("box_id % 2 = 0").withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    lines = boxes.where("box_id % 2 = 1").withColumns({"y1": F.col("y0")})
    beside = F.col("a.x0").between(F.col("b.x0") - 30, F.col("b.x1") + 30) & (F.abs(F.col("a.y0") - F.col("b.y0")) <= 60)
    pairs = spatial.near_pairs(texts, lines, 120, 60).where(beside).select(F.col("a.box_id").alias("a"), F.col("b.box_id").alias("b"), F.round(F.abs(F.col("a.y0") - F.col("b.y0")), 6).alias("distance"))
    return pairs.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.distance").alias("distance"))


@query(c.with_(c.BOXES) + """SELECT a.box_id AS bubble, b.box_id AS label FROM boxes a JOIN boxes b ON a.plan = b.plan AND a.box_id <> b.box_id WHERE sqrt(pow((a.x0 + a.x1) / 2 - b.x0, 2) + pow((a.y0 + a.y1) / 2 - b.y0, 2)) <= (a.x1 - a.x0) / 2""")
def grid_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels inside circles."""
    boxes = c.boxes(spark, sf_dir)
    labels = boxes.withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    circles = boxes.select("box_id", "plan", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"), ((F.col("x1") - F.col("x0")) / 2).alias("r"))
    spread = circles.withColumns({"x0": F.col("mx") - F.col("r"), "x1": F.col("mx") + F.col("r"), "y0": F.col("my") - F.col("r"), "y1": F.col("my") + F.col("r")})
    inside = (F.hypot(F.col("a.mx") - F.col("b.x0"), F.col("a.my") - F.col("b.y0")) <= F.col("a.r")) & (F.col("a.box_id") != F.col("b.box_id"))
    return spatial.near_pairs(spread, labels, 64, 0).where(inside).select(F.col("a.box_id").alias("bubble"), F.col("b.box_id").alias("label"))


@query("""WITH o AS (SELECT event_type AS k, min(event_id) AS first FROM events WHERE user_id % 3 <> 0 GROUP BY 1) SELECT k, row_number() OVER (ORDER BY first, k)::INT AS number FROM o ORDER BY number LIMIT 4""")
def choice_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed choices, numbered, four at most (the limit is the feature)."""
    return op.choices(c.read(spark, sf_dir, "events").withColumnRenamed("event_type", "k"), "k", F.col("user_id") % 3 != 0, [F.col("event_id")], 4)


@query("WITH RECURSIVE " + c.REVIEWS + """, n AS (SELECT event_id, subject, review_rev AS revision, review_rev - 1 AS expected, row_number() OVER (PARTITION BY subject ORDER BY created_at, event_id) AS nr FROM reviews),
walk(event_id, subject, nr, head, accepted) AS (SELECT event_id, subject, nr, revision, true FROM n WHERE nr = 1 UNION ALL
  SELECT n.event_id, n.subject, n.nr, CASE WHEN n.revision IS NOT DISTINCT FROM w.head OR n.expected IS NOT DISTINCT FROM w.head THEN n.revision ELSE w.head END, n.revision IS NOT DISTINCT FROM w.head OR n.expected IS NOT DISTINCT FROM w.head
  FROM walk w JOIN n ON n.subject = w.subject AND n.nr = w.nr + 1)
SELECT event_id, accepted FROM walk""")
def revision_compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that repeat or expect the revision that their source has when they come."""
    e = c.reviews(spark, sf_dir).select("event_id", "subject", F.col("created_at").alias("at"), F.col("review_rev").alias("revision"), (F.col("review_rev") - 1).alias("expected"))
    return op.compare_and_set(e, "subject").select("event_id", "accepted")


@query("""SELECT p_partkey, 'brand' AS path, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', CASE WHEN p_size > 10 THEN p_size::VARCHAR END FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'type', p_type FROM part""")
def land_record_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of records, one for each known field."""
    p = c.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"), F.col("p_type").alias("type"))
    return op.unpivot(p, "p_partkey", ["brand", "size", "type"])


@query(c.with_(c.EVIDENCE) + """SELECT source_uri, state, string_agg(DISTINCT source_id::VARCHAR, '; ' ORDER BY source_id::VARCHAR) AS texts, count(*) AS n FROM evidence GROUP BY 1, 2""")
def evidence_briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by source and state, in one line each."""
    return op.joined_texts(c.evidence(spark, sf_dir).withColumn("who", F.col("source_id").cast("string")), ["source_uri", "state"], "who")


@query("""SELECT event_id, user_id, ts FROM events WHERE props->>'$.k' = '42' AND user_id % 2 = 0 ORDER BY ts DESC, event_id""")
def works_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by a JSON key within a project's scope, newest first."""
    return c.read(spark, sf_dir, "events").where((F.get_json_object("props", "$.k") == "42") & (F.col("user_id") % 2 == 0)).orderBy(F.desc("ts"), "event_id").select("event_id", "user_id", "ts")


PRIORS = [("A", "wall", 0.8), ("N", "door", 0.6), ("R", "grid", 0.4)]


@query(c.with_(c.OBJECTS) + """SELECT object_id, kind_of, prior FROM objects JOIN (VALUES ('A', 'wall', 0.8::DOUBLE), ('N', 'door', 0.6::DOUBLE), ('R', 'grid', 0.4::DOUBLE)) t(layer, kind_of, prior) USING (layer) WHERE quantity > 40""")
def layer_prior_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate kinds of objects by their layer."""
    priors = spark.createDataFrame(PRIORS, "layer string, kind_of string, prior double")
    return c.objects(spark, sf_dir).where("quantity > 40").join(F.broadcast(priors), "layer").select("object_id", "kind_of", "prior")  # three rows


@query("""SELECT conv_id, turn, role, i::INT AS place, trim(line) AS line FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations WHERE role <> 'system') WHERE trim(line) LIKE '%.'""")
def memory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole statements of turns as memory candidates."""
    x = c.read(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return x.withColumn("line", F.trim("line")).where("line like '%.'")


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'third' WHEN p_partkey % 3 = 0 THEN 'second' ELSE 'first' END AS origin FROM part""")
def registry_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows of three builds, the last one winning."""
    p = c.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    mark = lambda df, n: df.withColumn("origin", F.lit(n))
    return op.rebuilt([mark(p, "first"), mark(p.where("key % 3 = 0"), "second"), mark(p.where("key % 5 = 0"), "third")], "key")


@query(c.with_(c.STRUCTURE) + """SELECT src, 'PROPOSED_PART_OF' AS predicate, dst, 0.9::DOUBLE AS confidence FROM structure JOIN customer ON src = 'customer:' || c_custkey WHERE c_acctbal < 0""")
def structure_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals taken from a structure."""
    k = c.read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("src"))
    return c.structure(spark, sf_dir).join(k, "src").select("src", F.lit("PROPOSED_PART_OF").alias("predicate"), "dst", F.lit(0.9).alias("confidence"))


@query(c.with_(c.OBJECTS) + """SELECT layer, block, uses, place::INT AS place FROM (SELECT layer, block, count(*) AS uses, row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, block) AS place FROM objects GROUP BY 1, 2) WHERE place <= 12""")
def pack_graph_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve most used blocks of each layer (the cap is the feature)."""
    return op.most_used(c.objects(spark, sf_dir), "layer", "block", 12)


@query("""SELECT rule, place::INT AS place, part FROM (SELECT p_partkey AS rule, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS place, unnest(string_split(p_name, ' ')) AS part FROM part)""")
def flattened_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of two JSON shapes (a list, or an object with a list) as one row for each part."""
    parts = F.split("p_name", " ")
    shape = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(parts.alias("parts")))).otherwise(F.to_json(parts))
    text = c.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule"), shape.alias("j"))
    items = F.coalesce(F.from_json(F.get_json_object("j", "$.parts"), "array<string>"), F.from_json(F.when(F.col("j").startswith("["), F.col("j")), "array<string>"))
    return text.select("rule", F.posexplode(items).alias("place", "part"))


@query(c.with_(c.FACTS) + """, r AS (SELECT subject, path, count(*) FILTER (status = 'DISPUTED') AS disputed, count(DISTINCT value) AS v FROM facts GROUP BY 1, 2), d AS (SELECT p_partkey % 400 AS subject, CASE WHEN p_size % 3 <> 0 THEN 'p.' || (p_size % 7 + 1) END AS path, p_partkey AS designation FROM part)
SELECT designation, r.subject, r.path FROM d JOIN r ON d.subject = r.subject AND (d.path IS NULL OR d.path = r.path) WHERE disputed = 0 AND v = 1""")
def designation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designations of facts that are settled; a designation without a path takes all of a subject."""
    r = c.facts(spark, sf_dir).groupBy("subject", "path").agg(F.count_if(F.col("status") == "DISPUTED").alias("disputed"), F.countDistinct("value").alias("v")).where("disputed = 0 and v = 1")
    d = c.read(spark, sf_dir, "part").select((F.col("p_partkey") % 400).alias("at"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("p."), (F.col("p_size") % 7 + 1).cast("string"))).alias("wanted"), F.col("p_partkey").alias("designation"))
    return d.join(r, (F.col("at") == F.col("subject")) & regulation.wildcard_equal(F.col("wanted"), F.col("path"))).select("designation", "subject", "path")


@query("""SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""")
def incomplete_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of runs that have not ended."""
    return c.read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority", "o_orderstatus")
