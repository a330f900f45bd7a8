"""Queries of the element catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import catalog as op
from quarry.registry import query
from quarry.sources import concepts as c


@query(c.with_(c.OBJECTS) + "SELECT kind, count(*) AS n, count(DISTINCT document) AS documents, count(*) FILTER (state = 'AI_INFERRED') AS inferred FROM objects GROUP BY 1")
def catalog_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, documents and inferred objects of each kind."""
    return op.kinds(c.objects(spark, sf_dir), ["kind"])


@query(c.with_(c.OBJECTS) + """
SELECT block, sum(n)::BIGINT AS n, max(documents) AS documents, list_sort(list(kind)) AS kinds
FROM (SELECT block, kind, count(*) AS n, count(DISTINCT document) AS documents FROM objects GROUP BY 1, 2) GROUP BY 1""")
def catalog_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as categories over kinds."""
    return op.rollup(c.objects(spark, sf_dir), "block", "kind")


@query(c.with_(c.OBJECTS) + """
SELECT count(*) FILTER (state = 'AI_INFERRED') AS inferred, count(*) FILTER (state <> 'AI_INFERRED') AS observed,
  count(DISTINCT block) FILTER (state = 'AI_INFERRED') AS inferred_blocks, count(DISTINCT document) FILTER (layer = 'R') AS rejected_documents FROM objects""")
def catalog_filtered_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar aggregates with filters, in one pass."""
    return op.scalars(c.objects(spark, sf_dir))


@query(c.with_(c.OBJECTS) + "SELECT layer, kind, count(*) AS n FROM objects GROUP BY 1, 2 ORDER BY n DESC, layer, kind LIMIT 200")
def catalog_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 200 layers and kinds (the limit is the feature)."""
    return op.layer_counts(c.objects(spark, sf_dir), 200)


@query(c.with_(c.OBJECTS) + """, per AS (SELECT block, kind, count(*) AS n, sum(quantity) AS quantity, bool_or(state = 'AI_INFERRED') AS inferred FROM objects GROUP BY 1, 2),
sets AS (SELECT block, list_sort(list(DISTINCT layer)) AS layers FROM objects GROUP BY 1)
SELECT block, sum(n)::BIGINT AS instances, first(kind ORDER BY n DESC, kind) AS kind, any_value(layers) AS layers, sum(quantity) AS quantity, bool_or(inferred) AS inferred
FROM per JOIN sets USING (block) GROUP BY block""")
def block_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their most common kind, layers and sums."""
    return op.blocks(c.objects(spark, sf_dir))


@query(c.with_(c.OBJECTS) + """SELECT object_id, kind, block, layer, state, label FROM objects
WHERE kind ILIKE 'ECO%' AND block ILIKE 'brand#1_' AND strpos(lower(label), 'ring') > 0 AND state = 'OBSERVED' AND upper(layer) = 'N'""")
def find_elements_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunctive filters with wildcards."""
    return op.find(c.objects(spark, sf_dir), kind="eco*", block="brand#1?", text="Ring", state="OBSERVED", layer="n").select("object_id", "kind", "block", "layer", "state", "label")


@query(c.with_(c.OBJECTS) + """SELECT object_id, document, kind FROM objects WHERE object_id IN (
  SELECT object_id FROM objects WHERE layer = 'R' AND quantity > 48 UNION SELECT object_id FROM objects WHERE document IN (SELECT document FROM objects WHERE block = 'Brand#3' AND quantity > 45))""")
def category_any_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in a category by their own layer or by their document."""
    o = c.objects(spark, sf_dir)
    by_document = o.join(o.where("block = 'Brand#3' and quantity > 45").select("document").distinct(), "document", "left_semi")
    return op.any_of(o, "object_id", [o.where("layer = 'R' and quantity > 48"), by_document]).select("object_id", "document", "kind")


@query(c.with_(c.BOXES) + "SELECT box_id, plan FROM boxes WHERE x0 <= 400 AND x1 >= 200 AND y0 <= 600 AND y1 >= 300")
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that overlap an envelope."""
    return c.boxes(spark, sf_dir).where(op.overlaps(200, 300, 400, 600)).select("box_id", "plan")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 51")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 after a cursor, with the row that tells of another page."""
    return op.page(c.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", 100, 50)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 25 OFFSET 75")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by offset (the limit is the feature)."""
    return c.read(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(75).limit(25)


@query(c.with_(c.OBJECTS) + """
SELECT kind, block, list_sort(list(object_id))[1:20] AS first_ids, count(*) AS n, count(*) FILTER (state = 'AI_INFERRED') AS inferred FROM objects GROUP BY 1, 2""")
def element_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of elements with their first twenty ids."""
    return op.groups(c.objects(spark, sf_dir), ["kind", "block"], 20)


@query(c.with_(c.OBJECTS) + """
SELECT document, list_sort(list(layer || '=' || n)) AS by_layer, sum(n)::BIGINT AS n FROM (SELECT document, layer, count(*) AS n FROM objects GROUP BY 1, 2) GROUP BY 1""")
def drawing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by layer of each document."""
    return op.drawing_index(c.objects(spark, sf_dir))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(json_keys(props::JSON)) AS name FROM events) GROUP BY 1")
def json_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of JSON payloads."""
    return op.json_keys(c.read(spark, sf_dir, "events"), "props")


@query("SELECT event_id, coalesce(nullif(trim(props->>'$.name'), ''), nullif(trim(props->>'$.k'), '')) AS k FROM events")
def json_path_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First JSON path that is not blank."""
    return c.read(spark, sf_dir, "events").select("event_id", op.path("props", "$.name", "$.k").alias("k"))


@query("""SELECT o_custkey AS project, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o,
  count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n_other FROM orders GROUP BY 1""")
def project_summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status of each customer; unknown states are other."""
    return op.status_counts(c.read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "project"), "project", "o_orderstatus", ("F", "O"))


@query("""SELECT * FROM (SELECT conv_id, turn, role, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS used FROM conversations) WHERE used <= 600""")
def byte_budget_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation within 600 bytes."""
    return op.byte_budget(c.read(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], "text", 600).select("conv_id", "turn", "role", "used")


@query(c.with_(c.OBJECTS) + "SELECT o.object_id, d.o_orderstatus AS status, o.kind FROM objects o JOIN orders d ON o.document = d.o_orderkey WHERE o.layer = 'A'")
def objects_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects joined to their documents."""
    d = c.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document"), F.col("o_orderstatus").alias("status"))
    return c.objects(spark, sf_dir).where("layer = 'A'").join(d, "document").select("object_id", "status", "kind")


@query("SELECT p.p_partkey AS definition, count(l_partkey) AS instances FROM part p LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def definition_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of each definition, those without any included."""
    n = c.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("definition")).agg(F.count("*").alias("instances"))
    return c.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("definition")).join(n, "definition", "left").fillna(0, ["instances"])


@query("""SELECT count(*) AS customers, count(DISTINCT c_nationkey) AS nations, count(*) FILTER (c_mktsegment = 'BUILDING') AS building,
  count(*) FILTER (starts_with(c_name, 'Customer#00000001')) AS prefixed, count(DISTINCT c_mktsegment) FILTER (c_acctbal > 0) AS segments FROM customer""")
def nl2sql_golden_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct counts and prefix filters over one view."""
    return c.read(spark, sf_dir, "customer").agg(
        F.count("*").alias("customers"),
        F.countDistinct("c_nationkey").alias("nations"),
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"),
        F.count_if(F.col("c_name").startswith("Customer#00000001")).alias("prefixed"),
        F.countDistinct(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).alias("segments"),
    )
