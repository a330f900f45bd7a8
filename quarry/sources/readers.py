"""Readers: files to rows. Parsers of binary drawings stay outside; their normalised rows come in as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and torn ones at the end of a file are dropped."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def census(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder with size, time, content hash and drawing version."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select("path", name.alias("name"), ext.alias("ext"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), version(F.col("content")).alias("version"))


def version(content: Column) -> Column:
    """Version mark of a drawing: the first six bytes of the binary form, or the header variable of the text form."""
    head = F.decode(F.substring(content, 1, 6), "ISO-8859-1")
    text = F.regexp_extract(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), r"\$ACADVER\s+1\s+(AC\d{4})", 1)
    return F.when(head.rlike(r"^AC\d{4}$"), head).otherwise(F.nullif(text, F.lit("")))


def wanted(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Files of some extensions, without temporary and backup ones."""
    return files.where(F.col("ext").isin(extensions) & ~F.col("name").rlike(r"^(~\$|\.)|\.(bak|tmp|sv\$)$"))


def step(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a STEP file: (id, type, arguments)."""
    lines = spark.read.text(path, lineSep=";").select(F.regexp_replace(F.trim(F.regexp_replace("value", r"\s+", " ")), r"^.*?(?=#\d)", "").alias("v"))
    p = r"^#(\d+)\s*=\s*([A-Za-z0-9_]+)\s*\((.*)\)$"
    return lines.where(F.col("v").rlike(p)).select(F.regexp_extract("v", p, 1).cast("long").alias("id"), F.upper(F.regexp_extract("v", p, 2)).alias("type"), F.regexp_extract("v", p, 3).alias("arguments"))


def step_references(entities: DataFrame) -> DataFrame:
    """References between STEP entities in order: (src, dst, place)."""
    refs = F.posexplode(F.regexp_extract_all("arguments", F.lit(r"#(\d+)"), F.lit(1))).alias("place", "dst")
    return entities.select(F.col("id").alias("src"), refs).select("src", F.col("dst").cast("long").alias("dst"), "place")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files: name, geometry type and bounding box of all coordinates."""
    point = r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"
    whole = spark.read.text(path, wholetext=True)
    feature = F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f")
    rows = whole.select(feature).select("f", F.get_json_object("f", "$.geometry.coordinates").alias("c"))
    xs = F.transform(F.regexp_extract_all("c", F.lit(point), F.lit(1)), lambda v: v.cast("double"))
    ys = F.transform(F.regexp_extract_all("c", F.lit(point), F.lit(2)), lambda v: v.cast("double"))
    # a bare pair of coordinates has one bracket, as each pair of a list has
    return rows.select(
        F.get_json_object("f", "$.properties.name").alias("name"),
        F.get_json_object("f", "$.geometry.type").alias("type"),
        F.array_min(xs).alias("x0"),
        F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"),
        F.array_max(ys).alias("y1"),
    )


def headings(docs: DataFrame) -> DataFrame:
    """Headings of Markdown (doc_id, text) in order, each with its level and the heading above it."""
    from quarry.operators.graph import ancestors_by_depth

    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    p = r"^(#{1,6})\s+(.*\S)\s*$"
    found = lines.where(F.col("line").rlike(p)).select("doc_id", "place", F.length(F.regexp_extract("line", p, 1)).alias("level"), F.regexp_extract("line", p, 2).alias("title"))
    return ancestors_by_depth(found, "doc_id", "place", "level", "title")


def mermaid(docs: DataFrame) -> DataFrame:
    """Edges of Mermaid flowcharts (doc_id, text): (doc_id, src, label, dst)."""
    p = r"([A-Za-z0-9_]+)(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})?\s*--+>(?:\|([^|]*)\|)?\s*([A-Za-z0-9_]+)"
    lines = docs.select("doc_id", F.explode(F.split("text", r"[\n;]")).alias("line")).where(F.col("line").rlike(p))
    return lines.select("doc_id", F.regexp_extract("line", p, 1).alias("src"), F.trim(F.regexp_extract("line", p, 2)).alias("label"), F.regexp_extract("line", p, 3).alias("dst"))


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph JSON, whichever of the usual names its lists and fields have."""
    whole = spark.read.text(path, wholetext=True)
    first = lambda *ps: F.coalesce(*(F.get_json_object("value", p) for p in ps))
    each = lambda *ps: F.explode(F.from_json(first(*ps), "array<string>")).alias("x")
    get = lambda *ks: F.coalesce(*(F.get_json_object("x", f"$.{k}") for k in ks))
    nodes = whole.select(each("$.nodes", "$.elements.nodes")).select(get("stable_key", "id", "data.id", "key").alias("key"), get("name", "label", "data.label").alias("name"), get("entity_type_id", "type", "group", "data.type").alias("type"))
    edges = whole.select(each("$.edges", "$.links", "$.elements.edges")).select(
        get("source_stable_key", "source", "from", "data.source").alias("src"), get("relation_type_id", "type", "label", "data.label").alias("predicate"), get("target_stable_key", "target", "to", "data.target").alias("dst")
    )
    return nodes, edges


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Agent logs as JSON lines: one row for each session with its tools, artifacts and decisions."""
    rows = jsonl(spark, path, "session_id string, provider string, tool string, artifact string, decision string, at string")
    distinct = lambda x: F.array_sort(F.collect_set(x)).alias(f"{x}s")
    return rows.groupBy("provider", "session_id").agg(distinct("tool"), distinct("artifact"), F.transform(F.array_sort(F.collect_list(F.when(F.col("decision").isNotNull(), F.struct("at", "decision")))), lambda x: x["decision"]).alias("decisions"))


def dxf(spark: SparkSession, path: str) -> DataFrame:
    """Entities of text drawings by their group codes: (file, entity_no, kind, layer, handle, text, x, y).

    A file's lines alternate between codes and values. Code 0 begins an entity; those of the ENTITIES section are kept.
    Lines are numbered within a file, so a file is read by one task.
    """
    from pyspark.sql import Window

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    pairs = whole.select("file", F.posexplode(F.expr("transform(sequence(0, int(size(lines) / 2) - 1), i -> struct(trim(lines[2 * i]) as code, trim(lines[2 * i + 1]) as value))")).alias("nr", "p")).select("file", "nr", "p.code", "p.value")
    order = Window.partitionBy("file").orderBy("nr")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = (F.col("code") == "0").cast("int")
    marked = pairs.withColumn("lagged", F.lag("value").over(order)).withColumn("section", F.last(F.when((F.col("lagged") == "SECTION") & (F.col("code") == "2"), F.col("value")), ignorenulls=True).over(before))
    numbered = marked.withColumn("entity_no", F.sum(begins).over(before)).where("section = 'ENTITIES'")
    value = lambda code: F.min_by(F.when(F.col("code") == code, F.col("value")), F.when(F.col("code") == code, F.col("nr")))
    out = numbered.groupBy("file", "entity_no").agg(value("0").alias("kind"), value("8").alias("layer"), value("5").alias("handle"), value("1").alias("text"), value("10").cast("double").alias("x"), value("20").cast("double").alias("y"))
    return out.where("kind is not null and kind not in ('SECTION', 'ENDSEC', 'EOF')")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (key) and edges (src, dst) of GraphML files."""
    text = spark.read.text(path, wholetext=True)
    attr = lambda x, a: F.regexp_extract(x, rf'\b{a}="([^"]*)"', 1)
    each = lambda tag: text.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(<{tag}\b[^>]*>)"), F.lit(1))).alias("t"))
    return each("node").select(attr("t", "id").alias("key")), each("edge").select(attr("t", "source").alias("src"), attr("t", "target").alias("dst"))


def dxf_census(entities: DataFrame) -> DataFrame:
    """How many entities of each kind every drawing has, from rows of ``dxf``."""
    return entities.groupBy("file", "kind").agg(F.count("*").alias("n"))


def ifc_objects(entities: DataFrame, project: str) -> DataFrame:
    """Building objects of STEP entities (id, type, arguments): source id, semantic type, name, confidence and state.

    The first argument is the global id, by which an object is known; relationship instances are no objects. Types that
    are not known are kept for review.
    """
    from quarry.functions import rules

    args = F.col("arguments")
    text = lambda i: F.nullif(F.regexp_extract(args, r"^" + r"(?:'(?:[^']|'')*'|[^,'(]*|\([^)]*\)),\s*" * i + r"'((?:[^']|'')*)'", 1), F.lit(""))
    kind = rules.semantic_type(F.col("type"))
    rows = entities.where(F.col("type").startswith("IFC") & ~F.col("type").startswith("IFCREL"))
    source = F.coalesce(text(0), F.col("id").cast("string"))
    confidence = F.when(kind == "IFCEntity", 0.65).otherwise(1.0)
    key = F.concat_ws("|", F.lit(project), F.lit("IFCEntity"), F.lit("IFC"), source)
    return rows.select(
        F.left(F.sha2(key, 256), F.lit(24)).alias("object_id"), source.alias("source_id"), kind.alias("type"), F.col("type").alias("schema_type"), text(2).alias("name"), confidence.alias("confidence"),
        F.when(confidence > 0.95, "AUTO_ACCEPT").otherwise("REQUIRES_REVIEW").alias("state"), F.concat(F.lit(f"ifc://project/{project}/"), source).alias("geometry_ref"),
    )


def settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings of INI-like files (file, section, key, value): comments and blank lines are dropped, and the last of equal keys wins.

    Lines are numbered within a file, and a section's name is the last one before.
    """
    from pyspark.sql import Window

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("nr", "line"))
    lines = whole.withColumn("line", F.trim("line")).where("line <> '' and not line rlike '^[;#]'")
    header = F.nullif(F.regexp_extract("line", r"^\[([^\]]*)\]$", 1), F.lit(""))
    before = Window.partitionBy("file").orderBy("nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("section", F.last(header, ignorenulls=True).over(before)).where(F.col("line").rlike(r"^[^\[=][^=]*="))
    cut = rows.select("file", "section", F.trim(F.regexp_extract("line", r"^([^=]*)=", 1)).alias("key"), "nr", F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)).alias("value"))
    return cut.groupBy("file", "section", "key").agg(F.max_by("value", "nr").alias("value"))
