"""Sinks: graphs and tables to files. Text forms are built as rows of text, so that every task writes its own part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _xml(x: str) -> Column:
    out = F.coalesce(F.col(x), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _quoted(x: str, mark: str = '"') -> Column:
    out = F.replace(F.replace(F.coalesce(F.col(x), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit(mark), F.lit("\\" + mark))
    return F.concat(F.lit(mark), F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit(mark))


def tables(parts: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines, the canonical form, and Parquet, derived from it."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}.jsonl")
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def mirror(parts: dict[str, DataFrame], database: str) -> None:
    """Each table under its name in a database, replaced as a whole."""
    for name, df in parts.items():
        df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")


def csv(df: DataFrame, path: str) -> None:
    """Comma-separated values with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of GraphML in order: header, nodes (key, name), edges (src, predicate, dst), end."""
    spark = nodes.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.lit('<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">').alias("value"))
    n = nodes.select(F.lit(1).alias("part"), "key", F.concat(F.lit('<node id="'), _xml("key"), F.lit('"><data key="name">'), _xml("name"), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "src", "predicate", "dst").alias("key"), F.concat(F.lit('<edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"><data key="predicate">'), _xml("predicate"), F.lit("</data></edge>")).alias("value"))
    end = spark.range(1).select(F.lit(3).alias("part"), F.lit("").alias("key"), F.lit("</graph></graphml>").alias("value"))
    return head.unionByName(n).unionByName(e).unionByName(end).orderBy("part", "key").select("value")


def jsonld(nodes: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    """One JSON-LD object a line for each node, with its outgoing edges."""
    out = edges.groupBy(F.col("src").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("predicate").alias("predicate"), F.concat(F.lit(base), "dst").alias("target")))).alias("links"))
    rows = nodes.join(out, "key", "left")
    return rows.select(F.to_json(F.struct(F.concat(F.lit(base), "key").alias("@id"), F.col("name").alias("name"), F.col("links").alias("links"))).alias("value"))


def turtle(nodes: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    """Triples in Turtle, one a line."""
    iri = lambda x: F.concat(F.lit(f"<{base}"), F.url_encode(F.col(x)), F.lit(">"))
    n = nodes.select(F.concat(iri("key"), F.lit(" <http://www.w3.org/2000/01/rdf-schema#label> "), _quoted("name"), F.lit(" .")).alias("value"))
    return n.unionByName(edges.select(F.concat(iri("src"), F.lit(" "), iri("predicate"), F.lit(" "), iri("dst"), F.lit(" .")).alias("value")))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Statements that make nodes, then edges, if they are not there."""
    n = nodes.select(F.concat(F.lit("MERGE (n:Entity {key: "), _quoted("key", "'"), F.lit("}) SET n.name = "), _quoted("name", "'"), F.lit(";")).alias("value"))
    kind = F.regexp_replace(F.upper("predicate"), "[^A-Z0-9_]", "_")
    e = edges.select(F.concat(F.lit("MATCH (a:Entity {key: "), _quoted("src", "'"), F.lit("}), (b:Entity {key: "), _quoted("dst", "'"), F.lit("}) MERGE (a)-[:"), kind, F.lit("]->(b);")).alias("value"))
    return n.unionByName(e)


def mermaid(edges: DataFrame) -> DataFrame:
    """Lines of a flowchart."""
    name = lambda x: F.regexp_replace(x, "[^A-Za-z0-9_]", "_")
    return edges.select(F.concat(F.lit("  "), name("src"), F.lit(" -->|"), F.regexp_replace("predicate", r"\|", "/"), F.lit("| "), name("dst")).alias("value"))


def inserts(df: DataFrame, table: str) -> DataFrame:
    """SQL INSERT statements, one a row."""
    cell = lambda c, t: F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'")) if t == "string" else F.col(c).cast("string"), F.lit("NULL"))
    body = F.concat_ws(", ", *(cell(c, t) for c, t in df.dtypes))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), body, F.lit(");")).alias("value"))


def versioned(df: DataFrame, folder: str, version: str) -> str:
    """Write a version beside the others; readers name the version that they want."""
    path = f"{folder}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def by_document(df: DataFrame, path: str, document: str) -> None:
    """Replace the partitions of the documents that the table has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(document).parquet(path)
