"""Lexical search, relation extraction and text rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.operators.lineage import cut

#: Asked terms up to this many are sent to all tasks.
MOST_TERMS = 1_000_000


def law_score(title: Column, body: Column, terms: list[str], phrase: str) -> Column:
    """3 for each occurrence in the title, 1 for each of at most 5 in the body, 5 for the whole phrase."""
    t, b = F.lower(title), F.lower(body)
    out = F.when(b.contains(phrase.lower()) | t.contains(phrase.lower()), 5).otherwise(0).cast("long")
    for term in terms:
        out = out + 3 * fn.occurrences(t, F.lit(term.lower())) + F.least(fn.occurrences(b, F.lit(term.lower())), F.lit(5))
    return out


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of tokens (doc_id, tokens) for queries (query_id, terms).

    Only postings of asked terms are shuffled: terms reduce the tokens before they are counted, and lengths are taken
    apart from them.
    """
    lengths = docs.select("doc_id", F.size("tokens").cast("double").alias("len"))
    whole = lengths.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    asked = cut(queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")))
    terms = asked.select("term").distinct()
    if asked.count() <= MOST_TERMS:
        terms = F.broadcast(terms)  # of a counted size
    postings = cut(docs.select("doc_id", F.explode("tokens").alias("term")).join(terms, "term", "left_semi").groupBy("term", "doc_id").agg(F.count("*").alias("tf")))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weights = postings.join(df, "term").join(lengths, "doc_id").crossJoin(F.broadcast(whole)).select("term", "doc_id", (idf * tf).alias("weight"))  # one row
    return asked.join(weights, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))


def top(scored: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k best of each query."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, sentence): split after a full stop, question or exclamation mark, or at a line's end."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("sentence_no", "sentence")).where("trim(sentence) <> ''")


def mentions(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Longest, non-overlapping mentions of a gazetteer (surface form to key), between word boundaries, in any case.

    Spans need a scan with state, so one alternation, longest names first, runs over Arrow batches.
    """
    keys = {n.casefold(): k for n, k in names.items()}
    found = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda x: (-len(x), x))) + r")(?!\w)", re.I) if names else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for doc, nr, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                for i, m in enumerate(found.finditer(text or "") if found else ()):
                    out.append((doc, nr, i, keys[m[0].casefold()], m.start(), m.end()))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["doc_id", "sentence_no", "nr", "entity", "start", "end"])

    return rows.select("doc_id", "sentence_no", "sentence").mapInArrow(run, "doc_id long, sentence_no int, nr int, entity string, start int, end int")


def cooccurrences(found: DataFrame, least: int, proposed: DataFrame | None = None) -> DataFrame:
    """Pairs of entities that share a sentence, by the number of sentences that do; rarer pairs are dropped.

    Pairs that a rule has proposed (entity, other), in either direction, are left out.
    """
    once = found.select("doc_id", "sentence_no", "entity").distinct()
    per = once.groupBy("doc_id", "sentence_no").agg(F.array_sort(F.collect_list("entity")).alias("es")).where("size(es) > 1")
    i = per.select("doc_id", "sentence_no", "es", F.posexplode("es").alias("i", "a"))
    pairs = i.select("a", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("b"))
    n = F.col("support")
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("support")).where(n >= least).withColumn("confidence", F.round(F.least(F.lit(0.5), 0.15 + 0.05 * n), 6))
    if proposed is None:
        return out
    known = proposed.select(F.least("entity", "other").alias("a"), F.greatest("entity", "other").alias("b")).distinct()
    return out.join(known, ["a", "b"], "left_anti")


def relation_proposals(docs: DataFrame, names: dict[str, str], rules: list[tuple[str, str, float]], least: int) -> DataFrame:
    """(source, relation, target, support, confidence) from texts (doc_id, text): typed by rules first, then RELATED_TO for what shares sentences."""
    rows = sentences(docs)
    found = cut(mentions(rows, names))
    typed = cut(rule_relations(found, rows, rules))
    related = cooccurrences(found, least, typed)
    return typed.select(F.col("entity").alias("source"), "relation", F.col("other").alias("target"), "support", "confidence").unionByName(
        related.select(F.col("a").alias("source"), F.lit("RELATED_TO").alias("relation"), F.col("b").alias("target"), "support", "confidence")
    )


def rule_relations(found: DataFrame, rows: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Relations between adjacent mentions whose gap matches a rule (pattern, type, base); the first rule wins."""
    w = Window.partitionBy("doc_id", "sentence_no").orderBy("start")
    pairs = found.select("doc_id", "sentence_no", "entity", "end", F.lead("entity").over(w).alias("other"), F.lead("start").over(w).alias("next")).where("other is not null and other <> entity")
    gaps = pairs.join(rows, ["doc_id", "sentence_no"]).withColumn("gap", F.substring("sentence", F.col("end") + 1, F.col("next") - F.col("end")))
    kind, base = F.lit(None).cast("string"), F.lit(None).cast("double")
    for pattern, name, confidence in reversed(rules):
        kind = F.when(F.col("gap").rlike(pattern), name).otherwise(kind)
        base = F.when(F.col("gap").rlike(pattern), confidence).otherwise(base)
    typed = gaps.select("entity", "other", "doc_id", "sentence_no", kind.alias("relation"), base.alias("base")).where("relation is not null")
    n = F.countDistinct("doc_id", "sentence_no")
    return typed.groupBy("entity", "relation", "other").agg(n.alias("support"), F.round(F.least(F.lit(0.85), F.max("base") + 0.05 * (n - 1)), 6).alias("confidence"))


def similar(features: DataFrame, queries: DataFrame, key: str, feature: str, k: int) -> DataFrame:
    """The k owners most similar to each queried owner by Jaccard similarity of their features, of those that share one.

    Queries are a stated set against all owners. Shared features are counted per pair before anything else is joined.
    """
    once = cut(features.select(key, feature).distinct())
    sizes = once.groupBy(key).agg(F.count("*").alias("n"))
    asked = once.join(queries.select(key).distinct(), key, "left_semi")
    a, b = asked.alias("a"), once.alias("b")
    shared = a.join(b, (F.col(f"a.{feature}") == F.col(f"b.{feature}")) & (F.col(f"a.{key}") != F.col(f"b.{key}"))).groupBy(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b")).agg(F.count("*").alias("both"))
    out = shared.join(sizes.select(F.col(key).alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col(key).alias("b"), F.col("n").alias("n_b")), "b")
    scored = out.select("a", "b", F.round(F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")), 6).alias("score"))
    return top(scored, "a", k, "b")
