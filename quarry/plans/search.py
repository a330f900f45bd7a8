"""Queries of composed searches and rule functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import rules, text as text_fn
from quarry.operators import search as op
from quarry.registry import query
from quarry.sources import concepts as c

LEXICON = {"ECONOMY": ["economy", "cheap"], "SMALL": ["small", "tiny"], "PROMO": ["promo", "offer"]}
QUESTION = "small red rings 20"


def _bm25_sql(name: str, tokens: str, terms: list[str]) -> str:
    """Scores of parts by BM25 over a list of tokens."""
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""{name}_t AS (SELECT p_partkey AS item, {tokens} AS ts FROM part), {name}_p AS (SELECT term, item, count(*) AS tf FROM (SELECT item, unnest(ts) AS term FROM {name}_t) WHERE term IN ({wanted}) GROUP BY 1, 2),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1), {name}_w AS (SELECT count(*) AS docs, avg(len(ts)::DOUBLE) AS avg_len FROM {name}_t),
{name} AS (SELECT item, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts)::DOUBLE / avg_len)))), 6) AS score
  FROM {name}_p JOIN {name}_d USING (term) JOIN {name}_t USING (item) CROSS JOIN {name}_w GROUP BY 1)"""


GRAMS_SQL = "flatten(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: list_transform(range(1, greatest(1, length(w) - 1)), lambda i: substr(w, i::INT, 3))))"
GRAMS = sorted({w[i : i + 3] for w in ("small", "red", "rings") for i in range(len(w) - 2)})
CHANNELS = (
    _bm25_sql("bm", "regexp_extract_all(lower(p_name), '[a-z0-9]+')", ["small", "red", "rings"])
    + ",\n"
    + _bm25_sql("tri", GRAMS_SQL, GRAMS)
    + """,
dim AS (SELECT p_partkey AS item, round(1 - abs(p_size - 20) / 20.0::DOUBLE, 6) AS score FROM part WHERE abs(p_size - 20) / 20.0::DOUBLE <= 0.15),
cls AS (SELECT p_partkey AS item, p_retailprice AS score FROM part WHERE p_type = 'SMALL'),
vec AS (SELECT v.vec_id AS item, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 1) q JOIN part ON p_partkey = v.vec_id),
ranks AS (SELECT item, 1.0::DOUBLE AS weight, row_number() OVER (ORDER BY score DESC, item) AS place FROM bm QUALIFY place <= 200
  UNION ALL SELECT item, 0.7::DOUBLE, row_number() OVER (ORDER BY score DESC, item) AS place FROM tri QUALIFY place <= 200
  UNION ALL SELECT item, 0.8::DOUBLE, row_number() OVER (ORDER BY score DESC, item) AS place FROM vec QUALIFY place <= 200
  UNION ALL SELECT item, 0.6::DOUBLE, row_number() OVER (ORDER BY score DESC, item) AS place FROM dim QUALIFY place <= 200
  UNION ALL SELECT item, 1.2::DOUBLE, row_number() OVER (ORDER BY score DESC, item) AS place FROM cls QUALIFY place <= 200)"""
)


@query("WITH " + CHANNELS + " SELECT item, count(*) AS channels, round(round(sum(weight / (60 + place)), 9) * (1 + 0.15::DOUBLE * (count(*) - 1)), 6) AS score FROM ranks GROUP BY 1")
def asset_search_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, trigrams, vectors, classes and sizes fused by weighted ranks, two hundred of each (the cap is the feature)."""
    from quarry.functions import vector as vec
    from quarry.operators import text

    terms = [t for t in QUESTION.split() if not t.isdigit()]
    p = c.read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "item")
    words = F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z0-9]+)"), F.lit(1))
    grams = F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= 3, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))))
    ask = lambda ts: spark.range(1).select(F.lit(0).alias("query_id"), F.array(*map(F.lit, ts)).alias("terms"))
    scored = lambda tokens, ts: text.bm25(p.select(F.col("item").alias("doc_id"), tokens.alias("tokens")), ask(ts)).select(F.col("doc_id").alias("item"), "score")
    error = F.abs(F.col("p_size") - 20) / 20.0
    e = c.read(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 1").select(F.col("embedding").alias("q"))
    near = e.join(p.select(F.col("item").alias("vec_id")), "vec_id").crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("item"), F.round(vec.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))  # one row
    return op.channels(
        {
            "bm25": (scored(words, terms), 1.0),
            "trigram": (scored(grams, GRAMS), 0.7),
            "vector": (near, 0.8),
            "dims": (p.where(error <= 0.15).select("item", F.round(1 - error, 6).alias("score")), 0.6),
            "class": (p.where(F.col("p_type").isin(op.lexicon_classes(terms, LEXICON))).select("item", F.col("p_retailprice").alias("score")), 1.2),
        },
        200,
    )


def asked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as searchable objects: some carry a storey, others have it in their drawing's name."""
    p, e = c.read(spark, sf_dir, "part"), c.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    level = F.concat((F.col("p_size") % 5 + 1).cast("string"), F.lit("F"))
    return p.join(e, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("A-101 plan "), F.lower(level)).alias("name"),
        F.col("p_name").alias("text"),
        F.col("p_type").alias("kind"),
        F.when(F.col("p_partkey") % 2 == 0, level).alias("storey"),
        F.col("p_name").alias("label"),
        F.col("p_brand").alias("project"),
        "embedding",
    )


GLOSSARY = {"crimson": "red", "crimson ring": "red ringg"}


@query(None)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty best parts for a question of a glossary phrase and a storey (held against a plain scan in tests; the limit is the feature)."""
    asked = op.parse("Crimson ring 3F widgets", {}, GLOSSARY)
    probe = c.read(spark, sf_dir, "embeddings").where("vec_id = 1").first()["embedding"]
    return op.hybrid(asked_objects(spark, sf_dir), asked, probe, {"project": None}, 40, ("STANDARD",))


@query(None)
def community_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six summaries for a question, of regions and the nations in them (held against a plain scan in tests; the limit is the feature)."""
    r = c.read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(0).alias("level"), F.col("r_name").alias("title"), F.lit("region of nations").alias("summary"), F.lit("DONE").alias("status"))
    n = c.read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(1).alias("level"), F.col("n_name").alias("title"), F.concat(F.lit("nation number "), F.col("n_nationkey").cast("string")).alias("summary"), F.when(F.col("n_nationkey") % 7 == 0, "PENDING").otherwise("DONE").alias("status"))
    return op.summaries(r.unionByName(n), "nation number 12", 40, 6)


@query(None)
def word_similarity_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity by the best contiguous extent (held against all extents in tests)."""
    return c.read(spark, sf_dir, "part").select("p_partkey", F.round(op.word_similarity(F.lit("red ring"), F.col("p_name")), 6).alias("similarity"))


@query("""WITH s AS (SELECT p_partkey, (2 * CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM part)
SELECT p_partkey, score FROM s WHERE score >= greatest(1, (SELECT max(score) FROM s) * 0.5)""")
def knowledge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that reach half of the best score."""
    has = lambda w: F.when(F.col("p_name").contains(w), 1.0).otherwise(0.0)
    score = 2 * has("ring") + has("red") + F.when(F.col("p_type") == "ECONOMY", 0.5).otherwise(0.0)
    return op.gated(c.read(spark, sf_dir, "part"), score, 0.5).select("p_partkey", "score")


@query(r"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM documents)
SELECT term, count(*) AS df FROM t WHERE term IN ('token', 'the', 'password', 'der', 'queque') GROUP BY 1 HAVING count(*) <= 200""")
def rare_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query terms that few documents have."""
    docs = c.read(spark, sf_dir, "documents").select("doc_id", text_fn.tokens(F.col("text")).alias("tokens"))
    return op.rare_terms(docs, ["token", "the", "password", "der", "queque"], 200)


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON v.label = q.label WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s), m AS (SELECT query_id, min(place) FILTER (vec_id % 5 = query_id % 5 AND vec_id <> query_id) AS rank FROM r GROUP BY 1)
SELECT count(*) AS queries, count(*) FILTER (rank <= 1) AS hits_1, count(*) FILTER (rank <= 3) AS hits_3, count(*) FILTER (rank <= 10) AS hits_10, round(sum(1.0::DOUBLE / rank), 6) AS reciprocal_sum FROM m""")
def space_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of vector ranking within spaces."""
    from quarry.operators import ranking

    v = c.read(spark, sf_dir, "embeddings").withColumnRenamed("label", "space")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "space", "embedding")
    hit = (F.col("vec_id") % 5 == F.col("query_id") % 5) & (F.col("vec_id") != F.col("query_id"))
    return ranking.hits(op.first_hits(v, q, hit), [], "rank")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'B' || (o_orderkey % 5 + 1) WHEN 1 THEN (o_orderkey % 30 + 1) || 'F' WHEN 2 THEN 'RF' END AS storey FROM orders""")
def storey_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storeys in names, however they are written."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("plan b"), (k % 5 + 1).cast("string"), F.lit(" parking"))).when(k % 4 == 1, F.concat(F.lit("Plan "), (k % 30 + 1).cast("string"), F.lit("fl east"))).when(k % 4 == 2, "roof plan").otherwise("site plan")
    return c.read(spark, sf_dir, "orders").select("o_orderkey", rules.storey_of(F.lit(""), text, F.lit(None).cast("string")).alias("storey"))


@query("""SELECT p_partkey, ['H-' || (100 + p_size) || 'x' || p_size || 'x6.5x9'] AS sections FROM part""")
def steel_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steel sections in one spelling."""
    s = F.col("p_size").cast("string")
    text = F.concat(F.lit("beam h "), (F.col("p_size") + 100).cast("string"), F.lit(" X "), s, F.lit("*6.5×9 and H-"), (F.col("p_size") + 100).cast("string"), F.lit("x"), s, F.lit("x6.5x9"))
    return c.read(spark, sf_dir, "part").select("p_partkey", rules.sections(text).alias("sections"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug, left(sha256(lower(trim(regexp_replace(p_name, '\s+', ' ', 'g')))), 12) AS hash FROM part""")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and content hashes."""
    return c.read(spark, sf_dir, "part").select("p_partkey", rules.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"), rules.short_hash(rules.normalised(F.col("p_name"))).alias("hash"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'""")
def date_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in names, in three spellings."""
    o = c.read(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    k = F.col("o_orderkey") % 3
    name = F.concat(F.lit("A-101_"), F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yy.MM.dd")), F.lit("_rev2"))
    return o.select("o_orderkey", rules.date_token(name).alias("day"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'S' WHEN doc_id % 3 = 1 THEN 'A' END AS discipline FROM documents""")
def discipline_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discipline by the deepest folder that names one."""
    k = F.col("doc_id") % 3
    path = F.when(k == 0, "root/arch/struct/x.dwg").when(k == 1, "root/arch/misc/x.dwg").otherwise("root/misc/x.dwg")
    return c.read(spark, sf_dir, "documents").select("doc_id", rules.discipline(path, {"ARCH": "A", "STRUCT": "S"}).alias("discipline"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'CONTAINS' WHEN 'view' THEN 'PART_OF' WHEN 'error' THEN 'RELATED_TO' ELSE upper(event_type) END AS predicate FROM events""")
def predicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation types in one spelling."""
    e = F.col("event_type")
    raw = F.when(e == "click", " has-part").when(e == "view", "belongs to").when(e == "error", "--").otherwise(e)
    return c.read(spark, sf_dir, "events").select("event_id", rules.predicate_name(raw).alias("predicate"))


@query("""SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'count' WHEN 'view' THEN 'location' WHEN 'purchase' THEN 'revision' ELSE 'search' END AS route FROM events""")
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of questions by keyword."""
    e = F.col("event_type")
    q = F.when(e == "click", "How many rings?").when(e == "view", "where is it").when(e == "purchase", "what changed").otherwise("rings")
    return c.read(spark, sf_dir, "events").select("user_id", "event_id", rules.route(q).alias("route"))


@query("""SELECT event_id, least(60.0, pow(2.0::DOUBLE, (event_id % 8)::DOUBLE)) AS delay FROM events WHERE event_type IN ('error', 'click')
UNION ALL SELECT event_id, NULL FROM events WHERE event_type NOT IN ('error', 'click')""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting times by failure class."""
    e = F.col("event_type")
    status = F.when(e == "error", 503).when(e == "click", 429).when(e == "view", 404).otherwise(200)
    return c.read(spark, sf_dir, "events").select("event_id", rules.retry_delay(status, (F.col("event_id") % 8).cast("double")).alias("delay"))


@query("""WITH f AS (SELECT c_custkey, c_name, c_nationkey FROM customer), hits AS (SELECT p_partkey, c_custkey FROM part JOIN f ON 'customer#' || lpad(p_partkey::VARCHAR, 9, '0') = lower(c_name))
SELECT p_partkey, c_custkey FROM hits""")
def name_to_entity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface names joined to entities by their folded form."""
    p = c.read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("surface"))
    e = c.read(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("folded"))
    return p.withColumn("folded", F.lower("surface")).join(e, "folded").select("p_partkey", "c_custkey")


@query("""WITH t AS (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(lower('nation_' || (p_partkey % 30) || ' ' || p_name), '[a-z0-9_]+'))) AS w FROM part) SELECT n_nationkey, p_partkey FROM nation JOIN t ON lower(n_name) = w""")
def alias_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases found as words of texts: names meet by equality, however many there are."""
    a = c.read(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("w"))
    t = F.concat(F.lit("nation_"), (F.col("p_partkey") % 30).cast("string"), F.lit(" "), "p_name")
    words = c.read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(text_fn.tokens(t))).alias("w"))
    return words.join(a, "w").select("n_nationkey", "p_partkey")


@query("""SELECT DISTINCT ON (l_orderkey) l_orderkey AS document, l_partkey AS job, l_shipdate AS done_at FROM lineitem WHERE l_linestatus = 'F' ORDER BY l_orderkey, l_shipdate DESC, l_partkey""")
def latest_successful_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest successful job of each document."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_shipdate"), "l_partkey")
    x = c.read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").withColumn("nr", F.row_number().over(w)).where("nr = 1")
    return x.select(F.col("l_orderkey").alias("document"), F.col("l_partkey").alias("job"), F.col("l_shipdate").alias("done_at"))
