"""Queries of text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.operators import text as op
from quarry.registry import query
from quarry.sources import concepts as c

TERMS = ["the", "of", "ent"]


def _occ(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, '{term}', ''))) // {len(term)})"


@query("""WITH s AS (SELECT conv_id, turn, role, text, 0 + """ + " + ".join(f"3 * {_occ('lower(role)', t)} + least({_occ('lower(text)', t)}, 5)" for t in TERMS) + """
  + CASE WHEN contains(lower(text), 'of the') OR contains(lower(role), 'of the') THEN 5 ELSE 0 END AS score FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(text), 'of') OR contains(lower(text), 'ent'))
SELECT conv_id, turn, role, score::BIGINT AS score FROM s ORDER BY score DESC, conv_id, turn, role LIMIT 50""")
def law_search_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best fifty texts by weighted term counts (the limit is the feature)."""
    rows = c.read(spark, sf_dir, "conversations")
    some = F.lower("text").contains("the") | F.lower("text").contains("of") | F.lower("text").contains("ent")
    scored = rows.where(some).select("conv_id", "turn", "role", op.law_score(F.col("role"), F.col("text"), TERMS, "of the").alias("score"))
    return scored.orderBy(F.desc("score"), "conv_id", "turn", "role").limit(50)


TOKENS = r"toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS tokens FROM documents)"


@query("WITH " + TOKENS + r""", q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM benchmark),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), len AS (SELECT doc_id, len(tokens)::DOUBLE AS len FROM toks), w AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM len),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)))), 6) AS score
  FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN w GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS place FROM scored QUALIFY place <= 10""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for the words of each benchmark item."""
    docs = c.read(spark, sf_dir, "documents").select("doc_id", fn.tokens(F.col("text")).alias("tokens"))
    queries = c.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), fn.tokens(F.col("text")).alias("terms"))
    return op.top(op.bm25(docs, queries), "query_id", 10, "doc_id")


@query(r"""WITH t AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ts FROM conversations)
SELECT conv_id, turn, role, round(least(1.0, (2 * len(list_intersect(ts, ['the', 'of', 'and', 'de'])) + len(list_intersect(ts, ['la', 'der', 'and'])))::DOUBLE / 8), 6) AS score FROM t""")
def token_overlap_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of object and project tokens with a question."""
    ts = F.array_distinct(fn.tokens(F.col("text")))
    n = lambda *w: F.size(F.array_intersect(ts, F.array(*map(F.lit, w))))
    return c.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.round(F.least(F.lit(1.0), (2 * n("the", "of", "and", "de") + n("la", "der", "and")) / 8), 6).alias("score"))


@query("""WITH f AS (SELECT DISTINCT o_custkey AS k, l_partkey AS feature FROM orders JOIN lineitem ON o_orderkey = l_orderkey), s AS (SELECT k, count(*) AS n FROM f GROUP BY 1),
p AS (SELECT a.k AS a, b.k AS b, round(count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS score FROM f a JOIN f b ON a.feature = b.feature AND a.k <> b.k AND a.k % 20 = 0 JOIN s x ON x.k = a.k JOIN s y ON y.k = b.k GROUP BY 1, 2)
SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INT AS place FROM p QUALIFY place <= 5""")
def jaccard_similar_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five customers most similar to each twentieth one by the parts they share (the limit is the feature)."""
    o = c.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k"))
    f = c.read(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("k", F.col("l_partkey").alias("feature"))
    return op.similar(f, o.where("k % 20 = 0"), "k", "feature", 5)


@query("""SELECT doc_id, i - 1 AS sentence_no, length(s) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i FROM documents) WHERE trim(s) <> ''""")
def line_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with their places."""
    rows = c.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("sentence_no", "s")).where("trim(s) <> ''")
    return rows.select("doc_id", "sentence_no", F.length("s").cast("long").alias("chars"))


NAMES = {"the": "en:the", "and": "en:and", "der": "de:der", "und": "de:und", "les": "fr:les", "of the": "en:of-the", "los": "es:los", "que": "es:que"}
RULES = [(r"(?i)^\s*(?:in|with|by)\s*$", "RELATED", 0.6), (r"^\s*,\s*$", "LISTED", 0.35), (r"^\s*$", "FOLLOWS", 0.35)]


@query(None)
def gazetteer_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest mentions of a gazetteer in sentences (held against a plain scan in tests)."""
    return op.mentions(op.sentences(c.read(spark, sf_dir, "documents")), NAMES)


@query(None)
def relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed relations between adjacent mentions."""
    rows = op.sentences(c.read(spark, sf_dir, "documents"))
    return op.rule_relations(op.mentions(rows, NAMES), rows, RULES)


@query(None)
def relation_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that rules type, and those that sharing sentences suggests beside them (held against a plain scan in tests)."""
    return op.relation_proposals(c.read(spark, sf_dir, "documents"), NAMES, RULES, 2)


@query("""WITH t AS (SELECT DISTINCT conv_id AS doc_id, turn AS sentence_no, role || ':' || (length(text) % 5) AS entity FROM conversations UNION SELECT conv_id, turn, 'len:' || (length(text) % 7) FROM conversations),
known AS (SELECT DISTINCT 'len:' || (length(text) % 7) AS a, role || ':' || (length(text) % 5) AS b FROM conversations WHERE turn = 0)
SELECT a.entity AS a, b.entity AS b, count(*) AS support, round(least(0.5, 0.15::DOUBLE + 0.05::DOUBLE * count(*)), 6) AS confidence
FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.sentence_no = b.sentence_no AND a.entity < b.entity WHERE NOT EXISTS (SELECT 1 FROM known k WHERE (k.a = a.entity AND k.b = b.entity) OR (k.b = a.entity AND k.a = b.entity)) GROUP BY 1, 2 HAVING count(*) >= 2""")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that share a turn at least twice, but for those that the first turns have typed."""
    x = c.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sentence_no"), "role", F.length("text").alias("n"))
    of_role, of_length = F.concat("role", F.lit(":"), (F.col("n") % 5).cast("string")), F.concat(F.lit("len:"), (F.col("n") % 7).cast("string"))
    typed = x.where("sentence_no = 0").select(of_role.alias("entity"), of_length.alias("other"))
    return op.cooccurrences(x.select("doc_id", "sentence_no", F.explode(F.array(of_role, of_length)).alias("entity")), 2, typed)


CATEGORIES = [("^small", "small"), ("(?i)ring$", "ring"), ("widget|gear", "machine")]


@query("""SELECT p_partkey, CASE WHEN p_name ~ '^small.*' THEN 'small' WHEN regexp_matches(p_name, '(?i)ring$') THEN 'ring' WHEN regexp_matches(p_name, 'widget|gear') THEN 'machine' ELSE 'other' END AS category FROM part""")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching class of an ordered rule table."""
    return c.read(spark, sf_dir, "part").select("p_partkey", fn.first_match(F.col("p_name"), CATEGORIES, "other").alias("category"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<mail>', 'g'), '\+?[0-9][0-9 ()-]{7,}[0-9]', '<phone>', 'g') AS scrubbed FROM documents""")
def pii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses and telephone numbers replaced."""
    return c.read(spark, sf_dir, "documents").select("doc_id", fn.scrub(F.col("text")).alias("scrubbed"))


@query("""SELECT p_partkey, round(abs(p_size - 20) / 20.0::DOUBLE, 6) AS error FROM part WHERE abs(p_size - 20) / 20.0::DOUBLE <= 0.15""")
def dimension_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose size is within 15 % of a wanted one."""
    error = F.array_min(F.transform(F.array(F.lit(20)), lambda d: F.abs(F.col("p_size") - d) / d.cast("double")))
    return c.read(spark, sf_dir, "part").select("p_partkey", F.round(error, 6).alias("error")).where(error <= 0.15)


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'token') THEN 'token' WHEN contains(lower(text), 'password') THEN 'password' WHEN contains(lower(text), 'akia') THEN 'key' END AS reason
FROM documents WHERE contains(lower(text), 'token') OR contains(lower(text), 'password') OR contains(lower(text), 'akia')""")
def credential_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a memory may not take up."""
    t = F.lower("text")
    reason = F.when(t.contains("token"), "token").when(t.contains("password"), "password").when(t.contains("akia"), "key")
    return c.read(spark, sf_dir, "documents").select("doc_id", reason.alias("reason")).where("reason is not null")


@query(r"""SELECT o_orderkey, regexp_extract(o_orderpriority, '^([0-9]+)-(.*)$', 1)::INT AS article, lower(regexp_replace(regexp_extract(o_orderpriority, '^([0-9]+)-(.*)$', 2), '[^A-Za-z]+', '-', 'g')) AS slug FROM orders""")
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and slug of a label."""
    p = r"^([0-9]+)-(.*)$"
    slug = F.lower(F.regexp_replace(F.regexp_extract("o_orderpriority", p, 2), "[^A-Za-z]+", "-"))
    return c.read(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract("o_orderpriority", p, 1).cast("int").alias("article"), slug.alias("slug"))


@query(r"""WITH t AS (SELECT p_partkey, p_name, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+')) AS w FROM part),
g AS (SELECT DISTINCT p_partkey, substr('  ' || w || ' ', i::INT, 3) AS g FROM t, range(1, 40) r(i) WHERE i <= length(w) + 1),
q AS (SELECT DISTINCT substr('  ' || w || ' ', i::INT, 3) AS g FROM (SELECT unnest(['red', 'rings']) AS w), range(1, 40) r(i) WHERE i <= length(w) + 1)
SELECT p_partkey, round(count(q.g)::DOUBLE / (SELECT count(*) FROM q), 6) AS similarity FROM g LEFT JOIN q ON g.g = q.g GROUP BY 1""")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of a query's trigrams that each name has."""
    return c.read(spark, sf_dir, "part").select("p_partkey", F.round(fn.containment(F.lit("red rings"), F.col("p_name")), 6).alias("similarity"))
