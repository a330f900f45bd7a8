"""Operators that SQL cannot express, and edge cases of others, against plain restatements."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as text_fn
from quarry.functions import vector as vector_fn
from quarry.operators import catalog, diff, graph, ranking, regulation, review, spatial, temporal
from quarry.operators import text as text_op
from quarry.sources import readers, sinks
from quarry.streaming import events


def test_mentions_are_longest_and_do_not_overlap(spark):
    rows = spark.createDataFrame([(1, 0, "The Red House and red, HOUSE Redd"), (2, 0, None), (3, 0, "")], "doc_id long, sentence_no int, sentence string")
    names = {"red": "r", "red house": "rh", "house": "h"}
    got = [(r.doc_id, r.entity, r.start, r.end) for r in text_op.mentions(rows, names).orderBy("doc_id", "nr").collect()]
    assert got == [(1, "rh", 4, 13), (1, "r", 18, 21), (1, "h", 23, 28)]
    assert text_op.mentions(rows, {}).count() == 0


def test_rules_join_adjacent_mentions(spark):
    docs = spark.createDataFrame([(1, "alpha with beta. beta, gamma! alpha near gamma"), (2, "alpha with beta")], "doc_id long, text string")
    rows = text_op.sentences(docs)
    found = text_op.mentions(rows, {x: x for x in ("alpha", "beta", "gamma")})
    got = {(r.entity, r.relation, r.other): (r.support, r.confidence) for r in text_op.rule_relations(found, rows, [(r"^ with $", "WITH", 0.6), (r"^,", "LIST", 0.35)]).collect()}
    assert got == {("alpha", "WITH", "beta"): (2, 0.65), ("beta", "LIST", "gamma"): (1, 0.35)}


def test_greedy_takes_nearest_free_in_source_order(spark):
    pairs = spark.createDataFrame([("p", 1, 10, 2.0), ("p", 2, 10, 1.0), ("p", 2, 11, 3.0), ("p", 3, 10, 0.5), ("q", 1, 10, 1.0)], "plan string, a long, b long, distance double")
    assert sorted((r.plan, r.a, r.b) for r in spatial.greedy(pairs).collect()) == [("p", 1, 10), ("p", 2, 11), ("q", 1, 10)]


def test_labels_partition_the_nodes(spark):
    edges = spark.createDataFrame([("a", "P", "b"), ("b", "P", "c"), ("a", "P", "c"), ("x", "P", "y")], "src string, predicate string, dst string")
    got = {r.node: r.label for r in graph.label_communities(edges, 4).collect()}
    assert set(got) == set("abcxy")
    assert not {got[n] for n in "abc"} & {got[n] for n in "xy"}


def test_waves_and_downstream():
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    assert graph.waves(edges) == [["a"], ["b", "c"], ["d"]]
    assert graph.downstream(edges, {"b"}) == {"d"}
    with pytest.raises(ValueError, match="cycle"):
        graph.waves([("a", "b"), ("b", "a")])


def test_closure_reports_capped_and_unresolved(spark):
    refs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (1, 9)], "key int, target int")
    known = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "key int")
    roots = spark.createDataFrame([(1,)], "key int")
    got = {r.key: (r.depth, r.state) for r in graph.closure(refs, known, roots, 2).collect()}
    assert got == {1: (0, "resolved"), 2: (1, "resolved"), 9: (1, "unresolved"), 3: (2, "resolved"), 4: (3, "capped")}


def test_validity_bounds(spark):
    rows = spark.createDataFrame([(1, 5, 9), (2, None, 9), (3, 5, None), (4, 9, None), (5, None, None)], "id int, a int, b int")
    at = F.lit(9)
    got = {r.id: (r.h, r.d) for r in rows.select("id", temporal.half_open(at, "a", "b").alias("h"), temporal.decidable(at, "a", "b").alias("d")).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, True), 4: (True, True), 5: (True, None)}


def test_wildcards_and_literals(spark):
    rows = spark.createDataFrame([("A%b",), ("Axxb",), ("a_b",)], "label string")
    pick = lambda c: sorted(r.label for r in rows.where(c).collect())
    assert pick(catalog.wildcard("label", "a*b")) == ["A%b", "Axxb", "a_b"]
    assert pick(catalog.wildcard("label", "a%b")) == ["A%b"]
    assert pick(catalog.wildcard("label", "a?b")) == ["A%b", "a_b"]
    assert pick(catalog.literal("label", "%")) == ["A%b"]


def test_fusion_counts_a_repeated_item_once(spark):
    rows = spark.createDataFrame([("q", "s", 1.0, "x", 1), ("q", "s", 1.0, "x", 2), ("q", "s", 1.0, "y", 3), ("q", "t", 0.5, "y", 1)], "q string, source string, weight double, item string, place long")
    got = {r.item: (r.score, r.channels) for r in ranking.fuse(rows, ["q"]).collect()}
    assert got == {"x": (round(1 / 61, 9), 1), "y": (round(1 / 63 + 0.5 / 61, 9), 2)}


def test_ledger_replaces_and_bounds(spark):
    rows = [(i, 1, "approve", 1, None, ["k"]) for i in range(2)] + [(10 + i, 100 + i, "reject", 1, None, ["k", "k"]) for i in range(9)] + [(50, 7, "none", 3, None, ["k"]), (51, 7, "approve", 2, None, ["k"])]
    events_ = spark.createDataFrame(rows, "event_id long, subject long, effect string, review_rev int, created_at timestamp, weight_keys array<string>")
    assert [tuple(r) for r in review.ledger(events_, "subject").collect()] == [("k", -8, 750)]


def test_rules_are_three_valued(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None)], "id int, x double")
    assert [r.v for r in rows.select("id", regulation.rule("x", "<=", 10).alias("v")).orderBy("id").collect()] == ["PASS", "FAIL", "REVIEW"]
    with pytest.raises(ValueError, match="operator"):
        regulation.rule("x", "~", 1)


def test_diff_lists_changed_fields(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", 2), (3, "c", 1)], "id int, x string, y int")
    got = {r.id: (r.state, r.fields) for r in diff.compare(old, new, "id", ["x", "y"]).collect()}
    assert got == {1: ("changed", ["y"]), 2: ("removed", []), 3: ("added", [])}


def test_functions_on_text_and_vectors(spark):
    row = spark.range(1).select(
        text_fn.scrub(F.lit("mail a.b@c.org or +82 10 1234 5678 in /home/kim/x")).alias("s"),
        text_fn.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j"),
        vector_fn.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("c"),
        vector_fn.hash_embedding(F.array(F.lit("x"), F.lit("x"))).alias("h"),
    ).first()
    assert row.s == "mail <mail> or <phone> in /home/<user>/x"
    assert row.j == 0.5
    assert row.c is None
    assert len(row.h) == 64
    assert sorted(map(abs, row.h))[-1] == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n{"x": 3')
    assert sorted(r.x for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    (tmp_path / "s.ifc").write_text("HEADER;\n#1=IFCWALL('w',#2);\n#2= IFCAXIS(1.,\n#3);\n#3=IFCPOINT();\nENDSEC;")
    ents = readers.step(spark, str(tmp_path / "s.ifc"))
    assert sorted((r.id, r.type) for r in ents.collect()) == [(1, "IFCWALL"), (2, "IFCAXIS"), (3, "IFCPOINT")]
    assert sorted((r.src, r.dst) for r in readers.step_references(ents).collect()) == [(1, 2), (2, 3)]
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"p"},"geometry":{"type":"LineString","coordinates":[[1,2],[3,-4.5]]}},{"properties":{"name":"q"},"geometry":{"type":"Point","coordinates":[7,8]}}]}')
    got = {r.name: (r.type, r.x0, r.y0, r.x1, r.y1) for r in readers.geojson(spark, str(tmp_path / "g.json")).collect()}
    assert got == {"p": ("LineString", 1.0, -4.5, 3.0, 2.0), "q": ("Point", 7.0, 8.0, 7.0, 8.0)}
    (tmp_path / "n.json").write_text('{"nodes":[{"id":"a","label":"A"}],"links":[{"source":"a","target":"b","type":"T"}]}')
    nodes, edges = readers.graph_json(spark, str(tmp_path / "n.json"))
    assert [tuple(r) for r in nodes.collect()] == [("a", "A", None)]
    assert [tuple(r) for r in edges.collect()] == [("a", "T", "b")]
    docs = spark.createDataFrame([(1, "# A\ntext\n## B\n### C\n## D"), (2, "flow\nA[x] -->|to| B\nB --> C")], "doc_id long, text string")
    assert [(r.title, r.parent) for r in readers.headings(docs).orderBy("place").collect()] == [("A", None), ("B", "A"), ("C", "B"), ("D", "A")]
    assert sorted((r.src, r.label, r.dst) for r in readers.mermaid(docs).collect()) == [("A", "to", "B"), ("B", "", "C")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.dwg").write_bytes(b"AC1032\0\0")
    (tmp_path / "d" / "~$x.dwg").write_bytes(b"zz")
    files = readers.wanted(readers.census(spark, str(tmp_path / "d")), ["dwg"])
    assert [(r.name, r.version) for r in files.collect()] == [("x.dwg", "AC1032")]
    (tmp_path / "log.jsonl").write_text('{"session_id":"s","provider":"p","tool":"t2","at":"2"}\n{"session_id":"s","provider":"p","tool":"t1","decision":"d","at":"1"}\n')
    assert [tuple(r)[:3] for r in readers.sessions(spark, str(tmp_path / "log.jsonl")).collect()] == [("p", "s", ["t1", "t2"])]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'A & "B"'), ("b", None)], "key string, name string")
    edges = spark.createDataFrame([("a", "part of", "b")], "src string, predicate string, dst string")
    xml = "".join(r.value for r in sinks.graphml(nodes, edges).collect())
    assert re.fullmatch(r"<\?xml.*<graph .*A &amp; &quot;B&quot;.*<edge source=\"a\" target=\"b\">.*</graph></graphml>", xml)
    assert [r.value for r in sinks.cypher(nodes, edges).collect()][-1].endswith("MERGE (a)-[:PART_OF]->(b);")
    assert sinks.turtle(nodes, edges, "http://x/").count() == 3
    assert [r.value for r in sinks.mermaid(edges).collect()] == ["  a -->|part of| b"]
    assert sinks.jsonld(nodes, edges, "http://x/").count() == 2
    assert [r.value for r in sinks.inserts(nodes, "t").collect()][1] == "INSERT INTO t (key, name) VALUES ('b', NULL);"
    sinks.tables({"edges": edges}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "edges.parquet")).count() == spark.read.json(str(tmp_path / "edges.jsonl")).count() == 1
    path = sinks.versioned(nodes, str(tmp_path / "v"), "1")
    assert spark.read.parquet(path).count() == 2
    sinks.by_document(spark.createDataFrame([(1, "a"), (2, "b")], "doc int, x string"), str(tmp_path / "p"), "doc")
    sinks.by_document(spark.createDataFrame([(2, "c")], "doc int, x string"), str(tmp_path / "p"), "doc")
    assert sorted((r.doc, r.x) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "a"), (2, "c")]


def test_outbox_backs_off(spark):
    rows = spark.sql("select * from values (1, 0, null, false), (2, 3, timestamp'2024-01-01 00:00:00', false), (3, 3, timestamp'2024-01-01 00:00:09', false), (4, 5, null, false), (5, 1, null, true) as t(event_id, attempts, last_try, acked)")
    assert [r.state for r in events.outbox(rows, "2024-01-01 00:00:10").orderBy("event_id").collect()] == ["send", "send", "wait", "dead", "done"]


def test_extent_similarity_is_the_best_of_all_runs():
    from quarry.operators.search import extent_similarity

    def grams(s):
        return [f"  {w} "[i : i + 3] for w in re.findall(r"\w+", s.lower()) for i in range(len(w) + 1)]

    for query, text in [("word", "two words"), ("red ring", "a red shiny rings"), ("abc", ""), ("", "abc"), ("zzz", "abc"), ("ring", "ringing ring")]:
        want, have = set(grams(query)), grams(text)
        best = max((len(want & set(have[i:j])) / len(want | set(have[i:j])) for i in range(len(have)) for j in range(i + 1, len(have) + 1) if want & set(have[i:j])), default=0.0) if want else 0.0
        assert abs(extent_similarity(query, text) - best) < 1e-12


def test_questions_are_parsed_on_the_driver():
    from quarry.operators.search import parse

    got = parse("Show doors on 3F near machine room", {"doors": "IfcDoor"}, {"machine room": "plant"})
    assert got.storey == "3F"
    assert got.kind == "IfcDoor"
    assert got.terms == ("show", "on", "near", "plant")


def test_reembedding_takes_each_new_text_once(spark):
    from quarry.operators import knowledge

    objects = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "object_id long, text string")
    known = spark.createDataFrame([("b",)], "text string").select(F.sha2("text", 256).alias("content_hash"))
    fresh, mapping = knowledge.reembed(objects, known, lambda texts: [[float(len(t))] for t in texts])
    assert [list(r.embedding) for r in fresh.collect()] == [[1.0]]
    assert mapping.count() == 3


def test_names_that_are_unknown_or_taken_raise():
    from quarry.operators import knowledge

    with pytest.raises(ValueError, match="bucket"):
        knowledge.in_bucket("state", "maybe")
    knowledge.plugin("x")(len)
    with pytest.raises(ValueError, match="taken"):
        knowledge.plugin("x")(len)
    del knowledge.REGISTRY["x"]


def test_nothing_outside_the_subpackage_imports_it():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "quarry"
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            assert "llm" not in path.read_text()


def test_the_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) > 100


def test_drawings_and_graphs_are_read(spark, tmp_path):
    pairs = [(0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1032"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"), (0, "LINE"), (8, "A-WALL"), (10, "1.5"), (20, "2"), (0, "TEXT"), (8, "A-ANNO"), (1, "101"), (0, "ENDSEC"), (0, "EOF")]
    (tmp_path / "a.dxf").write_text("\n".join(f"{k}\n{v}" for k, v in pairs) + "\n")
    got = [(r.kind, r.layer, r.text, r.x, r.y) for r in readers.dxf(spark, str(tmp_path / "a.dxf")).orderBy("entity_no").collect()]
    assert got == [("LINE", "A-WALL", None, 1.5, 2.0), ("TEXT", "A-ANNO", "101", None, None)]
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="a"/><node id="b"><data/></node><edge source="a" target="b"/></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(r.key for r in nodes.collect()) == ["a", "b"]
    assert [tuple(r) for r in edges.collect()] == [("a", "b")]
