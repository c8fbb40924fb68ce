"""Values, rewrites, templates: hand-computed cases."""

from graphloom.functions import values as v
from graphloom.operators import benchmarks
from graphloom.plans.compiler import cypher
from graphloom.plans.catalog import table_graph
from graphloom.sources.files import schema_of


def test_canonical_values():
    assert v.canonical_value(3) == v.canonical_value(3.0) == "3"
    assert v.canonical_value(0.1 + 0.2) == v.canonical_value(0.3)
    assert v.canonical_value([2, 1.0]) == "[1,2]" and v.canonical_value(True) == "true" and v.canonical_value("3") == '"3"'
    assert v.canonical_rows([{"a": 1, "b": [1, 2]}]) == v.canonical_rows([{"b": [2, 1.0], "a": 1.0}])


def test_grounding():
    entries = [v.Entry("Genre", "name", "Science Fiction", ("sci-fi",)), v.Entry("City", "name", "Berlin"), v.Entry("City", "name", "Berlin Mitte")]
    found = v.ground("Which sci-fi films from Berlin Mitte and Berlinn?", entries)
    assert [(m.entry.value, m.kind) for m in found] == [("Science Fiction", "alias"), ("Berlin Mitte", "exact"), ("Berlin", "fuzzy")]
    assert v.annotate("in Berlin", v.ground("in Berlin", entries)) == "in (City.name: Berlin)"
    assert v.ground("", entries) == []


def test_placeholders():
    q, c, names = v.with_placeholders("Is 'Ann Lee' older than Bo?", "MATCH (p:P {name: 'Ann Lee'}) RETURN p", ["Bo", None, "x"])
    assert (q, c) == ("Is '{{NAME_1}}' older than {{VALUE_1}}?", "MATCH (p:P {name: '{{NAME_1}}'}) RETURN p")
    assert names == {"Ann Lee": "{{NAME_1}}", "Bo": "{{VALUE_1}}"}


def test_rewrites():
    assert v.without_id_tiebreak("MATCH (a) RETURN a.x ORDER BY n DESC, a.userId ASC LIMIT 1", "most?") == "MATCH (a) RETURN a.x ORDER BY n DESC LIMIT 1"
    assert v.without_id_tiebreak("MATCH (a) RETURN a.x ORDER BY n, a.id LIMIT 1", "sorted by n then id") == "MATCH (a) RETURN a.x ORDER BY n, a.id LIMIT 1"
    assert v.question_constraints("Who is 'Bo'?", "MATCH (a) WHERE a.n CONTAINS 'Bo' RETURN a") == [("error", "quoted_value_fuzzy_match", "Bo")]
    assert v.rewrite_classes("RETURN  1", "RETURN 1") == ["formatting_only"]
    assert v.rewrite_classes("MATCH (a) RETURN a", "MATCH (a) RETURN DISTINCT a") == ["return_distinct_inserted", "return_distinct_only"]


def test_contract_and_order():
    q = "MATCH (a:Account) RETURN a.accountId AS id, a.kind AS kind, COUNT(*) AS n"
    assert v.answer_contract(q, ["id", "kind", "n"], {"Account": {"accountId": ("kind",)}})["context_columns"] == ["kind"]
    q = "MATCH (a:A) RETURN a.x AS x, a.y AS y ORDER BY a.x DESC"
    rows = [{"x": 3, "y": 1}, {"x": 3, "y": 2}, {"x": 1, "y": 0}]
    assert v.order_consistent(q, rows, [rows[1], rows[0], rows[2]], {"x": "x"}) is True
    assert v.order_consistent(q, rows, rows[::-1], {"x": "x"}) is False
    assert v.order_consistent("MATCH (a) RETURN a.x", rows, rows, {"x": "x"}) is None


def test_variants():
    out = v.expand_variants({"g": {"k": 1, "j": 2}}, {"a": {"g": {"k": 5}}, "b": {}})
    assert out == {"a": {"g": {"k": 5, "j": 2}}, "b": {"g": {"k": 1, "j": 2}}}


def test_every_schema_template_compiles(spark, sf_dir):
    graph = table_graph(spark, sf_dir)
    schema = schema_of(graph)
    found = v.schema_templates(schema.nodes, [t for t in schema.patterns if t[1] in ("PLACED", "IN_NATION")])
    assert {t["category"] for t in found} == {"simple_aggregation", "ranking_topk", "negation_difference"}
    assert any(t["kind"].startswith("negation_context") for t in found)
    for t in found[::3]:
        cypher(spark, graph, t["cypher"], dict.fromkeys(t["slots"], 1) if t["slots"] else None)


def test_self_preference(spark):
    rows = [(m, g, 1.0 if m == g == "a" else 0.5) for m in "ab" for g in "ab" for _ in range(4)]
    out = {r["m"]: r for r in benchmarks.self_preference(spark.createDataFrame(rows, "m string, g string, y double"), "m", "g", "y").collect()}
    assert out["a"]["difference"] == 0.5 and out["a"]["did"] == 0.5
    assert out["b"]["difference"] == 0.0 and out["b"]["did"] == 0.5  # the other model does worse on what b made
