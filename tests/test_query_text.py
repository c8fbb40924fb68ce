"""Static analysis of query text: decision tables."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import literals
from graphloom.functions import query_text as q
from graphloom.functions import values

SCHEMA = q.Schema({"A": {"x": "INTEGER", "kind": "STRING"}, "B": {"y": "STRING"}}, {"R": {"w": "FLOAT"}}, {("A", "R", "B"): 3}, {"B.y": ("u", "v")})


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("MATCH (a:A) RETURN a.x", "simple_retrieval"),
        ("MATCH (a:A)-[:R]->(b:B)-[:S]->(c:C) RETURN c.z", "complex_retrieval"),
        ("MATCH (a:A) RETURN sum(a.x)", "simple_aggregation"),
        ("MATCH (a:A)-[:R]->(b:B) RETURN b.y, count(a)", "complex_aggregation"),
        ("MATCH (a:A) WITH max(a.x) AS m RETURN m", "complex_aggregation"),
        ("MATCH (a:A) RETURN a.x ORDER BY a.x LIMIT 3", "ranking_topk"),
        ("MATCH (a:A) WHERE NOT (a)-[:R]->(:B) RETURN a.x", "negation_difference"),
        ("MATCH (a:A) WHERE a.x IS NOT NULL RETURN a.x", "simple_retrieval"),
        ("MATCH (a:A)-[:R*1..2]->(b:B) RETURN b.y", "path_temporal"),
        ("MATCH (a:A {x: 1}) RETURN count(a) > 0 AS any", "boolean_existence"),
        ("MATCH (a:A) WHERE a.kind = 'NOT this' RETURN a", "simple_retrieval"),
    ],
)
def test_category(text, category):
    assert q.coarse_category(text) == category


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        ("MATCH (a:A)-[r:R]->(b:B) RETURN a.x, r.w", set()),
        ("MATCH (a:A)-[r:R]->(b:B {y: 'z'}) WHERE r.q > 1 RETURN a.k", {"unknown_relationship_property", "unknown_property", "invalid_categorical_value"}),
        ("MATCH (b:B)-[:R]->(a:A) RETURN a.x", {"wrong_direction"}),
        ("MATCH (b:B)-[:R]->(c:B) RETURN b.y", {"unseen_relationship_pattern"}),
        ("MATCH (a:A)--(b:B) RETURN a.x", {"missing_relationship_type"}),
        ("MATCH (a:A)-[:R]-(b:B) RETURN a.x", {"undirected_relationship"}),
        ("MATCH (a:A)<-[:R]->(b:B) RETURN a.x", {"bidirectional_relationship"}),
        ("MATCH (a:Z) RETURN a", {"unknown_label"}),
        ("MATCH (a:A)-[:Q]->(b:B) RETURN a.x", {"unknown_relationship"}),
        ("CREATE (n:A) RETURN n.x", {"not_read_only"}),
        ("MATCH (a:A RETURN a.x", {"unbalanced_parentheses"}),
        ("MATCH (n) RETURN n", {"generic_node_scan"}),
        ("hello", {"syntax_shape"}),
    ],
)
def test_issues(text, codes):
    assert {c for _, c, _ in q.issues(text, SCHEMA)} == codes


def test_write_tokens_fire_inside_literals_but_not_inside_words():
    assert not q.is_read_only("MATCH (a) WHERE a.x = 'drop it' RETURN a")
    assert q.is_read_only("MATCH (a:Asset) RETURN a.offset, a.created")


def test_normalize():
    assert q.normalize("MATCH  (a:A)\n WHERE a.kind = 'two  spaces'  RETURN a.x;") == "MATCH (a:A) WHERE a.kind = 'two  spaces' RETURN DISTINCT a.x"
    assert q.normalize("UNWIND [1] AS x RETURN x") == "UNWIND [1] AS x RETURN x"


def test_atoms_and_rename():
    text = "MATCH (a:A {x: 1})-[r:R {w: 2}]->(b:B) WHERE b.y = 'u' RETURN duration.between(a.x, b.y)"
    assert q.atoms(text) == {"label:A", "label:B", "rel:R", "pattern:(:A)-[:R]->(:B)", "prop:A.x", "prop:B.y", "cat:B.y", "relprop:R.w"}
    assert q.rename("MATCH (a:A)-[r:R]->(b:B) WHERE b.y = 'y' RETURN a.x, r.w", {"label:A": "label:N", "prop:B.y": "prop:B.why", "relprop:R.w": "relprop:R.weight"}) == "MATCH (a:N)-[r:R]->(b:B) WHERE b.why = 'y' RETURN a.x, r.weight"


@pytest.mark.parametrize(
    ("question", "text", "bound", "problem"),
    [
        ("Records named 'tag 12'?", "MATCH (s:T {id: 12}) RETURN s.id", [], "quoted value"),
        ("Which {k} accounts?", "MATCH (a:A) RETURN a.x", [], "unfilled placeholder"),
        ("Which have most?", "MATCH (a:A) RETURN a.x ORDER BY a.x LIMIT 10", [], "LIMIT 10"),
        ("Has person 7 worked there?", "MATCH (p:P {id: 7}) RETURN count(p) > 0 AS x", ["company"], "bound value"),
        ("Which are above the threshold?", "MATCH (a:A) WHERE a.x > 10000 RETURN a.x", [], "number 10000"),
        ("Who is reachable?", "MATCH (a:A)-[:R*1..3]->(b) RETURN b", [], "hop bound 3"),
        ("Which kinds?", "MATCH (a:A) WHERE a.kind IN ['red', 'blue'] RETURN a", [], "'red'"),
        ("Which 5 did most after January 1, 2022?", "MATCH (a:A) WHERE a.t > datetime('2022-01-01T00:00:00') RETURN a.x ORDER BY a.x LIMIT 5", [], None),
        ("More than 3 of them?", "MATCH (a:A) WITH a, count(*) AS c WHERE c >= 4 RETURN a.x", [], None),
        ("Within two hops of 7?", "MATCH (a:A {x: 7})-[:R*1..2]->(b:B) RETURN b.y", [7], None),
        ("Within 7 days?", "MATCH (a:A) WHERE a.t <= a.s + duration('P7D') RETURN a.x", [], None),
        ("The top twenty?", "MATCH (a:A) RETURN a.x ORDER BY a.x LIMIT 20", [], None),
        ("The first of them?", "MATCH (a:A) RETURN a.x ORDER BY a.x LIMIT 2", [], "LIMIT 2"),
        ("In thirteen of a dozen?", "MATCH (a:A) WHERE a.x > 14 AND a.z = 12 RETURN a", [], None),
        ("Twenty-five or fifty?", "MATCH (a:A) WHERE a.x IN [25, 50] RETURN a", [], None),
        ("In the last month or year?", "MATCH (a:A) WHERE a.x > 30 AND a.z < 365 RETURN a", [], None),
        ("What happened in Mar 2012?", "MATCH (a:A) WHERE a.t >= date('2012-03-01') AND a.t < date('2012-04-01') RETURN a", [], None),
        ("What happened in 2012-03?", "MATCH (a:A) WHERE a.t >= date('2012-03-01') RETURN a", [], None),
        ("What happened in March 2012?", "MATCH (a:A) WHERE a.t >= date('2012-05-01') AND a.z = 7 RETURN a", [], "number 7"),
        ("On the 3rd of May, 2020?", "MATCH (a:A) WHERE a.t = date('2020-05-03') RETURN a", [], None),
        ("On the 3rd of May, 2020?", "MATCH (a:A) WHERE a.t = date('2020-05-04') RETURN a", [], "2020-05-04"),
        ("In 2019?", "MATCH (a:A) WHERE a.t <= date('2019-12-31') AND a.t >= date('2019-01-01') AND a.s < date('2020-01-01') RETURN a", [], None),
        ("Within a week?", "MATCH (a:A) WHERE a.t <= a.s + duration('P1W') AND a.z < a.s + duration('PT36H') RETURN a", [], "PT36H"),
        ("Which have “tag x”?", "MATCH (a:A) WHERE a.t = 'tag y' RETURN a", [], "quoted value 'tag x'"),
        ("Which of kind red-ish blue?", "MATCH (a:A {kind: 'red_ish'}) RETURN a", [], None),
        ("Half of it?", "MATCH (a:A) WHERE a.x > a.z / 20 RETURN collect({type: 'Thing'}) AS c", [], None),
    ],
)
def test_literals(question, text, bound, problem):
    found = literals.literal_problems(question, text, bound)
    assert found == [] if problem is None else any(problem in f for f in found)


def test_slots_and_prefixes():
    found, problem = q.binding_queries("MATCH (a:A {x: $k, z: 1})-[:R]->(b:B) WHERE b.y = $v WITH a, count(b) AS n RETURN a.x, n", ["k", "v"], 5)
    assert problem is None
    assert found[1] == ("derived_prefix", "MATCH (a:A {z: 1})-[:R]->(b:B) WHERE true RETURN DISTINCT a.x AS k, b.y AS v LIMIT 5")
    assert q.binding_queries("MATCH (a:A) WHERE a.x > $k RETURN a", ["k"], 5)[1]
    assert [s for s, _ in q.prefix_counts("MATCH (a:A) WHERE a.x = 3 WITH a RETURN a")] == ["1:match", "2:where", "3:with"]
    assert q.empty_class("MATCH (a:A) WHERE a.x = 3 RETURN a", [("1:match", "MATCH (a:A) RETURN COUNT(*) AS n", 5), ("2:where", "MATCH (a:A) WHERE a.x = 3 RETURN COUNT(*) AS n", 0)]) == "literal_miss"
    assert q.degenerate([]) and q.degenerate([{"n": 0, "m": None}]) and not q.degenerate([{"b": False}])


def test_scope_and_checklist():
    assert q.dropped_variables("MATCH (a:A)-[:R]->(b) WITH a MATCH (b)-[:R]->(c) RETURN c") == ["b"]
    assert q.unlisted_triples("MATCH (b:B)-[:R]->(c:B) RETURN b", SCHEMA) == ["(B)-[R]->(B)"]
    good = dict.fromkeys(q.CHECKLIST, "yes") | {"ranking": "na"}
    assert q.checklist_passes(good)
    assert not q.checklist_passes(good | {"unambiguous": "na"})
    assert not q.checklist_passes({k: v for k, v in good.items() if k != "values"})


def test_texts_are_dealt_over_the_cores_and_looked_at_once(spark, tmp_path):
    """A small file is one partition; its texts are looked at in many tasks, equal ones of a task once, however many batches it has."""
    from graphloom.plans import text_queries

    spark.range(3000).select((F.col("id") + 1).alias("c_custkey"), F.lit("a").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("B").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    out = text_queries.QUERIES["q12_scope"](spark, str(tmp_path))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    calls = tmp_path / "calls"

    def note(text):
        with open(calls, "a") as f:
            f.write("x")
        return text.upper()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(0, 1000, 1, 1).select((F.col("id") % 3).cast("string").alias("t")).select(q.frame(note, "string", "t").alias("u"))
        assert rows.groupBy("u").count().count() == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(calls.read_text()) == 3


def test_ground_bound_loses_nothing():
    """Fuzzy matches are those of the full ratio over all names."""
    from difflib import SequenceMatcher

    entries = [values.Entry("City", "name", n) for n in ("Berlin", "Bern", "Berlinn", "Bergen")]
    for word in ("berlim", "berlln", "nilreb", "bernn", "bergenn"):
        best = max(SequenceMatcher(None, word, a).ratio() for e in entries for a in values.aliases(e) if values.comparable(a, word))
        assert [m.score for m in values.ground(word, entries)] == ([round(best, 3)] if best >= values.FUZZY else [])
