"""The compiler on a small graph: traps of Cypher semantics, with hand-computed results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.plans.catalog import GraphCatalog
from graphloom.plans.compiler import Compiler, cypher
from graphloom.plans.lexer import CypherError
from graphloom.plans.parser import parse


@pytest.fixture(scope="module")
def graph(spark):
    person = spark.createDataFrame([(1, "Ann", 30), (2, "Bob", None), (3, "Ann", 50), (4, "Dan", 20)], "_id long, name string, age int")
    forum = spark.createDataFrame([(10, "News"), (11, "News")], "_id long, title string")
    knows = spark.createDataFrame([(1, 2, 100, 5), (2, 3, 101, 7), (3, 1, 102, 9), (1, 2, 103, 1), (4, 4, 104, 2)], "_src long, _dst long, _eid long, since int")
    member = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (3, 11, 3)], "_src long, _dst long, _eid long")
    return GraphCatalog({"Person": person, "Forum": forum}, {("Person", "KNOWS", "Person"): knows, ("Person", "MEMBER_OF", "Forum"): member}, frozenset({"KNOWS"}))


def rows(spark, graph, text, **kw):
    return sorted(map(tuple, cypher(spark, graph, text, **kw).collect()), key=repr)


def test_multiplicity_is_kept(spark, graph):
    assert rows(spark, graph, "MATCH (a:Person {name: 'Ann'})-[:KNOWS]->(b) RETURN b.name AS b") == [("Ann",), ("Bob",), ("Bob",)]


def test_an_edge_binds_once_in_a_match_but_again_in_the_next(spark, graph):
    one = rows(spark, graph, "MATCH (a:Person)-[:KNOWS]->(b:Person)<-[:KNOWS]-(c:Person) RETURN COUNT(*) AS n")
    two = rows(spark, graph, "MATCH (a:Person)-[:KNOWS]->(b:Person) MATCH (b)<-[:KNOWS]-(c:Person) RETURN COUNT(*) AS n")
    assert (one, two) == ([(2,)], [(7,)])


def test_group_by_node_is_not_group_by_property(spark, graph):
    by_node = rows(spark, graph, "MATCH (f:Forum)<-[:MEMBER_OF]-(p) WITH f, COUNT(p) AS n RETURN f.title AS t, n")
    by_title = rows(spark, graph, "MATCH (f:Forum)<-[:MEMBER_OF]-(p) RETURN f.title AS t, COUNT(p) AS n")
    assert by_node == [("News", 1), ("News", 2)]
    assert by_title == [("News", 3)]


def test_optional_match_keeps_the_row_and_its_where_belongs_to_it(spark, graph):
    text = "MATCH (p:Person) OPTIONAL MATCH (p)-[:MEMBER_OF]->(f:Forum) WHERE f.title = 'None' RETURN p.name AS p, COUNT(f) AS n"
    assert rows(spark, graph, text) == [("Ann", 0), ("Bob", 0), ("Dan", 0)]


def test_undirected_counts_a_loop_once(spark, graph):
    assert rows(spark, graph, "MATCH (a:Person {name: 'Dan'})-[:KNOWS]-(b:Person) RETURN COUNT(*) AS n") == [(1,)]
    assert rows(spark, graph, "MATCH (a:Person {name: 'Bob'})-[:KNOWS]-(b:Person) RETURN COUNT(*) AS n") == [(3,)]


def test_variable_length_walks_trails(spark, graph):
    assert rows(spark, graph, "MATCH (a:Person {age: 30})-[:KNOWS*1..3]->(b:Person) RETURN COUNT(*) AS n") == [(6,)]
    assert rows(spark, graph, "MATCH (a:Person {age: 30})-[:KNOWS*0..1]->(b:Person) RETURN COUNT(*) AS n") == [(3,)]


def test_shortest_path(spark, graph):
    text = "MATCH p = shortestPath((a:Person {age: 30})-[:KNOWS*..3]->(b:Person)) RETURN b.name AS b, length(p) AS n"
    assert rows(spark, graph, text) == [("Ann", 2), ("Bob", 1)]


def test_negation_and_existence(spark, graph):
    assert rows(spark, graph, "MATCH (p:Person) WHERE NOT (p)-[:MEMBER_OF]->(:Forum) RETURN p.name AS p") == [("Dan",)]
    assert rows(spark, graph, "MATCH (p:Person) WHERE NOT EXISTS { MATCH (p)-[k:KNOWS]->(q:Person) WHERE k.since > 5 } RETURN p.name AS p") == [("Ann",), ("Dan",)]
    assert rows(spark, graph, "MATCH (p:Person) WHERE p.age > 25 OR EXISTS { (p)-[:MEMBER_OF]->(:Forum) } RETURN COUNT(p) AS n") == [(3,)]


def test_nulls_sort_last_ascending_and_first_descending(spark, graph):
    up = [r[0] for r in cypher(spark, graph, "MATCH (p:Person) RETURN p.age AS a ORDER BY a").collect()]
    down = [r[0] for r in cypher(spark, graph, "MATCH (p:Person) RETURN p.age AS a ORDER BY a DESC").collect()]
    assert up == [20, 30, 50, None]
    assert down == [None, 50, 30, 20]


def test_arithmetic_and_text(spark, graph):
    assert rows(spark, graph, "MATCH (p:Person {name: 'Dan'}) RETURN p.age / 3 AS q, p.age / 3.0 > 6.6 AS r, 'x' + p.age AS s, -p.age % 3 AS m") == [(6, True, "x20", -2)]


def test_sum_of_nothing_is_zero(spark, graph):
    assert rows(spark, graph, "MATCH (p:Person) WHERE p.age > 99 RETURN SUM(p.age) AS s, COUNT(p) AS n, AVG(p.age) AS a") == [(0, 0, None)]


def test_unknown_names_match_nothing_unless_strict(spark, graph):
    assert rows(spark, graph, "MATCH (x:Nothing) RETURN COUNT(x) AS n") == [(0,)]
    assert rows(spark, graph, "MATCH (p:Person {name: 'Dan'}) RETURN p.nothing AS x") == [(None,)]
    assert rows(spark, graph, "MATCH (p:Person)-[:NOTHING]->(q) RETURN COUNT(q) AS n") == [(0,)]
    for text in ("MATCH (x:Nothing) RETURN x", "MATCH (p:Person) RETURN p.nothing", "MATCH (p:Person)-[:NOTHING]->(q) RETURN q"):
        with pytest.raises(CypherError):
            cypher(spark, graph, text, strict=True)


def test_values_of_different_types_differ(spark, graph):
    assert rows(spark, graph, "MATCH (p:Person {age: '20'}) RETURN COUNT(p) AS n") == [(0,)]
    assert rows(spark, graph, "MATCH (p:Person) WHERE p.age <> 'x' RETURN COUNT(p) AS n") == [(3,)]
    assert rows(spark, graph, "MATCH (p:Person) WHERE p.age < 'x' RETURN COUNT(p) AS n") == [(0,)]


def test_a_dropped_variable_binds_anew(spark, graph):
    text = "MATCH (a:Person {name: 'Bob'})-[:KNOWS]->(b:Person) WITH a MATCH (b:Person)-[:MEMBER_OF]->(f:Forum) RETURN COUNT(b) AS n"
    assert rows(spark, graph, text) == [(3,)]


def test_whole_nodes_and_parameters(spark, graph):
    out = cypher(spark, graph, "MATCH (p:Person {name: $name}) RETURN p", {"name": "Dan"}).first()[0]
    assert out.asDict() == {"id": 4, "label": "Person", "age": 20, "name": "Dan"}


def test_properties_not_used_are_not_read(spark, graph):
    plan = cypher(spark, graph, "MATCH (p:Person)-[:MEMBER_OF]->(f:Forum) RETURN f.title AS t")._jdf.queryExecution().optimizedPlan().toString()
    assert "age" not in plan and "name" not in plan


@pytest.mark.parametrize("text", ["CREATE (n) RETURN n", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n) DETACH DELETE n", "MATCH (n)", "MATCH (n RETURN n", "RETURN 1 +", "MATCH (n) RETURN n.x LIMIT"])
def test_what_is_not_in_the_subset_is_rejected(text):
    with pytest.raises(CypherError):
        parse(text)


def chain(spark, hops, extra=()):
    """A chain 0 -> 1 -> ... of nodes A, and more edges."""
    nodes = spark.range(hops + 3).select(F.col("id").alias("_id"), F.col("id").alias("k"))
    pairs = [(i, i + 1) for i in range(hops)] + list(extra)
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "_src long, _dst long, _eid long")
    return GraphCatalog(nodes={"A": nodes}, edges={("A", "R", "A"): edges})


def test_unbounded_lengths_go_on_until_nothing_grows(spark):
    """Five hops and more, cycles included: each edge once a trail."""
    told = lambda g, q: rows(spark, g, q)
    g = chain(spark, 6)
    assert told(g, "MATCH (a:A {k: 0})-[:R*]->(b:A) RETURN b.k AS k") == [(i,) for i in range(1, 7)]
    assert told(g, "MATCH (a:A)-[:R*5..]->(b:A) WHERE a.k < 3 RETURN a.k AS a, b.k AS b") == [(0, 5), (0, 6), (1, 6)]
    assert told(g, "MATCH p = shortestPath((a:A {k: 1})-[:R*]-(b:A)) RETURN b.k AS k, length(p) AS n") == [(0, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
    assert told(g, "MATCH (a:A {k: 8})-[:R*]->(b:A) RETURN b.k AS k") == []
    ring = chain(spark, 3, [(3, 0)])
    assert told(ring, "MATCH (a:A {k: 2})-[:R*]->(b:A) RETURN b.k AS k") == [(0,), (1,), (2,), (3,)]
    assert told(ring, "MATCH (a:A {k: 2})-[:R*0..]->(b:A) RETURN b.k AS k") == [(0,), (1,), (2,), (2,), (3,)]


def test_paths_grow_from_bound_variables(spark):
    """Comma patterns that begin, end or pass at a bound variable, and a variable length after a fixed hop."""
    told = lambda g, q: rows(spark, g, q)
    g = chain(spark, 4, [(0, 2), (2, 0)])
    edges = {(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (2, 0)}
    assert told(g, "MATCH (a:A)-[:R]->(b:A), (b)-[:R]->(c:A), (a)-[:R]->(c) RETURN a.k AS a, b.k AS b, c.k AS c") == sorted((a, b, c) for a, b in edges for x, c in edges if b == x and (a, c) in edges)
    assert told(g, "MATCH (a:A)-[:R]->(b:A), (c:A)-[:R]->(a) RETURN a.k AS a, b.k AS b, c.k AS c") == sorted((a, b, c) for a, b in edges for c, y in edges if y == a and (c, y) != (a, b))
    assert told(g, "MATCH (a:A {k: 1})-[:R]->(b:A)-[:R*1..2]->(c:A) RETURN c.k AS c") == [(0,), (1,), (2,), (3,), (4,)]


def test_only_ends_matter(spark, monkeypatch):
    """DISTINCT ends and EXISTS on graphs with more trails than could be made: the same nodes as a search by hand."""
    told = lambda g, q: rows(spark, g, q)
    full = [(a, b) for a in range(12) for b in range(12) if a != b]  # 12 nodes, every edge: trails without number
    g = chain(spark, 12, full)
    monkeypatch.setattr(Compiler, "many", lambda *_: pytest.fail("trails"))
    everything = [(i,) for i in range(13)]
    assert told(g, "MATCH (a:A {k: 0})-[:R*]->(b:A) RETURN DISTINCT b.k AS k") == sorted(everything, key=repr)
    assert told(g, "MATCH (a:A)-[:R*]->(b:A) WHERE a.k = 0 AND b.k > 9 RETURN DISTINCT b.k AS k") == [(10,), (11,), (12,)]
    assert told(g, "MATCH (a:A)-[:R*]->(b:A) WHERE a.k < 2 RETURN a.k AS a, COUNT(DISTINCT b) AS n, MAX(b.k) AS most") == [(0, 13, 12), (1, 13, 12)]
    assert told(g, "MATCH (a:A) WHERE EXISTS { (a)-[:R*]->(:A {k: 12}) } RETURN COUNT(a) AS n") == [(12,)]
    assert told(g, "MATCH (a:A) WHERE NOT (a)-[:R*]->(:A {k: 12}) RETURN a.k AS k") == [(12,), (13,), (14,)]
    assert told(g, "MATCH (a:A) RETURN a.k AS k, EXISTS { (a)-[:R*1..1]->(:A {k: 12}) } AS e ORDER BY k") == sorted([(k, k == 11) for k in range(15)], key=repr)
    assert told(g, "MATCH (a:A {k: 12})-[:R*0..]-(b:A) RETURN COUNT(DISTINCT b) AS n") == [(13,)]
    assert told(g, "MATCH (a:A {k: 14})-[:R*0..]->(b:A) RETURN DISTINCT b.k AS k") == [(14,)]
    assert told(g, "MATCH (x:Nothing)-[:R*]->(b:A) RETURN DISTINCT b.k AS k") == []
    both = GraphCatalog(nodes=chain(spark, 5).nodes, edges={("A", t, "A"): spark.createDataFrame(e, "_src long, _dst long, _eid long") for t, e in (("R", [(0, 1, 1), (1, 2, 2), (2, 0, 3)]), ("S", [(2, 3, 1), (3, 4, 2), (5, 6, 3)]))})
    assert told(both, "MATCH (a:A)-[:R*]->(b:A)-[:S*]->(c:A) WHERE a.k = 0 RETURN DISTINCT c.k AS c") == [(3,), (4,)]
    assert told(both, "MATCH (a:A {k: 1})-[:R*]->(b:A)-[:S*]->(c:A) RETURN DISTINCT a.k AS a, b.k AS b, c.k AS c") == [(1, 2, 3), (1, 2, 4)]
    line = chain(spark, 6)
    assert told(line, "MATCH (a:A)-[:R*1..2]->(b:A) WHERE a.k IN [0, 3] RETURN DISTINCT b.k AS k") == [(1,), (2,), (4,), (5,)]
    assert told(line, "MATCH (a:A)-[:R*0..1]->(b:A) WHERE a.k IN [0, 3] RETURN DISTINCT b.k AS k") == [(0,), (1,), (3,), (4,)]
    assert told(line, "MATCH (a:A {k: 1}) OPTIONAL MATCH (a)-[:R*]->(b:A) WHERE b.k > 4 RETURN DISTINCT a.k AS a, b.k AS b") == [(1, 5), (1, 6)]
    assert told(line, "MATCH (a:A {k: 1})-[:R]->(c:A) MATCH (c)-[:R*]->(b:A) RETURN DISTINCT b.k AS b") == [(3,), (4,), (5,), (6,)]


def test_where_trails_matter_they_stay(spark):
    told = lambda g, q: rows(spark, g, q)
    g = chain(spark, 2)
    assert told(g, "MATCH (a:A {k: 0})-[:R*]-(b:A) RETURN DISTINCT b.k AS k") == [(1,), (2,)]  # no way back over the same edge
    assert told(g, "MATCH (a:A {k: 0})-[:R]->(b:A), (a)-[:R*]->(c:A) RETURN DISTINCT c.k AS k") == []  # the edge is bound already
    assert told(g, "MATCH (a:A)-[:R*2..]->(b:A) RETURN DISTINCT a.k AS a, b.k AS b") == [(0, 2)]
    ring = chain(spark, 2, [(1, 0)])
    assert told(ring, "MATCH (a:A {k: 0})-[:R*]->(b:A) RETURN COUNT(b) AS n") == [(3,)]
    assert told(ring, "MATCH (a:A {k: 0})-[r:R*]->(b:A) RETURN DISTINCT b.k AS k, size(r) AS n") == [(0, 2), (1, 1), (2, 2)]
    weighted = GraphCatalog(nodes={"A": spark.range(4).select(F.col("id").alias("_id"), F.col("id").alias("k"))}, edges={("A", "R", "A"): spark.createDataFrame([(0, 1, 1, "x"), (1, 2, 2, "x"), (2, 3, 3, "y")], "_src long, _dst long, _eid long, t string")})
    assert told(weighted, "MATCH (a:A {k: 0})-[:R* {t: 'x'}]->(b:A) RETURN b.k AS k") == [(1,), (2,)]
    assert told(weighted, "MATCH (a:A {k: 0})-[:R* {t: 'x'}]->(b:A) RETURN DISTINCT b.k AS k") == [(1,), (2,)]


def test_shortest_paths_from_both_sides(spark):
    """A tree that branches from the start, and a chain to the end: distances by hand, and fewer rows than from one side."""
    branch = [(0, 100 + i) for i in range(30)] + [(100 + i, 200 + 30 * i + j) for i in range(30) for j in range(30)]
    chain_ = [(i, i + 1) for i in range(8)]
    pairs = branch + chain_ + [(8, 0)]
    nodes = spark.range(1200).select(F.col("id").alias("_id"), F.col("id").alias("k"))
    g = GraphCatalog(nodes={"A": nodes}, edges={("A", "R", "A"): spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "_src long, _dst long, _eid long")})
    both, one = Compiler(spark, g), Compiler(spark, g)
    found = both.run("MATCH p = shortestPath((a:A {k: 0})-[:R*]->(b:A {k: 8})) RETURN a.k AS a, b.k AS b, length(p) AS n")
    assert [tuple(r) for r in found.collect()] == [(0, 8, 8)]
    assert "array" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    one.run("MATCH p = shortestPath((a:A {k: 0})-[:R*..8]->(b:A)) RETURN b.k AS b, length(p) AS n").collect()
    assert max(n for _, n in both.frontiers) <= 31 and max(n for _, n in one.frontiers) == 901
    told = lambda q: rows(spark, g, q)
    assert told("MATCH p = shortestPath((a:A)-[:R*]->(b:A)) WHERE a.k IN [0, 3] AND b.k IN [0, 3, 7] RETURN a.k AS a, b.k AS b, length(p) AS n") == [(0, 3, 3), (0, 7, 7), (3, 0, 6), (3, 7, 4)]
    assert told("MATCH p = shortestPath((a:A)-[:R*]-(b:A)) WHERE a.k IN [0, 3] AND b.k IN [0, 3, 7] RETURN a.k AS a, b.k AS b, length(p) AS n") == [(0, 3, 3), (0, 7, 2), (3, 0, 3), (3, 7, 4)]
    assert told("MATCH p = shortestPath((a:A {k: 0})-[:R*..7]->(b:A {k: 8})) RETURN length(p) AS n") == []
    assert told("MATCH p = shortestPath((a:A {k: 8})-[:R*]->(b:A {k: 1199})) RETURN length(p) AS n") == []


def test_percentiles_of_large_groups(spark):
    """Beside other aggregates, in expressions, over nulls and null groups, with values that most rows have."""
    rng = random.Random(4)
    people = [(i, ["a", "a", "a", "b", None][rng.randrange(5)], rng.choice([None, 7, 7, 7, rng.randrange(50)])) for i in range(800)] + [(900, "c", None)]
    g = GraphCatalog({"P": spark.createDataFrame(people, "_id long, g string, v int")}, {})
    q = "MATCH (p:P) RETURN p.g AS g, COUNT(*) AS n, SUM(p.v) AS s, round(percentileCont(p.v, 0.9) * 2, 6) AS c, percentileDisc(p.v, 0.25) AS d, percentileDisc(p.v, 0) AS low, percentileDisc(DISTINCT p.v, $q) AS mid"
    df = cypher(spark, g, q, {"q": 0.5})
    assert "percentile" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r["g"]: r for r in df.collect()}
    assert set(got) == {"a", "b", "c", None}
    for group, r in got.items():
        mine = [v for _, x, v in people if x == group]
        values = sorted(v for v in mine if v is not None)
        assert (r["n"], r["s"]) == (len(mine), sum(values))
        if not values:
            assert r["c"] is None and r["d"] is None and r["mid"] is None
            continue
        at = 0.9 * (len(values) - 1)
        low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
        single = sorted(set(values))
        assert r["c"] == pytest.approx(2 * (low + (high - low) * (at - int(at))), abs=1e-5)
        assert (r["d"], r["low"], r["mid"]) == (values[max(math.ceil(0.25 * len(values)) - 1, 0)], values[0], single[math.ceil(0.5 * len(single)) - 1])
    everyone = cypher(spark, g, "MATCH (p:P) WHERE p.v > 99 RETURN COUNT(p) AS n, percentileCont(p.v, 0.5) AS c").collect()
    assert [tuple(r) for r in everyone] == [(0, None)]
    with pytest.raises(CypherError):
        cypher(spark, g, "MATCH (p:P) RETURN percentileCont(p.v, 1.5) AS c")


def test_unbounded_rounds_read_written_edges(spark, tmp_path, monkeypatch):
    """The edges of an unbounded variable length are derived (here by a window) once, not in every round."""
    from datetime import datetime

    from graphloom.plans import catalog, compiler

    rows = [(i, datetime(2024, 1, 1 + i), i % 2, "purchase" if i == 1 else "view", 1.0, "{}") for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    derived, put = [], compiler.written
    monkeypatch.setattr(compiler, "written", lambda df, name="step": derived.append("Window" in df._jdf.queryExecution().optimizedPlan().toString()) or put(df, name))
    g = catalog.table_graph(spark, str(tmp_path))
    for query in ("MATCH (a:Event {eventId: 1})-[:NEXT*]->(b:Event) RETURN COUNT(b) AS n", "MATCH (a:Event {eventId: 1})-[:NEXT*]->(b:Event) RETURN COUNT(DISTINCT b) AS n"):
        derived.clear()
        assert compiler.cypher(spark, g, query).first()[0] == 5
        assert len(derived) > 5 and sum(derived) == 1


@pytest.mark.parametrize("condition", ["a.v < b.v - 7", "a.v - 7 >= b.v", "b.v - 7.5 > a.v AND a.v <= b.w", "a.v > b.v"])
def test_comparison_across_a_hub_is_narrowed_first(spark, condition, monkeypatch):
    """Neighbours of a node that are compared: the pairs of a plain loop, from the few rows of each side that can have a partner."""
    from graphloom.plans import compiler
    from graphloom.plans.catalog import GraphCatalog

    rows = [(i, i % 3, i % 11 if i % 13 else None, float(i % 5), "xy"[i % 2]) for i in range(120)]
    c = spark.createDataFrame(rows, "_id long, n long, v long, w double, k string")
    g = GraphCatalog({"C": c.drop("n"), "N": spark.range(3).select(F.col("id").alias("_id"))}, {("C", "IN", "N"): c.select(F.col("_id").alias("_src"), F.col("n").alias("_dst"), F.col("_id").alias("_eid"))})
    sides, put = [], compiler.Compiler.narrowed
    monkeypatch.setattr(compiler.Compiler, "narrowed", lambda *a: sides.append(put(*a)) or sides[-1])
    found = cypher(spark, g, f"MATCH (a:C {{k: 'x'}})-[:IN]->(n:N)<-[:IN]-(b:C {{k: 'y'}}) WHERE a <> b AND {condition} RETURN id(a) AS a, id(b) AS b")
    holds = {"a.v < b.v - 7": lambda a, b: a[2] < b[2] - 7, "a.v - 7 >= b.v": lambda a, b: a[2] - 7 >= b[2], "b.v - 7.5 > a.v AND a.v <= b.w": lambda a, b: b[2] - 7.5 > a[2] and a[2] <= b[3], "a.v > b.v": lambda a, b: a[2] > b[2]}[condition]
    want = [(a[0], b[0]) for a in rows for b in rows if a[4] == "x" and b[4] == "y" and a[1] == b[1] and a[2] is not None and b[2] is not None and holds(a, b)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and want
    if "7" in condition:
        assert all(side.count() < 40 for side in sides[0])
