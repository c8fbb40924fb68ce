"""Query-text operators on tables of cases: each decision at least once, expected values worked out by hand.

The operators read one text at a time and no table, so their cases are rows of their own; the SQL lists the
expected values. ``graphloom.plans.text_queries`` runs the same operators over texts made from the tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import literals, query_text, values

QUERIES: dict = {}
SQL: dict[str, str] = {}


def sql_text(value) -> str:
    """A SQL literal of a text, number, boolean or list of texts."""
    if isinstance(value, list):
        return f"[{', '.join(map(sql_text, value))}]::VARCHAR[]"
    return str(value).upper() if isinstance(value, bool) else repr(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def cases(name: str, kind: str, function: Callable, rows: Sequence[tuple]) -> None:
    """A query that applies ``function`` to the arguments of each row (all but the last, texts) in Arrow batches; the last is the expected value."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        width = len(rows[0]) - 1
        df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], "case int, " + ", ".join(f"a{k} string" for k in range(width)))
        return df.select("case", query_text.frame(function, kind, *[f"a{k}" for k in range(width)]).alias("found"))

    cast = {"double": "::DOUBLE", "int": "::INT"}.get(kind, "")
    QUERIES[name] = query
    SQL[name] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {sql_text(r[-1])}{cast})" for i, r in enumerate(rows)) + ") t(\"case\", found)"


SCHEMA = query_text.Schema({"A": {"x": "INTEGER", "kind": "STRING"}, "B": {"y": "STRING"}}, {"R": {"w": "FLOAT"}}, {("A", "R", "B"): 3}, {"B.y": ("u", "v")})

cases("q09_category_cases", "string", query_text.coarse_category, [
    ("MATCH (p:Product) RETURN p.productName", "simple_retrieval"),
    ("MATCH (s:Supplier)-[:SUPPLIES]->(p:Product)-[:PART_OF]->(c:Category) RETURN s.companyName", "complex_retrieval"),
    ("MATCH (p:Product) RETURN count(*)", "simple_aggregation"),
    ("MATCH (p:Product)-[:PART_OF]->(c:Category) RETURN c.categoryName, avg(p.unitPrice)", "complex_aggregation"),
    ("MATCH (p:Product) WITH count(p) AS n RETURN n", "complex_aggregation"),
    ("MATCH (p:Product) RETURN p.productName ORDER BY p.unitPrice DESC LIMIT 5", "ranking_topk"),
    ("MATCH (c:Customer) WHERE NOT (c)-[:PURCHASED]->(:Order) RETURN c.companyName", "negation_difference"),
    ("MATCH (c:Customer) WHERE c.region IS NOT NULL RETURN c.companyName", "simple_retrieval"),
    ("MATCH (a:Person)-[:KNOWS*1..3]->(b:Person) RETURN b.name", "path_temporal"),
    ("MATCH (p:Product {productName: 'Chai'}) RETURN count(p) > 0 AS exists", "boolean_existence"),
    ("MATCH (p:Product) WHERE p.productName = 'NOT a filter' RETURN p", "simple_retrieval"),
    ("MATCH (a:A) MATCH (b:B) RETURN a, b", "complex_retrieval"),
    ("MATCH (a:A) OPTIONAL MATCH (a)-[:R]->(b) RETURN a, b", "complex_retrieval"),
    ("MATCH (a:A) RETURN sum(a.x), max(a.x)", "complex_aggregation"),
    ("MATCH (a:A)-[:R]->(b:B)-[:S]->(c:C) RETURN count(c)", "complex_aggregation"),
    ("MATCH p = shortestPath((a:A)-[:R*]-(b:A)) RETURN length(p)", "path_temporal"),
    ("MATCH (a:A) WHERE NONE(x IN a.tags WHERE x = 'q') RETURN a", "negation_difference"),
    ("MATCH (a:A) RETURN count(a) = 0 AS none", "boolean_existence"),
    ("MATCH (a:A) RETURN a.x IS NULL AS missing", "boolean_existence"),
    ("MATCH (a:A) RETURN EXISTS { (a)-[:R]->() } AS linked", "boolean_existence"),
    ("MATCH (a:A) RETURN a.x ORDER BY a.x", "simple_retrieval"),
    ("MATCH (a:A) RETURN a.x LIMIT 3", "simple_retrieval"),
    ("MATCH (a:A) WHERE a.x IS NOT NULL AND NOT a.x = 3 RETURN a", "negation_difference"),
])

cases("q05_issue_cases", "array<string>", lambda text: sorted({c for _, c, _ in query_text.issues(text, SCHEMA)}), [
    ("MATCH (a:A)-[r:R]->(b:B) RETURN a.x, r.w", []),
    ("MATCH (a:A)-[r:R]->(b:B {y: 'z'}) WHERE r.q > 1 RETURN a.k", ["invalid_categorical_value", "unknown_property", "unknown_relationship_property"]),
    ("MATCH (b:B)-[:R]->(a:A) RETURN a.x", ["wrong_direction"]),
    ("MATCH (b:B)-[:R]->(c:B) RETURN b.y", ["unseen_relationship_pattern"]),
    ("MATCH (a:A)--(b:B) RETURN a.x", ["missing_relationship_type"]),
    ("MATCH (a:A)-[:R]-(b:B) RETURN a.x", ["undirected_relationship"]),
    ("MATCH (a:A)<-[:R]->(b:B) RETURN a.x", ["bidirectional_relationship"]),
    ("MATCH (a:Z) RETURN a", ["unknown_label"]),
    ("MATCH (a:A)-[:Q]->(b:B) RETURN a.x", ["unknown_relationship"]),
    ("CREATE (n:A) RETURN n.x", ["not_read_only"]),
    ("MATCH (n) RETURN n", ["generic_node_scan"]),
    ("hello", ["syntax_shape"]),
    ("MATCH (a:A) WHERE a.kind IN ['p', 'q' RETURN a.x", ["unbalanced_brackets"]),
    ("MATCH (index:A) RETURN index.x", ["missing_return_distinct", "reserved_variable", "rewrite_skipped"]),
    ("MATCH (a:A) WHERE a.x > 1 WITH a MATCH (a)-[:R]->(b:B) WHERE b.y = 'u' RETURN b.y", ["missing_return_distinct", "rewrite_skipped"]),
    ("MATCH (a:A) RETURN DISTINCT CASE WHEN a.x > 1 THEN 1 ELSE 2 END AS c", ["rewrite_skipped"]),
    ("MATCH (a:A {k: 1}) RETURN a.x", ["unknown_property"]),
    ("MATCH (a:A)-[r:R {z: 1}]->(b:B) RETURN a.x", ["unknown_relationship_property"]),
    ("MATCH (b:B) WHERE b.y = 'other' RETURN b.y", ["invalid_categorical_value"]),
    ("MATCH (b:B) WHERE b.y = 'v' RETURN b.y", []),
])

cases("q10_literal_cases", "array<string>", lambda question, text: [code for code, _ in literals.literal_mismatches(question, text)], [
    ("Records named 'tag 12'?", "MATCH (s:T {id: 12}) RETURN s.id", ["quoted"]),
    ("Which {k} accounts?", "MATCH (a:A) RETURN a.x", ["placeholder"]),
    ("Which have most?", "MATCH (a:A) RETURN a.x ORDER BY a.x LIMIT 10", ["limit"]),
    ("Which have most?", "MATCH (a:A) RETURN a.x LIMIT 10", []),
    ("Which are above the threshold?", "MATCH (a:A) WHERE a.x > 10000 RETURN a.x", ["number"]),
    ("Who is reachable?", "MATCH (a:A)-[:R*1..3]->(b) RETURN b", ["hops"]),
    ("Who is within two hops?", "MATCH (a:A)-[:R*1..2]->(b) RETURN b", []),
    ("Which kinds?", "MATCH (a:A) WHERE a.kind IN ['red', 'blue'] RETURN a", ["text", "text"]),
    ("Which 5 did most after January 1, 2022?", "MATCH (a:A) WHERE a.t > datetime('2022-01-01T00:00:00') RETURN a.x ORDER BY a.x LIMIT 5", []),
    ("More than 3 of them?", "MATCH (a:A) WITH a, count(*) AS c WHERE c >= 4 RETURN a.x", []),
    ("Within 7 days?", "MATCH (a:A) WHERE a.t <= a.s + duration('P7D') RETURN a.x", []),
    ("Within a fortnight?", "MATCH (a:A) WHERE a.t <= a.s + duration('P14D') RETURN a.x", []),
    ("Half of it?", "MATCH (a:A) WHERE a.x > a.z / 20 RETURN collect({type: 'Thing'}) AS c", []),
    ("The top twenty?", "MATCH (a:A) RETURN a.x ORDER BY a.x LIMIT 20", []),
    ("The first of them?", "MATCH (a:A) RETURN a.x ORDER BY a.x LIMIT 2", ["limit"]),
    ("The second or the tenth?", "MATCH (a:A) WHERE a.x = 2 OR a.x = 10 RETURN a", []),
    ("A dozen, thirteen or nineteen?", "MATCH (a:A) WHERE a.x IN [12, 13, 19] RETURN a", []),
    ("Twenty-five, thirty, fifty, a hundred or a thousand?", "MATCH (a:A) WHERE a.x IN [25, 30, 50, 100, 1000] RETURN a", []),
    ("In percent?", "MATCH (a:A) WHERE a.x = 100 RETURN a", []),
    ("What happened in Mar 2012?", "MATCH (a:A) WHERE a.t >= date('2012-03-01') AND a.t < date('2012-04-01') RETURN a", []),
    ("What happened in 2012-03?", "MATCH (a:A) WHERE a.t >= date('2012-03-01') RETURN a", []),
    ("What happened in March?", "MATCH (a:A) WHERE a.t >= date('2012-03-01') RETURN a", ["text"]),
    ("On the 3rd of May, 2020?", "MATCH (a:A) WHERE a.t = date('2020-05-03') RETURN a", []),
    ("On the 3rd of May, 2020?", "MATCH (a:A) WHERE a.t = date('2020-05-04') RETURN a", ["text"]),
    ("In 2019?", "MATCH (a:A) WHERE a.t <= date('2019-12-31') AND a.t >= date('2019-01-01') AND a.s < date('2020-01-01') RETURN a", []),
    ("Of kind red-ish blue?", "MATCH (a:A {kind: 'red_ish'}) RETURN a", []),
    ("Which have id 8796093022282?", "MATCH (a:A {id: 8796093022282}) RETURN a", []),
    ("Which have it?", "MATCH (a:A {id: 8796093022282}) WHERE a.x > 1 RETURN a", []),
])

cases("q07_feature_cases", "string", lambda text: json.dumps({k: v for k, v in query_text.features(text).items() if v and k not in ("return_items", "labels", "relationship_types", "strategy_tags")}, sort_keys=True), [
    ("MATCH (a:A) RETURN a.x", '{"difficulty": "easy", "node_pattern_count": 1, "primary_strategy": "node_scan", "return_arity": 1}'),
    ("MATCH (a:A)-[:R]->(b:B) RETURN a.x, b.y", '{"difficulty": "easy", "node_pattern_count": 2, "primary_strategy": "single_hop", "relationship_pattern_count": 1, "return_arity": 2}'),
    ("MATCH (a:A)-[:R]->(b:B)-[:S]->(c:C) RETURN count(c) AS n", '{"aggregation": true, "difficulty": "medium", "node_pattern_count": 3, "primary_strategy": "aggregation", "relationship_pattern_count": 2, "return_arity": 1}'),
    ("MATCH (a:A)-[:R*1..2]->(b:B) WHERE NOT a.x = 1 RETURN b.y, count(a) AS n ORDER BY n SKIP 1 LIMIT 5", '{"aggregation": true, "difficulty": "hard", "limit": true, "negation": true, "node_pattern_count": 2, "ordering": true, "path_pattern": true, "primary_strategy": "path", "relationship_pattern_count": 1, "return_arity": 2, "skip": true}'),
    ("MATCH (a:A) OPTIONAL MATCH (a)-[:R]->(b:B) WHERE b.y <> 'u' RETURN a.x", '{"difficulty": "medium", "negation": true, "node_pattern_count": 3, "optional_match": true, "primary_strategy": "negation", "relationship_pattern_count": 1, "return_arity": 1}'),
    ("MATCH (a:A) RETURN a.x ORDER BY a.x", '{"difficulty": "easy", "node_pattern_count": 1, "ordering": true, "primary_strategy": "order_rank", "return_arity": 1}'),
])

# Weight times the capped count of each feature: arity 2, hops 2, variable length 2, grouping keys 1, negation 2, temporal 1, relationship properties 2, order 1, unwind 1, predicates 1, labels 1.
cases("q08_difficulty_cases", "double", lambda text: query_text.difficulty_score(query_text.difficulty_features(text)), [
    ("MATCH (a:A) RETURN a.x", 3.0),  # arity 1, one label
    ("MATCH (a:A)-[:R]->(b:B) RETURN a.x, b.y", 8.0),  # arity 2, one hop, two labels
    ("MATCH (a:A) WHERE a.x > 1 AND a.z = 2 RETURN a.x", 5.0),  # and two predicates
    ("MATCH (a:A) WHERE NOT a.x = 1 RETURN a.x", 6.0),  # one predicate, one negation
    ("MATCH (a:A) RETURN a.x ORDER BY a.x LIMIT 3", 4.0),
    ("MATCH (a:A)-[r:R {w: 1}]->(b:B) RETURN r.w", 9.0),  # one relationship property, one predicate
    ("MATCH (a:A)-[:R*1..2]->(b:B) RETURN b.y", 8.0),  # one variable length
    ("MATCH (a:A) RETURN a.kind, count(a) AS n", 6.0),  # one grouping key
    ("MATCH (a:A) UNWIND a.tags AS t RETURN collect(t) AS ts", 5.0),
    ("MATCH (a:A) WHERE a.birthDate > date('2020-01-01') RETURN a.x", 6.0),  # one predicate, a temporal property and a temporal call
])

cases("q16_atom_cases", "array<string>", lambda text: sorted(query_text.atoms(text)), [
    ("MATCH (a:A {x: 1})-[r:R {w: 2}]->(b:B) WHERE b.y = 'u' RETURN duration.between(a.x, b.y)", ["cat:B.y", "label:A", "label:B", "pattern:(:A)-[:R]->(:B)", "prop:A.x", "prop:B.y", "rel:R", "relprop:R.w"]),
    ("MATCH (a:A) RETURN a.x", ["label:A", "prop:A.x"]),
    ("MATCH (a:A)<-[:R]-(b) RETURN b.q", ["label:A", "pattern:(:*)-[:R]->(:A)", "prop:*.q", "rel:R"]),
    ("MATCH (a:A) WITH a AS c RETURN c.x", ["label:A", "prop:A.x"]),
])

cases("q01_clause_cases", "array<string>", lambda text: [c.name for c in query_text.clauses(text)], [
    ("MATCH (a:A) OPTIONAL MATCH (a)-[:R]->(b) WHERE b.x STARTS WITH 'q' WITH a ORDER BY a.x SKIP 1 LIMIT 2 RETURN a", ["MATCH", "OPTIONAL MATCH", "WHERE", "WITH", "ORDER BY", "SKIP", "LIMIT", "RETURN"]),
    ("UNWIND [1] AS x CALL { MATCH (n) RETURN n } RETURN x UNION MATCH (m) RETURN m.match AS x", ["UNWIND", "CALL", "RETURN", "UNION", "MATCH", "RETURN"]),
    ("MATCH (a {name: 'RETURN'}) RETURN a", ["MATCH", "RETURN"]),
    ("nothing", []),
])

cases("q02_return_items", "array<string>", lambda text: [f"{e}|{a or ''}" for e, a in query_text.items_of(text, [c for c in query_text.clauses(text) if c.name == "RETURN"][-1])], [
    ("MATCH (a) RETURN DISTINCT a.x AS x, count(*) AS n, f(a, b)", ["a.x|x", "count(*)|n", "f(a, b)|"]),
    ("MATCH (a) RETURN a, [x IN a.l | x] AS `my list`, 'a, b' AS t", ["a|", "[x IN a.l | x]|my list", "'a, b'|t"]),
])

cases("q06_constraint_cases", "array<string>", lambda question, text: [c for _, c, _ in values.question_constraints(question, text)], [
    ("Who is 'Bo'?", "MATCH (a) WHERE a.n CONTAINS 'Bo' RETURN a", ["quoted_value_fuzzy_match"]),
    ("Who is 'Bo'?", "MATCH (a) WHERE a.n = 'Bo' RETURN a", []),
    ("Who is \"Bo\"?", "MATCH (a) WHERE a.n = 'Bob' RETURN a", ["quoted_value_not_literal"]),
    ("Who is it?", "MATCH (a) RETURN a", []),
])

cases("q11_contract_cases", "string", lambda category, text: query_text.contract_problem(category, text) or "", [
    ("ranking_topk", "MATCH (a) RETURN a.x ORDER BY a.x LIMIT 3", ""),
    ("ranking_topk", "MATCH (a) RETURN a.x LIMIT 3", "ORDER BY and LIMIT are expected"),
    ("negation_difference", "MATCH (a) WHERE NOT a.x = 1 RETURN a", ""),
    ("negation_difference", "MATCH (a) RETURN a", "NOT is expected"),
    ("simple_aggregation", "MATCH (a) RETURN a", "an aggregate is expected"),
    ("complex_aggregation", "MATCH (a) RETURN a.x, count(a)", ""),
    ("simple_retrieval", "MATCH (a) RETURN a", ""),
])

cases("q12_scope_cases", "array<string>", lambda text: query_text.dropped_variables(text) + query_text.unlisted_triples(text, SCHEMA), [
    ("MATCH (a:A)-[:R]->(b) WITH a MATCH (b)-[:R]->(c) RETURN c", ["b"]),
    ("MATCH (a:A)-[:R]->(b:B) WITH a, b RETURN b", []),
    ("MATCH (b:B)-[:R]->(c:B) RETURN b", ["(B)-[R]->(B)"]),
    ("MATCH (b:B)<-[:R]-(a:A) RETURN b", []),
    ("MATCH (b:B)-[:R]-(a:A) RETURN b", []),
])

cases("q15_rewrite_cases", "array<string>", values.rewrite_classes, [
    ("RETURN  1", "RETURN 1", ["formatting_only"]),
    ("RETURN 1", "RETURN 1", ["unchanged"]),
    ("MATCH (a) RETURN a", "MATCH (a) RETURN DISTINCT a", ["return_distinct_inserted", "return_distinct_only"]),
    ("MATCH (a) RETURN a.x", "MATCH (a) RETURN DISTINCT a.y", ["return_distinct_inserted"]),
    ("MATCH (a) RETURN a.x", "MATCH (a) RETURN a.y", ["other_normalization"]),
])

cases("p14_tiebreak_cases", "string", values.without_id_tiebreak, [
    ("MATCH (a) RETURN a.x ORDER BY n DESC, a.userId ASC LIMIT 1", "Who has most?", "MATCH (a) RETURN a.x ORDER BY n DESC LIMIT 1"),
    ("MATCH (a) RETURN a.x ORDER BY n, a.id LIMIT 1", "sorted by n then id", "MATCH (a) RETURN a.x ORDER BY n, a.id LIMIT 1"),
    ("MATCH (a) RETURN a.x ORDER BY n, a.id LIMIT 1", "sorted by their identifier", "MATCH (a) RETURN a.x ORDER BY n, a.id LIMIT 1"),
    ("MATCH (a) RETURN a.x ORDER BY a.id LIMIT 1", "most?", "MATCH (a) RETURN a.x ORDER BY a.id LIMIT 1"),
    ("MATCH (a) RETURN a.x ORDER BY n, a.name LIMIT 1", "most?", "MATCH (a) RETURN a.x ORDER BY n, a.name LIMIT 1"),
])

POLICY = {"Account": {"accountId": ("kind",)}}
cases("x01_contract_cases", "array<string>", lambda text, columns: values.answer_contract(text, columns.split(","), POLICY)["context_columns"], [
    ("MATCH (a:Account) RETURN a.accountId AS id, a.kind AS kind, COUNT(*) AS n", "id,kind,n", ["kind"]),
    ("MATCH (a:Account) RETURN a.kind AS kind, COUNT(*) AS n", "kind,n", []),
    ("MATCH (a:Person) RETURN a.accountId AS id, a.kind AS kind", "id,kind", []),
])

GOOD = dict.fromkeys(query_text.CHECKLIST, "yes") | {"ranking": "na"}
cases("f33_checklist_cases", "boolean", lambda answers: query_text.checklist_passes(json.loads(answers)), [
    (json.dumps(GOOD), True),
    (json.dumps(GOOD | {"unambiguous": "na"}), False),
    (json.dumps(GOOD | {"values": "no"}), False),
    (json.dumps({k: v for k, v in GOOD.items() if k != "values"}), False),
    (json.dumps(GOOD | {"grouping": " YES "}), True),
    (json.dumps(GOOD | {"grouping": "maybe"}), False),
])

ENTRIES = [values.Entry("Genre", "name", "Science Fiction", ("sci-fi",)), values.Entry("City", "name", "Berlin"), values.Entry("City", "name", "Berlin Mitte"), values.Entry("Person", "fullName", "Ann Marie Lee")]
cases("f30_grounding_cases", "array<string>", lambda text: [f"{m.entry.value}:{m.kind}" for m in values.ground(text, ENTRIES)], [
    ("Which sci-fi films from Berlin Mitte and Berlinn?", ["Science Fiction:alias", "Berlin Mitte:exact", "Berlin:fuzzy"]),
    ("Films of science fiction", ["Science Fiction:exact"]),
    ("Two berlins and Berlin Mite", ["Berlin:plural", "Berlin Mitte:fuzzy"]),
    ("What did Ann L or A Lee or Lee say?", ["Ann Marie Lee:abbreviation", "Ann Marie Lee:abbreviation", "Ann Marie Lee:partial"]),
    ("Nothing here", []),
])

cases("q25_variant_cases", "string", lambda base, variants: json.dumps(values.expand_variants(json.loads(base), json.loads(variants)), sort_keys=True), [
    ('{"g": {"k": 1, "j": 2}}', '{"a": {"g": {"k": 5}}, "b": {}}', '{"a": {"g": {"j": 2, "k": 5}}, "b": {"g": {"j": 2, "k": 1}}}'),
    ('{"g": {"k": 1}, "h": 3}', '{"a": {"h": {"x": 1}}}', '{"a": {"g": {"k": 1}, "h": {"x": 1}}}'),
])


def migration_case(rule: str, value: str) -> bool:
    from graphloom.operators.refresh import migration_check

    return migration_check(rule, float(value), {"before": 10, "removed": 4})


cases("q23_migration_cases", "boolean", migration_case, [
    ("positive", "3", True), ("positive", "0", False), ("zero", "0", True), ("zero", "1", False), ("nonnegative", "0", True), ("nonnegative", "-1", False), ("== before - removed", "6", True), ("== before - removed", "7", False), ("== 2 * removed", "8", True),
])


def order_case(text: str, predicted: str) -> bool:
    rows = [{"x": 3, "y": 1}, {"x": 3, "y": 2}, {"x": 1, "y": 0}]
    return values.order_consistent(text, rows, json.loads(predicted), {"x": "x", "y": "y"})


cases("t04_order_cases", "boolean", order_case, [
    ("MATCH (a:A) RETURN a.x AS x, a.y AS y ORDER BY a.x DESC", '[{"x": 3, "y": 2}, {"x": 3, "y": 1}, {"x": 1, "y": 0}]', True),
    ("MATCH (a:A) RETURN a.x AS x, a.y AS y ORDER BY a.x DESC", '[{"x": 1, "y": 0}, {"x": 3, "y": 2}, {"x": 3, "y": 1}]', False),
    ("MATCH (a:A) RETURN a.x AS x, a.y AS y ORDER BY x DESC, y", '[{"x": 3, "y": 2}, {"x": 3, "y": 1}, {"x": 1, "y": 0}]', False),
])


def slice_case(text: str) -> list[str]:
    from graphloom.operators.refresh import schema_atoms

    wide = query_text.Schema(SCHEMA.nodes | {"C": {"name": "STRING", "z": "STRING"}}, SCHEMA.rels | {"S": {}}, dict(SCHEMA.patterns) | {("B", "S", "C"): 1}, SCHEMA.domains)
    return sorted(schema_atoms(query_text.schema_slice(wide, text)))


cases("q24_slice_cases", "array<string>", slice_case, [
    ("MATCH (a:A)-[:R]->(b:B) RETURN a.x", ["cat:B.y=u", "cat:B.y=v", "label:A", "label:B", "pattern:(:A)-[:R]->(:B)", "prop:A.x", "prop:B.y", "rel:R", "relprop:R.w"]),
    ("MATCH (c:C) WHERE c.z = 'q' RETURN c.z", ["cat:B.y=u", "cat:B.y=v", "label:B", "label:C", "pattern:(:B)-[:S]->(:C)", "prop:B.y", "prop:C.name", "prop:C.z", "rel:S"]),
    ("MATCH (q:Q) RETURN q", ["cat:B.y=u", "cat:B.y=v", "label:A", "label:B", "label:C", "pattern:(:A)-[:R]->(:B)", "pattern:(:B)-[:S]->(:C)", "prop:A.kind", "prop:A.x", "prop:B.y", "prop:C.name", "prop:C.z", "rel:R", "rel:S", "relprop:R.w"]),
])

cases("q06_context_cases", "array<string>", lambda text: [f"{label}.{p}: {', '.join(m)}" for label, p, m in query_text.missing_context(text, {"Account": {"accountId": ("kind", "nick")}})], [
    ("MATCH (a:Account) RETURN a.accountId", ["Account.accountId: kind, nick"]),
    ("MATCH (a:Account) RETURN a.accountId AS id, a.kind", ["Account.accountId: nick"]),
    ("MATCH (a:Account) RETURN a.accountId, a.kind, a.nick", []),
    ("MATCH (a:Account) RETURN a, a.accountId", []),
    ("MATCH (a:Account) RETURN a.kind", []),
    ("MATCH (p:Person) RETURN p.accountId", []),
])


def expected_case(expected: str) -> list[str]:
    from graphloom.operators.refresh import expected_diff_problems

    changes = [("rel:R", "removed"), ("rel:T", "added"), ("prop:A.x", "removed")]
    return expected_diff_problems(changes, json.loads(expected), [("rel:R", "rel:T")], {"S": -4})


cases("q18_expected_cases", "array<string>", expected_case, [
    ('{"removed": ["rel:R"], "added": ["rel:T"], "renames": [], "retained": ["rel:S"], "counts": {"S": "decrease"}}', []),
    ('{"removed": ["rel:Q"], "retained": ["prop:A.x"]}', ["removed rel:Q is missing", "prop:A.x should have stayed"]),
    ('{"counts": {"S": "increase", "U": "any"}, "more": 1}', ["unknown key more", "increase of S was not seen", "any of U was not seen"]),
    ('{"renames": [["rel:R", "rel:Z"]], "unchanged": true}', ["rename rel:R to rel:Z was not found", "no change was expected"]),
    ("{}", []),
])


def verdict_case(reply: str) -> list[str]:
    passed, failing, missing = query_text.checklist_verdict(json.loads(reply))
    return [str(passed), *(f"failing {c}" for c in failing), *(f"missing {c}" for c in missing)]


cases("x19_verdict_cases", "array<string>", verdict_case, [
    (json.dumps({"criteria": {c: {"answer": "Yes", "evidence": "e"} for c in query_text.CHECKLIST}}), ["True"]),
    (json.dumps({"checklist": dict.fromkeys(query_text.CHECKLIST, True) | {"ranking": "N/A", "columns": {"verdict": "not_applicable"}}}), ["True"]),
    (json.dumps(GOOD | {"unambiguous": "n.a."}), ["False", "failing unambiguous"]),
    (json.dumps(GOOD | {"values": False, "grouping": "perhaps"}), ["False", "failing values", "failing grouping"]),
    (json.dumps({k: v for k, v in GOOD.items() if k not in ("values", "columns")}), ["False", "missing values", "missing columns"]),
    ("{}", ["False", *(f"missing {c}" for c in query_text.CHECKLIST)]),
])
