"""Query-text operators over texts made from the rows of the customers, each with the SQL that must give the same rows.

A text's literals are the row's values, and its key decides which clauses it has.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query_text, values
from ..operators import refresh
from ..steps import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = "c_custkey"


def over_customers(name: str, kind: str, function: Callable, arguments: Callable[[], list[Column]], found: str) -> None:
    """Register a query that applies ``function`` to texts made from each customer; ``found`` is the SQL expression of its value."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        made = arguments()
        rows = spread(spark.read.parquet(f"{d}/customer.parquet"), K).select(K, *[a.alias(f"a{i}") for i, a in enumerate(made)])
        return rows.select(K, query_text.frame(function, kind, *[f"a{i}" for i in range(len(made))]).alias("found"))

    QUERIES[name] = query
    SQL[name] = f"SELECT {K}, {found} AS found FROM customer"


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def turn(*texts: str | Column) -> Column:
    """One of the texts, in turn by the key."""
    out = F.lit("")
    for i, t in enumerate(texts):
        out = F.when(F.col(K) % len(texts) == i, F.lit(t) if isinstance(t, str) else t).otherwise(out)
    return out


def turn_sql(*found: str) -> str:
    return f"CASE {K} % {len(found)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(found)) + " END"


NAME, SEGMENT = "c_name", "c_mktsegment"
NONE = "[]::VARCHAR[]"
SCHEMA = query_text.Schema({"Customer": {"name": "STRING"}, "Order": {"orderKey": "INTEGER"}, "Part": {"brand": "STRING"}}, {"PLACED": {}, "CONTAINS": {}}, {("Customer", "PLACED", "Order"): 1, ("Order", "CONTAINS", "Part"): 1}, {})

over_customers("q01_clauses", "array<string>", lambda t: [c.name for c in query_text.clauses(t)],
    lambda: [text("MATCH (c:Customer {segment: '", F.col(SEGMENT), "'})", F.when(F.col(K) % 2 == 0, " OPTIONAL MATCH (c)-[:PLACED]->(o)").otherwise(""), F.when(F.col(K) % 3 == 0, text(" WHERE c.name <> '", F.col(NAME), " RETURN'")).otherwise(""), " RETURN c.name AS n", F.when(F.col(K) % 5 == 0, text(" ORDER BY n SKIP 1 LIMIT ", F.col(K))).otherwise(""))],
    f"list_concat(list_concat(list_concat(['MATCH'], CASE WHEN {K} % 2 = 0 THEN ['OPTIONAL MATCH'] ELSE {NONE} END), CASE WHEN {K} % 3 = 0 THEN ['WHERE'] ELSE {NONE} END), CASE WHEN {K} % 5 = 0 THEN ['RETURN', 'ORDER BY', 'SKIP', 'LIMIT'] ELSE ['RETURN'] END)")

over_customers("q02_return_items", "array<string>", lambda t: [f"{e}|{a or ''}" for e, a in query_text.items_of(t, [c for c in query_text.clauses(t) if c.name == "RETURN"][-1])],
    lambda: [text("MATCH (c:Customer) RETURN DISTINCT c.name AS n", F.col(K), ", count(*) AS k, f(c, '", F.col(NAME), ", x')", turn("", ", c", text(", ", F.col(K), " AS `my ", F.col(SEGMENT), "`")))],
    f"list_concat(['c.name|n' || {K}, 'count(*)|k', 'f(c, ''' || c_name || ', x'')|'], {turn_sql(NONE, "['c|']", f"[{K} || '|my ' || c_mktsegment]")})")

over_customers("q06_question_constraints", "array<string>", lambda question, t: [c for _, c, _ in values.question_constraints(question, t)],
    lambda: [text("Who is '", F.col(NAME), "'?"), text("MATCH (c:Customer) WHERE c.name ", turn("= ", "CONTAINS ", "= "), "'", turn(F.col(NAME), F.col(NAME), text(F.col(NAME), "x")), "' RETURN c")],
    turn_sql(NONE, "['quoted_value_fuzzy_match']", "['quoted_value_not_literal']"))

over_customers("q11_category_contract", "string", lambda category, t: query_text.contract_problem(category, t) or "",
    lambda: [turn("ranking_topk", "ranking_topk", "negation_difference", "negation_difference", "simple_aggregation"), text("MATCH (c:Customer {segment: '", F.col(SEGMENT), "'}) ", turn(text("RETURN c.name ORDER BY c.name LIMIT ", F.col(K)), text("RETURN c.name LIMIT ", F.col(K)), text("WHERE NOT c.name = '", F.col(NAME), "' RETURN c"), "RETURN c", "RETURN c"))],
    turn_sql("''", "'ORDER BY and LIMIT are expected'", "''", "'NOT is expected'", "'an aggregate is expected'"))

over_customers("q12_scope", "array<string>", lambda t: query_text.dropped_variables(t) + query_text.unlisted_triples(t, SCHEMA),
    lambda: [text("MATCH (c:Customer {name: '", F.col(NAME), "'})-[:PLACED]->(o:Order) WITH ", turn("c", "c, o", "o"), " MATCH ", turn("(o)", "(o)", text("(c:Customer {name: '", F.col(NAME), "'})")), "-[:CONTAINS]->(p:Part) RETURN p")],
    turn_sql("['o']", NONE, "['c', '(Customer)-[CONTAINS]->(Part)']"))

over_customers("q15_rewrite_classes", "array<string>", values.rewrite_classes,
    lambda: [text("MATCH (c {name: '", F.col(NAME), "'}) RETURN c.name"), text("MATCH (c {name: '", F.col(NAME), "'}) ", turn(" RETURN c.name", "RETURN c.name", "RETURN DISTINCT c.name", "RETURN DISTINCT c.segment", "RETURN c.segment"))],
    turn_sql("['formatting_only']", "['unchanged']", "['return_distinct_inserted', 'return_distinct_only']", "['return_distinct_inserted']", "['other_normalization']"))

TIED = "'MATCH (c {segment: ''' || c_mktsegment || '''}) RETURN c.name ORDER BY n DESC"
over_customers("p14_tiebreak", "string", values.without_id_tiebreak,
    lambda: [text("MATCH (c {segment: '", F.col(SEGMENT), "'}) RETURN c.name ORDER BY n DESC, ", turn("c.custId ASC", "c.custId", "c.name"), " LIMIT ", F.col(K)), turn("Who has most?", "sorted by n then id", "Who has most?")],
    turn_sql(f"{TIED} LIMIT ' || {K}", f"{TIED}, c.custId LIMIT ' || {K}", f"{TIED}, c.name LIMIT ' || {K}"))

over_customers("x01_context_columns", "array<string>", lambda t, columns: values.answer_contract(t, columns.split(","), {"Customer": {"custId": ("segment",)}})["context_columns"],
    lambda: [text("MATCH (c:", turn("Customer", "Customer", "Person"), " {name: '", F.col(NAME), "'}) RETURN ", turn("c.custId AS id, ", "", "c.custId AS id, "), "c.segment AS segment"), turn("id,segment", "segment", "id,segment")],
    turn_sql("['segment']", NONE, NONE))

over_customers("f33_checklist", "boolean", lambda answer, n: query_text.checklist_passes(dict.fromkeys(query_text.CHECKLIST, "yes") | {"values": answer, "ranking": "na" if int(n) % 2 else "yes"}),
    lambda: [turn("yes", " YES ", "no", "maybe", "na"), text(F.col(K))],
    turn_sql("true", "true", "false", "false", "true"))

over_customers("f30_grounding", "array<string>", lambda t: [f"{m.entry.value}:{m.kind}" for m in values.ground(t, [values.Entry("Genre", "name", "Science Fiction", ("sci-fi",)), values.Entry("City", "name", "Berlin")])],
    lambda: [text("Number ", F.col(K), turn(" of science fiction", " of sci-fi", " in Berlin", " in Berlinn", " of nothing"))],
    turn_sql("['Science Fiction:exact']", "['Science Fiction:alias']", "['Berlin:exact']", "['Berlin:fuzzy']", NONE))

over_customers("q23_migration_rules", "boolean", lambda rule, value: refresh.migration_check(rule, float(value.split(",")[0]), {"before": 10, "removed": int(value.split(",")[1])}),
    lambda: [turn("positive", "zero", "nonnegative", "== before - removed"), text(turn(text(F.col("c_acctbal")), text(F.col("c_nationkey")), text(F.col("c_acctbal")), text(10 - F.col(K) % 7)), ",", F.col(K) % 5)],
    turn_sql("c_acctbal > 0", "c_nationkey = 0", "c_acctbal >= 0", f"{K} % 7 = {K} % 5"))

over_customers("q25_variants", "string", lambda base, variants: json.dumps(values.expand_variants(json.loads(base), json.loads(variants)), sort_keys=True),
    lambda: [text('{"g": {"k": ', F.col(K), ', "j": 2}, "h": "', F.col(SEGMENT), '"}'), text('{"a": {"g": {"k": ', F.col("c_nationkey"), '}}, "b": {}}')],
    f"""'{{"a": {{"g": {{"j": 2, "k": ' || c_nationkey || '}}, "h": "' || c_mktsegment || '"}}, "b": {{"g": {{"j": 2, "k": ' || {K} || '}}, "h": "' || c_mktsegment || '"}}}}'""")


def verdict(answer: str, name: str) -> list[str]:
    """The verdict on a reply with one answer given, or left out."""
    given = dict.fromkeys(query_text.CHECKLIST, True) | {"values": answer, "columns": {"verdict": "not_applicable", "evidence": name}}
    passed, failing, missing = query_text.checklist_verdict({"checklist": {c: a for c, a in given.items() if a != "absent"}})
    return [str(passed), *(f"failing {c}" for c in failing), *(f"missing {c}" for c in missing)]


def order_kept(t: str, balances: str) -> bool | None:
    """Whether an answer of two rows, in the order given, keeps the order that the query asks for; null if it asks for none."""
    rows = [{"x": float(b), "y": i} for i, b in enumerate(balances.split(","))]
    return values.order_consistent(t, sorted(rows, key=lambda r: r["x"], reverse="DESC" in t), rows, {"x": "x", "y": "y"})


over_customers("x19_checklist_verdict", "array<string>", verdict,
    lambda: [turn("yes", "no", "perhaps", "absent"), F.col(NAME)],
    turn_sql("['True']", "['False', 'failing values']", "['False', 'failing values']", "['False', 'missing values']"))

over_customers("t04_order_consistent", "boolean", order_kept,
    lambda: [turn("MATCH (c:Customer) RETURN c.x AS x, c.y AS y ORDER BY c.x DESC", "MATCH (c:Customer) RETURN c.x AS x, c.y AS y ORDER BY x", "MATCH (c:Customer) RETURN c.x AS x, c.y AS y"), text(F.col("c_acctbal"), ",", F.col("c_nationkey") * 100)],
    turn_sql("c_acctbal >= c_nationkey * 100", "c_acctbal <= c_nationkey * 100", "NULL::BOOLEAN"))

over_customers("q18_expected_changes", "array<string>", lambda expected, delta: refresh.expected_diff_problems([("rel:R", "removed"), ("rel:T", "added")], json.loads(expected), [("rel:R", "rel:T")], {"S": int(delta)}),
    lambda: [turn('{"counts": {"S": "increase"}, "removed": ["rel:R"]}', '{"removed": ["rel:R"], "added": ["rel:T"], "renames": [], "counts": {"S": "any"}}', '{"removed": ["rel:Q"]}'), text(F.col("c_nationkey") + 1 - 2 * (F.col(K) % 2) * (F.col("c_nationkey") + 1))],
    turn_sql(f"CASE WHEN {K} % 2 = 0 THEN {NONE} ELSE ['increase of S was not seen'] END", NONE, "['removed rel:Q is missing']"))
