"""Introspection, migrations, refresh and query-text operators as queries, with SQL where it can say the same."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literals, query_text
from ..operators import refresh
from ..sources import files
from .catalog import table_graph
from .compiler import cypher
from .dataset_queries import CYPHERS, cypher_texts, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("s01_node_load", "SELECT c_custkey AS _id, c_name AS name, c_acctbal AS bal FROM customer")
def _(spark, d):
    """Text columns, typed, upserted by key: each customer twice, the later row wins."""
    text = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("string").alias("bal"), F.lit("2").alias("version"))
    old = text.withColumn("name", F.lit("old")).withColumn("version", F.lit("1"))
    rows = files.typed(text.unionByName(old), {"bal": "FLOAT", "version": "INTEGER"})
    return files.load_nodes(rows, "key", ["version"]).select("_id", "name", "bal")


@query("s02_edge_load", "SELECT o_custkey AS _src, o_orderkey AS _dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, d):
    g = table_graph(spark, d)
    return files.load_edges(read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", g.nodes["Customer"].filter("acctBal > 0"), g.nodes["Order"]).select("_src", "_dst")


@query("s04_united_graphs", "SELECT 'a1_Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'a2_Nation', count(*) FROM nation UNION ALL SELECT 'b1_Nation', count(*) FROM nation UNION ALL SELECT 'b2_Nation', count(*) FROM nation")
def _(spark, d):
    g = table_graph(spark, d)
    few = g.changed({x: None for x in g.nodes if x != "Nation"}, {t: None for t in g.edges})
    return files.unite({"a": few, "b": few}, 2).all_nodes().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("s09_pattern_counts", "SELECT 'Nation' AS start_label, 'IN_REGION' AS type, 'Region' AS end_label, count(*) AS count FROM nation UNION ALL SELECT 'Customer', 'IN_NATION', 'Nation', count(*) FROM customer UNION ALL SELECT 'Supplier', 'IN_NATION', 'Nation', count(*) FROM supplier UNION ALL SELECT 'Customer', 'PLACED', 'Order', count(*) FROM orders UNION ALL SELECT 'Order', 'CONTAINS', 'Part', count(*) FROM lineitem UNION ALL SELECT 'Supplier', 'SUPPLIES', 'Part', count(*) FROM lineitem UNION ALL SELECT 'Order', 'FULFILLED_BY', 'Supplier', count(*) FROM lineitem UNION ALL SELECT 'User', 'DID', 'Event', count(*) FROM events UNION ALL SELECT 'Event', 'NEXT', 'Event', count(*) - count(DISTINCT user_id) FROM events UNION ALL SELECT 'Nation', 'TRADES_WITH', 'Nation', 40")
def _(spark, d):
    return table_graph(spark, d).pattern_counts()


@query("s09_properties", "SELECT * FROM (VALUES ('Customer', 'custKey', 'INTEGER'), ('Customer', 'name', 'STRING'), ('Customer', 'acctBal', 'FLOAT'), ('Customer', 'segment', 'STRING'), ('Event', 'eventId', 'INTEGER'), ('Event', 'ts', 'DATETIME'), ('Event', 'type', 'STRING'), ('Event', 'value', 'FLOAT'), ('Event', 'props', 'STRING'), ('Nation', 'nationKey', 'INTEGER'), ('Nation', 'name', 'STRING'), ('Order', 'orderKey', 'INTEGER'), ('Order', 'status', 'STRING'), ('Order', 'totalPrice', 'FLOAT'), ('Order', 'orderDate', 'DATETIME'), ('Order', 'priority', 'STRING'), ('Part', 'partKey', 'INTEGER'), ('Part', 'name', 'STRING'), ('Part', 'brand', 'STRING'), ('Part', 'type', 'STRING'), ('Part', 'size', 'INTEGER'), ('Part', 'retailPrice', 'FLOAT'), ('Region', 'regionKey', 'INTEGER'), ('Region', 'name', 'STRING'), ('Supplier', 'suppKey', 'INTEGER'), ('Supplier', 'name', 'STRING'), ('Supplier', 'acctBal', 'FLOAT'), ('User', 'userId', 'INTEGER')) t(label, property, type)")
def _(spark, d):
    return table_graph(spark, d).schema_nodes(spark)


@query("s10_categorical_domain", "SELECT DISTINCT p_type AS value FROM part")
def _(spark, d):
    return table_graph(spark, d).categorical_domain("Part", "type", 20)


@query("s11_content_digest", "WITH r AS (SELECT sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS h, substr(sha256('graphloom:' || n_nationkey), 1, 2) AS b FROM nation), s AS (SELECT b, count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT) AS s, bit_xor(('0x' || substr(h, 13, 12))::BIGINT) AS x FROM r GROUP BY 1) SELECT sha256(string_agg(b || ':' || n || ':' || s || ':' || x, chr(10) ORDER BY b || ':' || n || ':' || s || ':' || x)) AS digest FROM s")
def _(spark, d):
    return spark.createDataFrame([(files.content_digest(read(spark, d, "nation"), "n_nationkey"),)], "digest string")


@query("q03_read_only", "SELECT c_custkey, NOT (c_custkey % 3 = 1) AS read_only FROM customer")
def _(spark, d):
    text = F.when(F.col("c_custkey") % 3 == 0, "MATCH (n) RETURN n.created").when(F.col("c_custkey") % 3 == 1, "match (n) detach delete n").otherwise("MATCH (n:Asset) RETURN n.offset")
    return read(spark, d, "customer").select("c_custkey", query_text.read_only(text).alias("read_only"))


@query("q04_normalize", f"WITH {CYPHERS} SELECT id, replace(replace(cypher, '  ', ' '), 'RETURN', 'RETURN DISTINCT') AS normal FROM cy")
def _(spark, d):
    return cypher_texts(spark, d).select("id", query_text.frame(query_text.normalize, "string", "cypher").alias("normal"))


@query("q05_issues", f"WITH {CYPHERS} SELECT id, ['unknown_property', 'unknown_relationship'] AS codes FROM cy")
def _(spark, d):
    schema = files.schema_of(table_graph(spark, d))
    codes = lambda text: sorted({c for _, c, _ in query_text.issues(text.replace("p.name", "p.nickname"), schema)})
    return cypher_texts(spark, d).select("id", query_text.frame(codes, "array<string>", "cypher").alias("codes"))


@query("q07_features", f"WITH {CYPHERS} SELECT id, 1 AS hops, 2 AS arity, 'easy' AS difficulty, 'single_hop' AS strategy FROM cy")
def _(spark, d):
    def features(text: str) -> dict:
        f = query_text.features(text)
        return {"hops": f["relationship_pattern_count"], "arity": f["return_arity"], "difficulty": f["difficulty"], "strategy": f["primary_strategy"]}

    return cypher_texts(spark, d).select("id", query_text.frame(lambda t: json.dumps(features(t)), "string", "cypher").alias("j")).select("id", F.from_json("j", "hops int, arity int, difficulty string, strategy string").alias("f")).select("id", "f.*")


@query("q08_difficulty", f"WITH {CYPHERS} SELECT id, 9.0::DOUBLE AS score FROM cy")
def _(spark, d):
    return cypher_texts(spark, d).select("id", query_text.frame(lambda t: query_text.difficulty_score(query_text.difficulty_features(t)), "double", "cypher").alias("score"))


@query("q09_category", f"WITH {CYPHERS} SELECT id, 'simple_retrieval' AS category FROM cy")
def _(spark, d):
    return cypher_texts(spark, d).select("id", query_text.frame(query_text.coarse_category, "string", "cypher").alias("category"))


@query("q10_literal_problems", "SELECT p_partkey AS id, CASE WHEN p_size >= 2 AND abs(p_size - substr(p_brand, 7)::INT) > 1 THEN 1 ELSE 0 END AS problems FROM part")
def _(spark, d):
    rows = cypher_texts(spark, d).join(read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "id").withColumn("question", F.concat(F.lit("Which parts of brand "), "p_brand", F.lit(" are large?")))
    return rows.select("id", query_text.frame(lambda q, c: len(literals.literal_problems(q, c)), "int", "question", "cypher").alias("problems"))


@query("q14_empty_diagnosis", "SELECT '1:match' AS stage, count(*) AS n FROM part UNION ALL SELECT '2:where', 0")
def _(spark, d):
    """Counts of a query's prefixes, each compiled."""
    g = table_graph(spark, d)
    parts = [cypher(spark, g, q).select(F.lit(stage).alias("stage"), "n") for stage, q in query_text.prefix_counts("MATCH (p:Part) WHERE p.brand = 'Brand#99' RETURN p.name")]
    return parts[0].unionByName(parts[1])


@query("q13_slot_binding", "SELECT DISTINCT p_brand AS brand FROM part JOIN lineitem ON l_partkey = p_partkey")
def _(spark, d):
    found, _ = query_text.binding_queries("MATCH (o:Order)-[:CONTAINS]->(p:Part {brand: $brand}) RETURN COUNT(o) AS n", ["brand"], 1000)
    return cypher(spark, table_graph(spark, d), found[0][1])


@query("q16_atoms", f"WITH {CYPHERS} SELECT id, ['cat:Part.brand', 'label:Part', 'pattern:(:Part)-[:SOLD]->(:*)', 'prop:*.Price', 'prop:Part.brand', 'prop:Part.name', 'prop:Part.size', 'rel:SOLD'] AS atoms FROM cy")
def _(spark, d):
    return cypher_texts(spark, d).select("id", query_text.frame(lambda t: sorted(query_text.atoms(t)), "array<string>", "cypher").alias("atoms"))


@query("q17_schema_diff", "SELECT * FROM (VALUES ('rel:PLACED', 'removed'), ('rel:ORDERED', 'added'), ('pattern:(:Customer)-[:PLACED]->(:Order)', 'removed'), ('pattern:(:Customer)-[:ORDERED]->(:Order)', 'added'), ('relprop:PLACED.orderDate', 'removed'), ('relprop:ORDERED.orderDate', 'added'), ('prop:Part.retailPrice', 'removed'), ('prop:Part.price', 'added')) t(atom, change)")
def _(spark, d):
    g = table_graph(spark, d)
    new = refresh.rename_property(refresh.retype(g, "PLACED", "ORDERED"), "Part", "retailPrice", "price")
    frame = lambda c: spark.createDataFrame([(a,) for a in sorted(refresh.schema_atoms(files.schema_of(c)))], "atom string")
    return refresh.atom_diff(frame(g), frame(new))


@query("q19_rename_rewrite", f"WITH {CYPHERS} SELECT id, replace(replace(cypher, ':Part', ':Item'), 'p.size', 'p.extent') AS rewritten FROM cy")
def _(spark, d):
    return cypher_texts(spark, d).select("id", query_text.frame(lambda t: query_text.rename(t, {"label:Part": "label:Item", "prop:Part.size": "prop:Part.extent"}), "string", "cypher").alias("rewritten"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as benchmark items run before and after a migration."""
    k = F.col("o_orderkey")
    cls = refresh.refresh_class(k % 11 != 0, (k % 7 == 0).cast("int"), k % 5 != 0, k % 4, k % 3, k % 2 == 0)
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), cls.alias("class")).withColumn("action", refresh.refresh_action(F.col("class"), F.col("id") % 14 == 0))


OUTCOMES = "oc AS (SELECT o_orderkey AS id, o_orderpriority AS category, CASE WHEN o_orderkey % 11 = 0 THEN 'original_execution_error' WHEN o_orderkey % 7 = 0 THEN 'broken_schema' WHEN o_orderkey % 5 = 0 THEN 'execution_error' WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 = 0 THEN 'now_empty' WHEN o_orderkey % 2 <> 0 THEN 'silently_changed_answer' ELSE 'unchanged_answer' END AS class FROM orders), ac AS (SELECT *, CASE class WHEN 'unchanged_answer' THEN 'reuse' WHEN 'silently_changed_answer' THEN 'refresh_answer' WHEN 'now_empty' THEN 'regenerate' WHEN 'execution_error' THEN 'regenerate' WHEN 'broken_schema' THEN CASE WHEN id % 14 = 0 THEN 'rename_rewrite' ELSE 'regenerate' END ELSE 'exclude' END AS action FROM oc)"


@query("q20_refresh_class", f"WITH {OUTCOMES} SELECT id, class, action FROM ac")
def _(spark, d):
    return outcomes(spark, d).select("id", "class", "action")


@query("q21_refresh_plan", f"WITH {OUTCOMES} SELECT 'all' AS dimension, 'all' AS value, class, action, count(*) AS n FROM ac GROUP BY ALL UNION ALL SELECT 'category', category, class, action, count(*) FROM ac GROUP BY ALL")
def _(spark, d):
    return refresh.refresh_plan(outcomes(spark, d), "class", "action", ["category"])


@query("q22_retype", "SELECT c_mktsegment AS segment, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    g = refresh.retype(refresh.rename_property(table_graph(spark, d), "Customer", "segment", "branch"), "PLACED", "ORDERED")
    return cypher(spark, g, "MATCH (c:Customer)-[:ORDERED]->(o:Order) RETURN c.branch AS segment, COUNT(o) AS orders")


@query("q22_relabel_drop", "SELECT n_name AS nation, count(*) AS buyers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name")
def _(spark, d):
    g = refresh.drop_type(refresh.relabel(table_graph(spark, d), "Customer", "Buyer"), "TRADES_WITH")
    return cypher(spark, g, "MATCH (b:Buyer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, COUNT(b) AS buyers")


@query("q22_hash_delete", "SELECT count(*) AS \"left\" FROM orders WHERE ('0x' || substr(sha256('cut:' || o_custkey::VARCHAR || ':' || o_orderkey::VARCHAR || ':' || o_orderkey::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 >= 0.25")
def _(spark, d):
    g = refresh.delete_edges(table_graph(spark, d), ("Customer", "PLACED", "Order"), 0.25, "cut")
    return cypher(spark, g, "MATCH (c:Customer)-[p:PLACED]->(o:Order) RETURN COUNT(p) AS left")


@query("q22_insert", "SELECT count(*) + (SELECT count(*) FROM nation) AS n FROM customer")
def _(spark, d):
    g = table_graph(spark, d)
    new = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("_src"), F.col("n_nationkey").cast("long").alias("_dst"), (-F.col("n_nationkey") - 1).cast("long").alias("_eid"))
    return cypher(spark, refresh.insert_edges(g, ("Customer", "IN_NATION", "Nation"), new), "MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) RETURN COUNT(r) AS n")


@query("x02_external", "WITH r AS (SELECT o_orderkey AS i, CASE WHEN o_orderstatus = 'P' THEN 'other' ELSE 'tpch' END AS g, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 'Q' || (o_custkey % 700) || '?' END AS question, CASE WHEN o_orderkey % 40 = 1 THEN 'DROP x' ELSE 'MATCH  (c) RETURN ' || (o_orderkey % 3) END AS q FROM orders), k AS (SELECT *, CASE WHEN g <> 'tpch' THEN 'other_graph' WHEN question IS NULL THEN 'empty' WHEN q = 'DROP x' THEN 'not_read_only' END AS w FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY w, g, question, q ORDER BY i) AS rn FROM k) SELECT coalesce(w, CASE WHEN rn > 1 THEN 'duplicate' ELSE 'keep' END) AS decision, count(*) AS n FROM n GROUP BY 1")
def _(spark, d):
    from ..operators import benchmarks

    rows = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "other").otherwise("tpch").alias("g"), F.when(F.col("o_orderkey") % 50 != 0, F.concat(F.lit("Q"), (F.col("o_custkey") % 700).cast("string"), F.lit("?"))).alias("question"), F.when(F.col("o_orderkey") % 40 == 1, "DROP x").otherwise(F.concat(F.lit("MATCH  (c) RETURN "), (F.col("o_orderkey") % 3).cast("string"))).alias("q"))
    return benchmarks.convert_external(rows, "g", "question", "q", ["tpch"], ["o_orderkey"]).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("x05_diversity", "WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS v FROM documents), a AS (SELECT lang, 'source' AS dimension, source AS v FROM documents UNION ALL SELECT lang, 'token', v FROM t), c AS (SELECT lang, dimension, v, count(*) AS n FROM a GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY lang, dimension) AS p FROM c) SELECT lang, dimension, sum(n)::BIGINT AS total, count(*) AS \"unique\", round(sum(-p * log2(p)), 6) AS entropy_bits, round(1 - sum(p * p), 9) AS simpson FROM p GROUP BY lang, dimension")
def _(spark, d):
    from ..operators import benchmarks

    out = benchmarks.diversity_report(read(spark, d, "documents"), ["source"], "text", ["lang"])
    return out.select("lang", "dimension", "total", "unique", F.round("entropy_bits", 6).alias("entropy_bits"), F.round("simpson", 9).alias("simpson"))


@query("t11_model_summary", "WITH e AS (SELECT event_id % 10 AS model, user_id AS c, (value > 40)::INT AS y FROM events), s AS (SELECT model, c, sum(y) AS t, count(*) AS r FROM e GROUP BY ALL) SELECT model, sum(r)::BIGINT AS n, round(sum(t) / sum(r), 9) AS micro, round(avg(t / r), 9) AS macro, count(*) AS clusters, count(*) < 30 AS few_clusters FROM s GROUP BY 1")
def _(spark, d):
    from ..operators import benchmarks
    from .dataset_queries import evaluations

    out = benchmarks.model_summary(evaluations(spark, d), "model", "solved", "cluster")
    return out.select("model", "n", F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"), "clusters", "few_clusters")


@query("t11_rank_agreement", "WITH e AS (SELECT event_id % 10 AS m, event_type AS s, value AS v FROM events), w AS (SELECT m, avg(v) AS w FROM e GROUP BY 1), p AS (SELECT s, m, avg(v) AS p FROM e GROUP BY ALL) SELECT a.s AS category, count(*) AS pairs, avg((sign(round(a.p - b.p, 12)) = sign(round(wa.w - wb.w, 12)))::INT) AS agree FROM p a JOIN p b ON a.s = b.s AND a.m < b.m JOIN w wa ON wa.m = a.m JOIN w wb ON wb.m = b.m GROUP BY 1")
def _(spark, d):
    from ..operators import benchmarks
    from .dataset_queries import evaluations

    return benchmarks.rank_agreement(evaluations(spark, d), "model", "value", "category")


TEMPLATES = """WITH p(a, t, b) AS (VALUES ('Nation', 'IN_REGION', 'Region'), ('Customer', 'IN_NATION', 'Nation'), ('Supplier', 'IN_NATION', 'Nation'), ('Customer', 'PLACED', 'Order'), ('Order', 'CONTAINS', 'Part'), ('Supplier', 'SUPPLIES', 'Part'), ('Order', 'FULFILLED_BY', 'Supplier'), ('User', 'DID', 'Event'), ('Event', 'NEXT', 'Event'), ('Nation', 'TRADES_WITH', 'Nation')),
f(l, s) AS (VALUES ('Customer', 'acctBal'), ('Event', 'eventId'), ('Nation', 'name'), ('Order', 'orderDate'), ('Part', 'brand'), ('Region', 'name'), ('Supplier', 'acctBal'), ('User', 'userId')),
d AS (SELECT 'outgoing' AS side, a AS anchor, b AS other, '-[:' || t || ']->' AS pat FROM p UNION ALL SELECT 'incoming', b, a, '<-[:' || t || ']-' FROM p),
e AS (SELECT d.*, s, CASE WHEN scoped THEN '(a:' || anchor || ' {' || s || ': $value})' ELSE '(a:' || anchor || ')' END AS n, side || CASE WHEN scoped THEN '_scoped' ELSE '' END AS name FROM d JOIN f ON l = anchor, (VALUES (false), (true)) x(scoped)),
c AS (SELECT x.*, y.a AS ya, y.t AS yt, y.b AS yb, g.s AS sa, h.s AS sb FROM p x JOIN p y ON y.a = x.b OR y.b = x.b JOIN f g ON g.l = x.a JOIN f h ON h.l = x.b),
r AS (SELECT 'count_' || name AS kind, 'simple_aggregation' AS category, 'MATCH ' || n || pat || '(b:' || other || ') RETURN COUNT(DISTINCT b) AS n' AS cypher FROM e
UNION ALL SELECT 'topk_' || name, 'ranking_topk', 'MATCH ' || n || pat || '(b:' || other || ') WITH a, COUNT(DISTINCT b) AS n RETURN DISTINCT a.' || s || ' AS ' || s || ', n ORDER BY n DESC LIMIT 10' FROM e
UNION ALL SELECT 'negation_' || name, 'negation_difference', 'MATCH ' || n || ' WHERE NOT (a)' || pat || '(:' || other || ') RETURN DISTINCT a.' || s || ' AS ' || s || ' LIMIT 50' FROM e
UNION ALL SELECT 'negation_context_outgoing_scoped', 'negation_difference', 'MATCH (a:' || a || ' {' || sa || ': $value})-[:' || t || ']->(b:' || b || ') WHERE NOT (b)-[:' || yt || ']->(:' || yb || ') RETURN DISTINCT b.' || sb || ' AS ' || sb || ' LIMIT 50' FROM c WHERE ya = b
UNION ALL SELECT 'negation_context_incoming_scoped', 'negation_difference', 'MATCH (a:' || a || ' {' || sa || ': $value})-[:' || t || ']->(b:' || b || ') WHERE NOT (:' || ya || ')-[:' || yt || ']->(b) RETURN DISTINCT b.' || sb || ' AS ' || sb || ' LIMIT 50' FROM c WHERE yb = b AND (ya, yt) <> (a, t))
SELECT *, category AS derived FROM r"""


@query("q24_schema_templates", TEMPLATES)
def _(spark, d):
    """Every template derived from the catalog's schema, with its category as the text suggests it."""
    from ..functions import values

    g = table_graph(spark, d)
    schema = files.schema_of(g)
    rows = [(t["kind"], t["category"], t["cypher"], query_text.coarse_category(t["cypher"])) for t in values.schema_templates(schema.nodes, schema.patterns)]
    return spark.createDataFrame(rows, "kind string, category string, cypher string, derived string")


@query("q24_template_runs", "SELECT p_brand AS brand, count(DISTINCT l_orderkey) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_brand = 'Brand#11' GROUP BY 1")
def _(spark, d):
    """A scoped count template, bound and compiled."""
    q = "MATCH (a:Part {brand: $value})<-[:CONTAINS]-(b:Order) RETURN a.brand AS brand, COUNT(DISTINCT b) AS n"
    return cypher(spark, table_graph(spark, d), q, {"value": "Brand#11"})
