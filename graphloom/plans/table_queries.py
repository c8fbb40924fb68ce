"""Further operators as queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy, query_text, text, values
from ..operators import joins, resampling, selection, statistics, summaries
from ..sources import files
from ..steps import shared_dir
from .catalog import table_graph
from .compiler import cypher
from .dataset_queries import CYPHERS, EVALS, GATES, ITEMS, PAIRS, bucket_sql, cypher_texts, draws_sql, evaluations, gate_rows, items, pairs, poisson_sql, read, unit_boot_sql, word_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/graphloom/files-{uuid.uuid4().hex}"


# -- sources and sinks


@query("s03_typed_columns", "SELECT p_partkey, [p_type, p_brand] AS tags, p_size::BIGINT AS size, NULL::BIGINT AS wrong FROM part WHERE p_size < 20")
def _(spark, d):
    p = read(spark, d, "part").filter("p_size < 20")
    raw = p.select("p_partkey", F.concat_ws(";", "p_type", "p_brand").alias("tags"), F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("wrong"))
    return files.typed(raw, {"tags": "STRINGARRAY", "size": "INTEGER", "wrong": "INTEGER"})


NATIONS = "n_nationkey INT, n_name STRING, n_regionkey INT"


@query("s05_json_lines", "SELECT n_nationkey::INT AS n_nationkey, n_name, n_regionkey::INT AS n_regionkey FROM nation")
def _(spark, d):
    """Appended in two writes, read by a schema together with a path that isn't there."""
    at, rows = place(spark), read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    files.append_lines(rows.filter("n_regionkey < 2"), at)
    files.append_lines(rows.filter("n_regionkey >= 2"), at)
    return files.read_lines(spark, [at, f"{at}-missing"], NATIONS)


@query("s06_runs", "SELECT CASE WHEN n_regionkey < 2 THEN 'first' ELSE 'second' END AS run, n_name, true AS has_path FROM nation")
def _(spark, d):
    rows, paths = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), {"first": place(spark), "second": place(spark)}
    files.append_lines(rows.filter("n_regionkey < 2"), paths["first"])
    files.append_lines(rows.filter("n_regionkey >= 2"), paths["second"])
    return files.read_runs(spark, paths, NATIONS).select(F.col("_source_run").alias("run"), "n_name", F.col("_source_records_path").contains("files-").alias("has_path"))


@query("s12_package", f"WITH {ITEMS} SELECT 'all' AS slice, count(*) AS n, sum(id)::BIGINT AS ids FROM items UNION ALL SELECT 'P', count(*), sum(id)::BIGINT FROM items WHERE graph = 'P' UNION ALL SELECT 'manifest', count(*), count(DISTINCT graph) FROM items")
def _(spark, d):
    """A package written, its manifest, and two slices read again."""
    at, rows = place(spark), items(spark, d).select("id", "graph", "category")
    manifest = files.write_package(rows, at, split="graph")
    schema = "id LONG, graph STRING, category STRING"
    total = lambda df, name: df.agg(F.lit(name).alias("slice"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    found = spark.createDataFrame([("manifest", manifest["rows"], len(manifest["splits"]))], "slice string, n long, ids long")
    return total(files.read_package(spark, at, schema), "all").unionByName(total(files.read_package(spark, at, schema, "P", "graph"), "P")).unionByName(found)


#: The properties of the catalog over the driver's tables.
PROPERTIES = "('Customer', 'custKey', 'INTEGER'), ('Customer', 'name', 'STRING'), ('Customer', 'acctBal', 'FLOAT'), ('Customer', 'segment', 'STRING'), ('Event', 'eventId', 'INTEGER'), ('Event', 'ts', 'DATETIME'), ('Event', 'type', 'STRING'), ('Event', 'value', 'FLOAT'), ('Event', 'props', 'STRING'), ('Nation', 'nationKey', 'INTEGER'), ('Nation', 'name', 'STRING'), ('Order', 'orderKey', 'INTEGER'), ('Order', 'status', 'STRING'), ('Order', 'totalPrice', 'FLOAT'), ('Order', 'orderDate', 'DATETIME'), ('Order', 'priority', 'STRING'), ('Part', 'partKey', 'INTEGER'), ('Part', 'name', 'STRING'), ('Part', 'brand', 'STRING'), ('Part', 'type', 'STRING'), ('Part', 'size', 'INTEGER'), ('Part', 'retailPrice', 'FLOAT'), ('Region', 'regionKey', 'INTEGER'), ('Region', 'name', 'STRING'), ('Supplier', 'suppKey', 'INTEGER'), ('Supplier', 'name', 'STRING'), ('Supplier', 'acctBal', 'FLOAT'), ('User', 'userId', 'INTEGER')"


@query("s13_schema_round_trip", f"SELECT label, property FROM (VALUES {PROPERTIES}) t(label, property, type)")
def _(spark, d):
    """The catalog's schema through JSON."""
    schema = files.schema_from_json(files.schema_json(files.schema_of(table_graph(spark, d))))
    return spark.createDataFrame([(label, p) for label, ps in schema.nodes.items() for p in ps], "label string, property string")


@query("s14_checksums", "SELECT octet_length(encode(n_name)) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation")
def _(spark, d):
    """One file for each nation, its length and digest."""
    at = place(spark)
    read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(at)
    return files.checksums(spark, at).filter(F.col("path").contains("part-")).select("bytes", "sha256")


# -- graph results


@query("g20_whole_nodes", "SELECT n_nationkey AS key, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(spark, d):
    """Whole nodes are returned and then expanded."""
    rows = cypher(spark, table_graph(spark, d), "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n, r")
    return rows.select(F.col("n.nationKey").alias("key"), F.col("n.name").alias("name"), F.col("r.name").alias("region"))


URGENT = "SELECT c_custkey AS k, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1"


@query("p09_nulls_first_down", f"SELECT k, m FROM ({URGENT}) ORDER BY m DESC NULLS FIRST, k LIMIT 40")
def _(spark, d):
    return cypher(spark, table_graph(spark, d), "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {priority: '1-URGENT'}) WITH c, max(o.totalPrice) AS m RETURN c.custKey AS k, m ORDER BY m DESC, k LIMIT 40")


@query("p09_nulls_last_up", f"SELECT k, m FROM ({URGENT}) ORDER BY m NULLS LAST, k DESC LIMIT 40")
def _(spark, d):
    return cypher(spark, table_graph(spark, d), "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {priority: '1-URGENT'}) WITH c, max(o.totalPrice) AS m RETURN c.custKey AS k, m ORDER BY m, k DESC LIMIT 40")


@query("g09_unbounded", "WITH RECURSIVE n AS MATERIALIZED (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_type FROM events), s AS (SELECT min(event_id) AS a FROM events WHERE event_type = 'purchase'), p(b) AS (SELECT n.b FROM n JOIN s ON n.a = s.a WHERE n.b IS NOT NULL UNION ALL SELECT n.b FROM p JOIN n ON n.a = p.b WHERE n.b IS NOT NULL) SELECT count(*) AS reached FROM p")
def _(spark, d):
    """All that follows one event, however many hops away."""
    first = read(spark, d, "events").filter("event_type = 'purchase'").agg(F.min("event_id")).first()[0]
    return cypher(spark, table_graph(spark, d), "MATCH (a:Event {eventId: $id})-[:NEXT*]->(b:Event) RETURN COUNT(b) AS reached", {"id": int(first)})


# -- allocation and joins


@query("w12_allocation", f"WITH {ITEMS}, c AS (SELECT category, count(*) AS n FROM items GROUP BY 1), e AS (SELECT *, n / sum(n) OVER () * 103 AS x FROM c), f AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY floor(x) - x, category) AS r, 103 - sum(floor(x)) OVER () AS rest FROM e) SELECT category, (f + (r <= rest)::INT)::BIGINT AS quota FROM f")
def _(spark, d):
    counts = {r[0]: r[1] for r in items(spark, d).groupBy("category").count().collect()}
    return spark.createDataFrame(sorted(selection.allocate(counts, 103).items()), "category string, quota long")


@query("w13_boosted_allocation", f"WITH {ITEMS}, c AS (SELECT category, count(*) AS n, count(*) * CASE WHEN category = '1-URGENT' THEN 3.0 ELSE 1.0 END AS w FROM items GROUP BY 1), e AS (SELECT *, (107 - 5 * 4) * w / sum(w) OVER () AS x FROM c), f AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY floor(x) - x, category) AS r, 87 - sum(floor(x)) OVER () AS rest FROM e) SELECT category, (4 + f + (r <= rest)::INT)::BIGINT AS quota FROM f")
def _(spark, d):
    counts = {r[0]: r[1] for r in items(spark, d).groupBy("category").count().collect()}
    return spark.createDataFrame(sorted(selection.allocate(counts, 107, floor=4, boost={"1-URGENT": 3.0}).items()), "category string, quota long")


@query("j08_focus_reasons", "WITH r AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'P') AS solved FROM orders GROUP BY 1), v AS (SELECT o_custkey AS id, count(DISTINCT o_totalprice > 150000) AS ways FROM orders WHERE o_orderpriority < '3' GROUP BY 1) SELECT c_custkey AS id, list_filter([CASE WHEN solved = 0 THEN 'unsolved' END, CASE WHEN ways > 1 THEN 'disagreement' END, CASE WHEN ways IS NULL THEN 'unjudged' END], lambda x: x IS NOT NULL) AS reasons FROM customer LEFT JOIN r ON r.id = c_custkey LEFT JOIN v ON v.id = c_custkey")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") > 150000).alias("passed"), "o_orderstatus", "o_orderpriority")
    rates = o.groupBy("id").agg(F.count_if(F.col("o_orderstatus") == "P").alias("solved"))
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return joins.focus_reasons(people, rates, o.filter("o_orderpriority < '3'"), "id", "passed").select("id", "reasons")


@query("j05_few_shot_random", "WITH n AS (SELECT n_nationkey AS id, n_regionkey AS g, n_nationkey % 2 AS c FROM nation), r AS (SELECT *, row_number() OVER (PARTITION BY g, c ORDER BY sha256('graphloom:' || id::VARCHAR)) AS at, count(*) OVER (PARTITION BY g, c) AS n FROM n), s AS (SELECT DISTINCT g, c, n FROM r), w AS (SELECT a.id, a.c AS own, s.g, s.c, s.n, floor(('0x' || substr(sha256('graphloom:' || a.id::VARCHAR || ':' || s.c::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 * s.n)::INT AS start FROM n a JOIN s USING (g)), x AS (SELECT *, unnest(range(0, least(2, n - 1) + 1)) AS step FROM w), p AS (SELECT x.id, x.own, x.c, x.step, r.id AS shot FROM x JOIN r ON r.g = x.g AND r.c = x.c AND r.at = (x.start + x.step) % x.n + 1 WHERE r.id <> x.id) SELECT id, shot, rank::INT AS rank FROM (SELECT id, shot, row_number() OVER (PARTITION BY id ORDER BY (own <> c)::INT, step, c) AS rank FROM p) WHERE rank <= 2")
def _(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("g"), (F.col("n_nationkey") % 2).alias("c"))
    return joins.few_shot(n, n, "g", "c", 2, mode="random")


@query("j05_few_shot_scored", f"""WITH {PAIRS}, t AS (SELECT id, id % 3 AS g, p AS t, (id % 2)::VARCHAR AS sig FROM pr), b AS (SELECT id, g, w, count(*) AS n FROM (SELECT id, g, unnest(t) AS w FROM t) GROUP BY ALL), m AS (SELECT id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1),
s AS (SELECT x.id, y.id AS shot, round(sum(x.n * y.n) / (any_value(mx.norm) * any_value(my.norm)), 9)::DOUBLE AS similarity FROM b x JOIN b y ON x.g = y.g AND x.w = y.w AND x.id <> y.id JOIN m mx ON mx.id = x.id JOIN m my ON my.id = y.id GROUP BY ALL),
f AS (SELECT a.id, c.id AS shot, coalesce(similarity, 0)::DOUBLE AS similarity, a.sig = c.sig AS signature_match FROM t a JOIN t c ON a.g = c.g AND a.id <> c.id LEFT JOIN s ON s.id = a.id AND s.shot = c.id WHERE coalesce(similarity, 0) < 0.9 AND a.sig <> c.sig)
SELECT id, shot, similarity, signature_match, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, shot) AS rank FROM f) WHERE rank <= 2""")
def _(spark, d):
    rows = pairs(spark, d).select("id", (F.col("id") % 3).alias("g"), F.col("p").alias("t"), (F.col("id") % 2).cast("string").alias("sig"))
    return joins.scored_shots(rows, rows, "g", "t", "sig", 2, exclude_match=True)


SHOTS = "sh AS (SELECT c_custkey AS id, [(c_custkey % 7) / 7, (c_custkey % 11) / 11] AS sims, [c_custkey % 3 = 0, c_custkey % 5 = 0] AS matches FROM customer)"


@query("x09_few_shot_leakage", f"WITH {SHOTS} SELECT id, 2 AS shots, list_bool_or(matches) AS signature_match, len(list_filter(sims, lambda x: x >= 0.8)) > 0 AS high_similarity FROM sh")
def _(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k.alias("id"), F.array((k % 7) / 7, (k % 11) / 11).alias("sims"), F.array(k % 3 == 0, k % 5 == 0).alias("matches"))
    return joins.few_shot_leakage(rows, "id", "sims", "matches", 0.8)


@query("x10_shot_metadata", "SELECT c_custkey AS id, rank::INT AS rank, c_custkey + rank AS shot, (c_custkey % 7) / 7 / rank AS similarity, rank = 1 AS signature_match FROM customer, (SELECT unnest([1, 2]) AS rank)")
def _(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k.alias("id"), F.array(k + 1, k + 2).alias("shots"), F.array((k % 7) / 7, (k % 7) / 7 / 2).alias("sims"), F.array("c_name", F.lit("other")).alias("sigs"), F.col("c_name").alias("own"))
    return joins.shot_metadata(rows, "id", "shots", "sims", "sigs", "own")


@query("x11_resolve", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment WHEN o_orderkey % 3 = 1 AND o_custkey % 2 = 0 THEN c_mktsegment END AS segment, CASE WHEN o_orderkey % 3 = 0 THEN 'key' WHEN o_orderkey % 3 = 1 AND o_custkey % 2 = 0 THEN 'name' ELSE 'none' END AS resolved_by FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, d):
    """By key where the order has one, else by name where the customer's is known."""
    c = read(spark, d, "customer")
    known = c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"))
    o = read(spark, d, "orders").join(c.select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("key"), F.when(F.col("o_orderkey") % 3 == 1, F.col("c_name")).alias("name"))
    return joins.resolve(rows, known, ["key", "name"], "segment").select("o_orderkey", "segment", "resolved_by")


@query("x18_threshold_verdict", "SELECT event_id, coalesce((value % 1) <= 0.35 AND (value / 100) >= 0.75 AND (event_id % 10) / 10 >= 0.75, false) AS passed FROM events")
def _(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.coalesce(statistics.threshold_verdict(F.col("value") % 1, F.col("value") / 100, (F.col("event_id") % 10) / 10), F.lit(False)).alias("passed"))


# -- texts and values


@query("f20_diversity_index", "SELECT l_orderkey, l_linenumber, round(exp((ln(least(1, greatest(1e-6, l_quantity / 50.0))) + ln(least(1, greatest(1e-6, l_discount * 10))) + ln(least(1, greatest(1e-6, l_tax * 10)))) / 3), 9)::DOUBLE AS diversity FROM lineitem")
def _(spark, d):
    parts = F.array(*[x.cast("double") for x in (F.col("l_quantity") / 50.0, F.col("l_discount") * 10, F.col("l_tax") * 10)])
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(text.diversity_index(parts), 9).alias("diversity"))


@query("f22_template_family", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'schema:count' WHEN 1 THEN 'template:orders of slot with number' ELSE 'query:match (<var>:a) where <var>.x = <num> return <var>.x' END AS family, CASE WHEN c_custkey % 5 = 0 THEN '0' WHEN c_custkey % 5 >= 3 THEN '3+' ELSE (c_custkey % 5)::VARCHAR END AS bucket FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    template = F.when(k % 3 == 1, F.concat(F.lit("Orders of {name} with "), k.cast("string")))
    family = text.template_family(F.when(k % 3 == 0, "count"), template, F.concat(F.lit("MATCH (a:A) WHERE a.x = "), k.cast("string"), F.lit(" RETURN a.x")))
    return read(spark, d, "customer").select("c_custkey", family.alias("family"), text.bucket(k % 5).alias("bucket"))


@query("f25_canonical_values", "SELECT n_nationkey, '[' || n_nationkey || ',' || n_regionkey || '.5]' AS canonical, '{\"a\":' || n_nationkey || ',\"b\":\"' || n_name || '\"}' AS of_map FROM nation WHERE n_nationkey > 4 AND n_nationkey < 10 AND n_regionkey < 4 AND n_nationkey::VARCHAR < n_regionkey || '.5' UNION ALL SELECT n_nationkey, '[' || n_regionkey || '.5,' || n_nationkey || ']', '{\"a\":' || n_nationkey || ',\"b\":\"' || n_name || '\"}' FROM nation WHERE n_nationkey > 4 AND n_nationkey < 10 AND n_regionkey < 4 AND n_nationkey::VARCHAR >= n_regionkey || '.5'")
def _(spark, d):
    """3 and 3.0 are equal, lists are sorted, maps have sorted keys."""
    n = read(spark, d, "nation").filter("n_nationkey > 4 AND n_nationkey < 10 AND n_regionkey < 4")
    listed = query_text.frame(lambda s: values.canonical_value([float(x) for x in json.loads(s)]), "string", "list")
    mapped = query_text.frame(lambda s: values.canonical_value(json.loads(s)), "string", "map")
    rows = n.select("n_nationkey", F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(".0,"), F.col("n_regionkey").cast("string"), F.lit(".5]")).alias("list"), F.to_json(F.struct(F.col("n_name").alias("b"), F.col("n_nationkey").alias("a"))).alias("map"))
    return rows.select("n_nationkey", listed.alias("canonical"), mapped.alias("of_map"))


@query("f26_mask_literals", f"WITH {CYPHERS} SELECT id, replace(cypher, regexp_extract(cypher, '''([^'']*)''', 1), repeat(' ', length(regexp_extract(cypher, '''([^'']*)''', 1)))) AS masked FROM cy")
def _(spark, d):
    return cypher_texts(spark, d).select("id", query_text.frame(query_text.mask_literals, "string", "cypher").alias("masked"))


@query("f29_domain_sample", "SELECT 'few' AS kind, substr(sha256(v), 1, 10) AS value FROM (SELECT DISTINCT p_type AS v FROM part) UNION ALL SELECT 'plain', v FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)")
def _(spark, d):
    """Hashed values of a small domain, plain ones of another, none of one that is too large or has an omitted value."""
    domain = lambda t, c: [r[0] for r in read(spark, d, t).select(c).distinct().limit(100).collect()]
    kinds, levels, names = domain("part", "p_type"), domain("orders", "o_orderpriority"), domain("customer", "c_name")
    found = [("few", privacy.domain_sample(kinds, 20, hashed=True)), ("plain", privacy.domain_sample(levels, 20)), ("large", privacy.domain_sample(names, 20)), ("omitted", privacy.domain_sample(levels, 20, omit=("^1-",)))]
    return spark.createDataFrame([(k, v) for k, vs in found for v in vs], "kind string, value string")


@query("f31_placeholders", "SELECT c_custkey, 'Orders of {{NAME_1}} in {{VALUE_1}}?' AS question, 'MATCH (c:C {name: ''{{NAME_1}}''}) RETURN c' AS cypher FROM customer")
def _(spark, d):
    def masked(name: str, segment: str) -> str:
        q, c, _ = values.with_placeholders(f"Orders of {name} in {segment}?", f"MATCH (c:C {{name: '{name}'}}) RETURN c", [name, segment])
        return json.dumps([q, c])

    rows = read(spark, d, "customer").select("c_custkey", query_text.frame(masked, "string", "c_name", "c_mktsegment").alias("j"))
    return rows.select("c_custkey", F.get_json_object("j", "$[0]").alias("question"), F.get_json_object("j", "$[1]").alias("cypher"))


# -- scores and statistics


@query("t02_projected_scores", "SELECT n_regionkey, round(2.0 * (k / n) * (k / g) / (k / n + k / g), 9)::DOUBLE AS f1, false AS exact FROM (SELECT n_regionkey, count(*) FILTER (n_nationkey % 5 <> 2 AND n_nationkey < 18) AS k, count(*) FILTER (n_nationkey < 18) AS n, count(*) FILTER (n_nationkey % 5 <> 2) AS g FROM nation GROUP BY 1) WHERE k > 0 AND n > k")
def _(spark, d):
    """Predicted columns have other names and one more than asked; the mapping is found."""

    def score(gold: str, predicted: str) -> str:
        found = statistics.projected_scores(json.loads(predicted), json.loads(gold))
        return json.dumps([found["f1"], found["exact"]])

    n = read(spark, d, "nation")
    gold = F.to_json(F.collect_list(F.when(F.col("n_nationkey") % 5 != 2, F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))))
    predicted = F.to_json(F.collect_list(F.when(F.col("n_nationkey") < 18, F.struct((F.col("n_nationkey") + 1000).alias("more"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")))))
    rows = n.groupBy("n_regionkey").agg(gold.alias("gold"), predicted.alias("predicted"), F.count_if((F.col("n_nationkey") % 5 != 2) & (F.col("n_nationkey") < 18)).alias("k"), F.count_if(F.col("n_nationkey") < 18).alias("n")).filter("k > 0 AND n > k")
    rows = rows.select("n_regionkey", query_text.frame(score, "string", "gold", "predicted").alias("j"))
    return rows.select("n_regionkey", F.round(F.get_json_object("j", "$[0]").cast("double"), 9).alias("f1"), (F.get_json_object("j", "$[1]") == "true").alias("exact"))


@query("t07_sign_flip_many", f"WITH {EVALS}, c AS (SELECT id % 37 AS cluster, sum(value - 50) AS s FROM ev GROUP BY 1), o AS (SELECT count(*) AS clusters, sum(s) AS observed FROM c), k AS (SELECT {bucket_sql('cluster', 'flip')} AS bucket, sum(s) AS s FROM c WHERE abs(s) > 1e-12 GROUP BY 1), x AS (SELECT s, draw, (({word_sql('d', '(draw % 256) // 32')}) >> (draw % 32)) & 1 AS bit FROM (SELECT s, draw, sha256('flip:' || (draw // 256)::VARCHAR || ':' || bucket::VARCHAR) AS d FROM k, (SELECT unnest(range(10000)) AS draw))), f AS (SELECT draw, sum(CASE WHEN bit = 1 THEN -s ELSE s END) AS v FROM x GROUP BY 1) SELECT any_value(clusters) AS clusters, round(any_value(observed), 4) AS observed, (count(*) FILTER (round(abs(v), 6) >= round(abs(observed), 6)) + 1) / (count(*) + 1) AS p FROM f, o")
def _(spark, d):
    """More than 16 clusters: Monte Carlo with signs from hashes."""
    e = evaluations(spark, d).withColumn("d", F.col("value") - 50).withColumn("cluster", F.col("id") % 37)
    return statistics.sign_flip(e, "cluster", "d").select("clusters", F.round("observed", 4).alias("observed"), "p")


@query("t10_rank_permutation", "WITH x AS (SELECT n_regionkey AS r, avg(c_acctbal) AS a, count(*) AS b FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), k AS (SELECT r, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x), p AS (SELECT a.ra * v.rb + b.ra * w.rb + c.ra * x.rb + d.ra * y.rb + e.ra * z.rb AS s FROM k a, k b, k c, k d, k e, k v, k w, k x, k y, k z WHERE a.r = 0 AND b.r = 1 AND c.r = 2 AND d.r = 3 AND e.r = 4 AND len(list_distinct([v.r, w.r, x.r, y.r, z.r])) = 5) SELECT round(avg((s >= (SELECT sum(ra * rb) FROM k) - 1e-9)::INT), 9) AS p FROM p")
def _(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).alias("b")).collect()
    return spark.createDataFrame([(round(statistics.rank_permutation([r["a"] for r in rows], [r["b"] for r in rows]), 9),)], "p double")


@query("t18_ridge", "SELECT 'size' AS feature, round(greatest(0, sum(p_size * p_retailprice) / (sum(p_size * p_size) + 1)), 6)::DOUBLE AS weight FROM part")
def _(spark, d):
    p = read(spark, d, "part").select(F.col("p_size").alias("size"), "p_retailprice")
    return spark.createDataFrame([(k, round(w, 6)) for k, w in statistics.non_negative_ridge(p, ["size"], "p_retailprice").items()], "feature string, weight double")


@query("t18_ridge_zero", "SELECT 'size' AS feature, 0.0::DOUBLE AS weight")
def _(spark, d):
    """A feature that only a negative weight would fit gets none."""
    p = read(spark, d, "part").select(F.col("p_size").alias("size"), (-F.col("p_retailprice")).alias("y"))
    return spark.createDataFrame(list(statistics.non_negative_ridge(p, ["size"], "y").items()), "feature string, weight double")


@query("t19_delta_bootstrap", f"WITH {EVALS}, ab AS (SELECT a.cluster, b.solved::INT::DOUBLE - a.solved::INT::DOUBLE AS d FROM ev a JOIN ev b ON a.item = b.item WHERE a.model = 1 AND b.model = 2), {unit_boot_sql('SELECT 0 AS g, cluster AS key, sum(d) AS total, count(*) AS n FROM ab GROUP BY ALL')} SELECT clusters, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM p JOIN b USING (g)")
def _(spark, d):
    e = evaluations(spark, d)
    out = statistics.delta_bootstrap(e.filter("model = 1"), e.filter("model = 2"), "item", "cluster", "solved")
    return out.select("clusters", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("t06_stratified_bootstrap", f"WITH {EVALS}, k AS MATERIALIZED (SELECT category AS g, cluster AS key, sum(solved::INT)::DOUBLE AS total, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT unnest(range(1, 2001)) AS rep), u AS (SELECT k.*, rep, ('0x' || substr(sha256('boot:' || rep::VARCHAR || ':' || key::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM k, r), w AS (SELECT g, rep, total, n, {poisson_sql()} AS w FROM u), s AS (SELECT g, rep, sum(w * total) AS t, sum(w * n) AS r, sum(total) AS all_t, sum(n) AS all_r FROM w GROUP BY ALL), m AS (SELECT rep, sum(CASE WHEN r > 0 THEN t / r ELSE all_t / all_r END * all_r) / sum(all_r) AS m FROM s GROUP BY 1) SELECT (SELECT count(*) FROM k) AS clusters, round((SELECT sum(total) / sum(n) FROM k), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m")
def _(spark, d):
    """Clusters resampled inside each category."""
    out = statistics.cluster_bootstrap(evaluations(spark, d), "cluster", "solved", strata=["category"])
    return out.select("clusters", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


def sides_sql(seed: str) -> str:
    """Means of five models in each replicate (0: themselves) on items of even and odd number: c (model, rep, a, b)."""
    side = lambda s, odd: f"""k{s} AS MATERIALIZED (SELECT model, {bucket_sql("cluster", f"{seed}-{s}")} AS bucket, sum(value) AS t, count(*) AS r FROM ev WHERE model < 5 AND item % 2 = {odd} GROUP BY ALL), {draws_sql(f"w{s}", f"k{s}", f"{seed}-{s}")},
m{s} AS (SELECT model, rep, CASE WHEN sum(w * r) > 0 THEN sum(w * t) / sum(w * r) END AS v FROM w{s} GROUP BY ALL UNION ALL SELECT model, 0, sum(t) / sum(r) FROM k{s} GROUP BY model)"""  # noqa: E731
    return f"{EVALS}, {side('a', 0)}, {side('b', 1)}, c AS MATERIALIZED (SELECT model, rep, ma.v AS a, mb.v AS b FROM ma JOIN mb USING (model, rep))"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = evaluations(spark, d).filter("model < 5")
    return e.filter("item % 2 = 0"), e.filter("item % 2 = 1")


@query("t11_rank_interval", f"""WITH {sides_sql("rank")}, q AS (SELECT model, rep, round(a, 12) AS a, round(b, 12) AS b FROM c),
t AS (SELECT rep, sum(sign(x.a - y.a) * sign(x.b - y.b)) AS s, sum(abs(sign(x.a - y.a))) AS ua, sum(abs(sign(x.b - y.b))) AS ub FROM q x JOIN q y USING (rep) WHERE x.model < y.model GROUP BY 1),
tau AS (SELECT rep, CASE WHEN ua * ub > 0 THEN s / sqrt(ua * ub) END AS tau FROM t),
k AS MATERIALIZED (SELECT rep, model, a, b, rank() OVER (PARTITION BY rep ORDER BY a) + (count(*) OVER (PARTITION BY rep, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY rep ORDER BY b) + (count(*) OVER (PARTITION BY rep, b) - 1) / 2 AS rb FROM q),
rho AS (SELECT rep, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM k GROUP BY 1),
z AS (SELECT * FROM k WHERE rep = 0),
orders AS (SELECT row_number() OVER () AS o, [v.model, w.model, x.model, y.model, z2.model] AS ms FROM z v, z w, z x, z y, z z2 WHERE len(list_distinct([v.model, w.model, x.model, y.model, z2.model])) = 5),
flat AS (SELECT o, unnest([0, 1, 2, 3, 4]) AS pos, unnest(ms) AS m FROM orders),
met AS (SELECT flat.o, pos, m, i.a, i.ra, j.b, j.rb FROM flat JOIN z i ON i.model = pos JOIN z j ON j.model = m),
null_rho AS (SELECT o, sum((ra - 3) * (rb - 3)) AS s, bool_and(pos = m) AS own FROM met GROUP BY 1),
null_tau AS (SELECT x.o, sum(sign(x.a - y.a) * sign(x.b - y.b)) AS s, bool_and(x.pos = x.m AND y.pos = y.m) AS own FROM met x JOIN met y ON x.o = y.o AND x.pos < y.pos GROUP BY 1)
SELECT 5::INT AS models, round(max(tau) FILTER (rep = 0), 9) AS tau, round(quantile_cont(tau, 0.025) FILTER (rep > 0), 9) AS tau_low, round(quantile_cont(tau, 0.975) FILTER (rep > 0), 9) AS tau_high,
  round(max(rho) FILTER (rep = 0), 9) AS rho, round(quantile_cont(rho, 0.025) FILTER (rep > 0), 9) AS rho_low, round(quantile_cont(rho, 0.975) FILTER (rep > 0), 9) AS rho_high, count(*) FILTER (rep > 0 AND tau IS NULL) AS undefined,
  (SELECT avg((abs(s) >= (SELECT abs(s) FROM null_tau WHERE own) - 1e-9)::INT) FROM null_tau) AS tau_p, (SELECT avg((abs(s) >= (SELECT abs(s) FROM null_rho WHERE own) - 1e-9)::INT) FROM null_rho) AS rho_p
FROM tau JOIN rho USING (rep)""")
def _(spark, d):
    """Five models on two halves of the items, ranked anew in each replicate."""
    out = resampling.rank_agreement_interval(*sides(spark, d), "model", "value", "cluster")
    return out.select("models", *[F.round(c, 9).alias(c) for c in ("tau", "tau_low", "tau_high", "rho", "rho_low", "rho_high")], "undefined", "tau_p", "rho_p")


@query("t11_self_preference", f"""WITH {sides_sql("self")}, e AS (SELECT rep, max(a) FILTER (model = 2) - avg(a) FILTER (model <> 2) AS own_slice, max(b) FILTER (model = 2) - avg(b) FILTER (model <> 2) AS other_slice, max(a - b) FILTER (model = 2) - median(a - b) FILTER (model <> 2) AS against_median FROM c GROUP BY 1),
l AS (UNPIVOT (SELECT rep, own_slice, other_slice, own_slice - other_slice AS difference, against_median FROM e) ON own_slice, other_slice, difference, against_median INTO NAME estimate VALUE v)
SELECT estimate, round(max(v) FILTER (rep = 0), 9) AS point, round(quantile_cont(v, 0.025) FILTER (rep > 0), 9) AS low, round(quantile_cont(v, 0.975) FILTER (rep > 0), 9) AS high, round(avg((v > 0)::INT) FILTER (rep > 0), 9) AS above_zero FROM l GROUP BY 1""")
def _(spark, d):
    out = resampling.self_preference_interval(*sides(spark, d), "model", "value", "cluster", 2)
    return out.select("estimate", *[F.round(c, 9).alias(c) for c in ("point", "low", "high", "above_zero")])


@query("t11_placebo", f"""WITH {sides_sql("self")}, d AS (SELECT model, max(a - b) FILTER (rep = 0) AS delta, quantile_cont(a - b, 0.025) FILTER (rep > 0) AS low, quantile_cont(a - b, 0.975) FILTER (rep > 0) AS high FROM c GROUP BY 1),
p AS (SELECT *, delta - (sum(delta) OVER () - delta) / (count(*) OVER () - 1) AS placebo FROM d), o AS (SELECT placebo AS o FROM p WHERE model = 2)
SELECT model, round(delta, 9) AS delta, round(low, 9) AS low, round(high, 9) AS high, round(placebo, 9) AS placebo, avg((placebo >= o - 1e-12)::INT) OVER () AS one_sided, avg((abs(placebo) >= abs(o) - 1e-12)::INT) OVER () AS two_sided FROM p, o""")
def _(spark, d):
    out = resampling.placebo_contrasts(*sides(spark, d), "model", "value", "cluster", 2)
    return out.select("model", *[F.round(c, 9).alias(c) for c in ("delta", "low", "high", "placebo")], "one_sided", "two_sided")


@query("t18_tier_thresholds", "WITH s AS (SELECT (p_size % 12)::DOUBLE AS s FROM part), c AS (SELECT DISTINCT s FROM s UNION ALL SELECT max(s) + 1 FROM s), p AS (SELECT a.s AS low, b.s AS high, (SELECT avg((s < a.s)::INT) FROM s) AS e, (SELECT avg((s < b.s)::INT) FROM s) AS m FROM c a JOIN c b ON a.s < b.s) SELECT low, high FROM p ORDER BY round(abs(e - 0.35) + abs(m - e - 0.35) + abs(1 - m - 0.3), 12), low, high LIMIT 1")
def _(spark, d):
    low, high = statistics.tier_thresholds(read(spark, d, "part").withColumn("s", F.col("p_size") % 12), "s")
    return spark.createDataFrame([(low, high)], "low double, high double")


@query("t18_integer_weights", "SELECT * FROM (SELECT l_linenumber::VARCHAR AS feature, round(20.0 * count(*) FILTER (l_returnflag = 'R' AND l_quantity < 25) / sum(count(*)) OVER ())::BIGINT AS weight FROM lineitem GROUP BY 1) WHERE weight > 0")
def _(spark, d):
    """Whole weights of the line numbers by their share of small returned lines."""
    small = F.count(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 25), 1))
    lines = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("feature")).agg(F.count(F.lit(1)).alias("n"), small.alias("k")).collect()  # a row a line number
    found = statistics.integer_weights({r["feature"]: r["k"] / sum(m["n"] for m in lines) for r in lines}, 20.0)
    return spark.createDataFrame(list(found.items()), "feature string, weight long")


@query("x21_failure_reasons", f"WITH {GATES} SELECT flag, coalesce(nullif(reason, ''), CASE WHEN has THEN code END, CASE WHEN NOT success THEN 'timeout' END, 'unknown') AS why, count(*) AS n FROM g WHERE NOT accepted GROUP BY ALL")
def _(spark, d):
    """Reasons of the records that were not accepted, by cell."""
    rows = gate_rows(spark, d).filter("NOT accepted")
    why = summaries.failure_reason(F.col("reason"), F.col("issues"), F.when(~F.col("success"), " timeout "))
    return rows.groupBy("flag", why.alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query("x21_redacted_log", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Received notification from DBMS server: [REDACTED_NOTIFICATION] for query: \"[REDACTED_CYPHER]\"' WHEN 1 THEN 'run Cypher=[REDACTED_CYPHER] took ' || c_custkey ELSE 'value ''[REDACTED_LITERAL]'' of ''[REDACTED_LITERAL]'' kept' END AS line FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    noted = F.concat(F.lit("WARN notice for query: MATCH (c {name: '"), "c_name", F.lit("'})"))
    run = F.concat(F.lit('run Cypher="MATCH (c {name: \\"'), "c_name", F.lit('\\"})" took '), k.cast("string"))
    value = F.concat(F.lit("value '"), "c_name", F.lit("' of '"), "c_mktsegment", F.lit("' kept"))
    return read(spark, d, "customer").select("c_custkey", privacy.redact_log(F.when(k % 3 == 0, noted).when(k % 3 == 1, run).otherwise(value)).alias("line"))
