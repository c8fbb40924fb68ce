"""Dataset operators as queries over the driver's tables, each with the SQL that must give the same rows.

Orders stand for benchmark items (graph: status, category: priority, signature: customer modulo 40), events for
evaluation rows, labels for two binary raters, documents and benchmark for question texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import privacy, text
from ..operators import joins, selection, statistics, summaries
from ..steps import spread

SEED = selection.SEED


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("graph"), F.col("o_orderpriority").alias("category"), F.concat(F.lit("s"), (F.col("o_custkey") % 40).cast("string")).alias("signature"), F.col("o_totalprice").alias("price"))


ITEMS = "items AS (SELECT o_orderkey AS id, o_orderstatus AS graph, o_orderpriority AS category, 's' || (o_custkey % 40)::VARCHAR AS signature, o_totalprice AS price FROM orders)"
HASH = f"sha256('{SEED}:' || id::VARCHAR)"


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluation rows of ten models: solved if the value is above 40."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") % 10).alias("model"), F.col("event_type").alias("category"), F.col("value"), (F.col("value") > 40).alias("solved"), (F.floor(F.col("event_id") / 10)).cast("long").alias("item"), F.col("user_id").alias("cluster"))


EVALS = "ev AS (SELECT event_id AS id, event_id % 10 AS model, event_type AS category, value, value > 40 AS solved, event_id // 10 AS item, user_id AS cluster FROM events)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent benchmark texts as prediction and reference, as tokens."""
    b = read(spark, sf_dir, "benchmark")
    a, c = b.select(F.col("item_id").alias("id"), text.tokenize(F.col("text")).alias("p")), b.select((F.col("item_id") - 1).alias("id"), text.tokenize(F.col("text")).alias("r"))
    return a.join(c, "id")


TOK = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
PAIRS = f"pr AS (SELECT a.item_id AS id, a.t AS p, b.t AS r FROM (SELECT item_id, {TOK} AS t FROM benchmark) a JOIN (SELECT item_id - 1 AS item_id, {TOK} AS t FROM benchmark) b USING (item_id))"


def grams_sql(col: str, n: int) -> str:
    return f"list_transform(range(1, len({col}) - {n} + 2), lambda i: array_to_string(list_slice({col}, i, i + {n} - 1), ' '))"


def overlap_sql(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda x: x = g)), len(list_filter({b}, lambda x: x = g))))), 0)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# -- row selection


@query("p12_tie_check", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i FROM c) SELECT CASE WHEN (SELECT n FROM r WHERE i = 10) = (SELECT n FROM r WHERE i = 11) THEN 'tie' ELSE 'no_tie' END AS status, 10 AS k")
def _(spark, d):
    return selection.tie_at_limit(read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), ["n"], 10)


@query("p13_truncation", "SELECT 50::BIGINT AS returned, true AS unordered_limit, true AS limit_reached")
def _(spark, d):
    return selection.truncation(read(spark, d, "orders"), 50, ordered=False)


@query("p16_set_algebra", "SELECT 'minus' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def _(spark, d):
    a, b = read(spark, d, "customer").select("c_nationkey"), read(spark, d, "supplier").filter("s_acctbal > 0").select("s_nationkey")
    n = F.count(F.lit(1)).alias("n")
    return a.subtract(b).agg(n).select(F.lit("minus").alias("op"), "n").unionByName(a.intersect(b).agg(n).select(F.lit("both").alias("op"), "n"))


@query("p20_first_by_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(spark, d):
    return selection.first_by_key(read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("p21_without_repeats", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events) WHERE event_type IS DISTINCT FROM l")
def _(spark, d):
    return selection.without_repeats(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id")


@query("p22_hash_order", f"SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('{SEED}:' || c_custkey::VARCHAR)) AS place FROM customer")
def _(spark, d):
    # A place in each nation's order: no window spans the table.
    w = Window.partitionBy("c_nationkey").orderBy(selection.hash_key("c_custkey"))
    return read(spark, d, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


# -- caps, splits, quotas, samples


@query("w01_cap_per_signature", f"WITH {ITEMS} SELECT id, dropped FROM (SELECT id, row_number() OVER (w ORDER BY {HASH}, id) AS r, greatest(count(*) OVER w - 5, 0) AS dropped FROM items WINDOW w AS (PARTITION BY graph, category, signature)) WHERE r <= 5")
def _(spark, d):
    return selection.cap_per_group(items(spark, d), ["graph", "category", "signature"], 5).select("id", "dropped")


@query("w02_cap_round_robin", f"WITH {ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY graph, category, signature ORDER BY {HASH}, id) AS k FROM items) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY graph, category ORDER BY k, signature) AS r FROM a) WHERE r <= 60")
def _(spark, d):
    return selection.cap_round_robin(items(spark, d), ["graph", "category"], "signature", 60).select("id")


COUNTS = "CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN {two} WHEN greatest(round_even(n * 0.1, 0), 1) * 2 >= n THEN 1 ELSE greatest(round_even(n * 0.1, 0), 1) END"


@query("w03_random_splits", f"WITH {ITEMS}, a AS (SELECT id, row_number() OVER (w ORDER BY {HASH}, id) AS r, count(*) OVER w AS n FROM items WINDOW w AS (PARTITION BY graph, category)), b AS (SELECT *, {COUNTS.format(two=1)} AS t, {COUNTS.format(two=0)} AS v FROM a) SELECT id, CASE WHEN r <= n - t - v THEN 'train' WHEN r <= n - t THEN 'dev' ELSE 'test' END AS split FROM b")
def _(spark, d):
    return selection.random_splits(items(spark, d), ["graph", "category"]).select("id", "split")


@query("w04_repaired_splits", f"WITH {ITEMS} SELECT id, CASE row_number() OVER (ORDER BY id DESC) WHEN 1 THEN 'dev' WHEN 2 THEN 'test' ELSE 'train' END AS split FROM items")
def _(spark, d):
    return selection.repair_splits(items(spark, d).withColumn("split", F.lit("train"))).select("id", "split")


@query("w05_signature_splits", f"""WITH {ITEMS}, s AS (SELECT graph, category, signature, count(*) AS n FROM items GROUP BY ALL),
a AS (SELECT *, sha256('{SEED}:' || graph || ':' || category || ':' || signature) AS k FROM s),
b AS (SELECT *, row_number() OVER o AS i, coalesce(sum(n) OVER (PARTITION BY graph, category ORDER BY k, signature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, count(*) OVER w AS sigs, greatest(round_even(sum(n) OVER w * 0.1, 0), 1) AS goal FROM a WINDOW w AS (PARTITION BY graph, category), o AS (PARTITION BY graph, category ORDER BY k, signature)),
c AS (SELECT *, prior < goal AND i < sigs AS is_test FROM b), e AS (SELECT *, sum(CASE WHEN is_test THEN n ELSE 0 END) OVER (PARTITION BY graph, category) AS filled FROM c)
SELECT id, CASE WHEN sigs < 3 THEN 'train' WHEN is_test THEN 'test' WHEN prior - filled < goal AND i < sigs THEN 'dev' ELSE 'train' END AS split FROM items JOIN e USING (graph, category, signature)""")
def _(spark, d):
    return selection.signature_splits(items(spark, d), ["graph", "category"], "signature").select("id", "split")


@query("w06_split_leakage", f"WITH {ITEMS}, a AS (SELECT id, signature, row_number() OVER (w ORDER BY {HASH}, id) AS r, count(*) OVER w AS n FROM items WINDOW w AS (PARTITION BY graph, category)), b AS (SELECT *, {COUNTS.format(two=1)} AS t, {COUNTS.format(two=0)} AS v FROM a), c AS (SELECT signature, CASE WHEN r <= n - t - v THEN 'train' WHEN r <= n - t THEN 'dev' ELSE 'test' END AS split FROM b) SELECT signature, count(DISTINCT split) AS splits FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _(spark, d):
    return selection.split_leakage(selection.random_splits(items(spark, d), ["graph", "category"]), "signature")


@query("w07_block_splits", f"""WITH RECURSIVE {ITEMS}, b AS (SELECT signature, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, signature) AS i, sum(count(*)) OVER () AS total FROM items GROUP BY 1),
s(i, a, d, t, split) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' UNION ALL
  SELECT bi, a + CASE WHEN c = 'train' THEN n ELSE 0 END, d + CASE WHEN c = 'dev' THEN n ELSE 0 END, t + CASE WHEN c = 'test' THEN n ELSE 0 END, c
  FROM (SELECT s.*, b.i AS bi, b.n, CASE WHEN 0.8::DOUBLE * total - a >= 0.1::DOUBLE * total - d AND 0.8::DOUBLE * total - a >= 0.1::DOUBLE * total - t THEN 'train' WHEN 0.1::DOUBLE * total - d >= 0.1::DOUBLE * total - t THEN 'dev' ELSE 'test' END AS c FROM s JOIN b ON b.i = s.i + 1) x)
SELECT signature, split, n FROM s JOIN b USING (i)""")
def _(spark, d):
    return selection.block_splits(items(spark, d), "signature", {"train": 0.8, "dev": 0.1, "test": 0.1}).groupBy("signature", "split").agg(F.count(F.lit(1)).alias("n"))


@query("w08_diverse_selection", """WITH RECURSIVE s(p_brand, pick, ids, kinds, sizes, id) AS (
  SELECT DISTINCT p_brand, 0, []::BIGINT[], []::VARCHAR[], []::VARCHAR[], NULL::BIGINT FROM part UNION ALL
  SELECT p_brand, pick + 1, list_append(ids, best.id), list_append(kinds, best.kind), list_append(sizes, best.size), best.id FROM (
    SELECT p_brand, pick, ids, kinds, sizes, arg_min({'id': k, 'kind': kind, 'size': size}, (-gain, k)) AS best FROM (
      SELECT s.*, p.k, p.kind, p.size, 0.5::DOUBLE * (NOT list_contains(kinds, p.kind))::INT + 0.3::DOUBLE * (NOT list_contains(sizes, p.size))::INT - CASE WHEN len(list_filter(kinds, lambda x: x = p.kind)) >= 2 THEN 0.35::DOUBLE ELSE 0 END AS gain
      FROM s JOIN (SELECT p_brand AS b, p_partkey::BIGINT AS k, p_type AS kind, p_size::VARCHAR AS size FROM part) p ON p.b = s.p_brand WHERE pick < 8 AND NOT list_contains(ids, p.k)) GROUP BY ALL))
SELECT p_brand, id, pick FROM s WHERE pick > 0""")
def _(spark, d):
    few = read(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.array("p_type").alias("kinds"), F.array(F.col("p_size").cast("string")).alias("sizes"))
    return selection.diverse_selection(few, "p_brand", "id", {"kinds": ("kinds", 0.5), "sizes": ("sizes", 0.3)}, 8, caps=[("kinds", 0.25, 0.35)])


@query("w08_eight_terms")
def _(spark, d):
    """All terms and both caps; a greedy choice of 12 parts of each brand (tests hold the operator against a plain loop)."""
    part = read(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), "p_type", F.concat("p_type", F.lit("/"), (F.col("p_size") % 7).cast("string")).alias("family"), F.split("p_name", " ").alias("words"), F.array("p_type", (F.col("p_size") % 5).cast("string")).alias("atoms"), F.array(F.col("p_size").cast("string")).alias("sizes"), (F.col("p_size") % 3).cast("string").alias("operators"), (F.col("p_retailprice") / 2000).alias("quality"))
    terms = {"signature": "p_type", "family": "family", "substructures": "words", "schema_atoms": "atoms", "values": "sizes", "tokens": "words", "quality": "quality", "operators": "operators"}
    return selection.example_selection(part, "p_brand", "id", 12, terms)


@query("w09_entity_cap", f"WITH {ITEMS} SELECT id, row_number() OVER (PARTITION BY category, signature ORDER BY id) > 12 AS over_cap FROM items")
def _(spark, d):
    return selection.entity_cap(items(spark, d), ["category"], "signature", ["id"], 12).select("id", "over_cap")


@query("w10_ordered_quota", f"""WITH RECURSIVE {ITEMS}, o AS (SELECT id, signature || '|' || graph AS dup, category, graph, row_number() OVER (ORDER BY id) AS i FROM items),
s(i, seen, cats, graphs, decision) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], '' UNION ALL
  SELECT i, CASE WHEN c = 'accept' THEN list_append(seen, dup) ELSE seen END, CASE WHEN c = 'accept' THEN list_append(cats, category) ELSE cats END, CASE WHEN c = 'accept' THEN list_append(graphs, graph) ELSE graphs END, c
  FROM (SELECT o.*, seen, cats, graphs, CASE WHEN list_contains(seen, dup) THEN 'duplicate' WHEN len(list_filter(cats, lambda x: x = o.category)) >= 20 THEN 'quota:tier' WHEN len(list_filter(graphs, lambda x: x = o.graph)) >= 30 THEN 'quota:graph' ELSE 'accept' END AS c FROM s JOIN o ON o.i = s.i + 1))
SELECT id, decision FROM s JOIN o USING (i)""")
def _(spark, d):
    return selection.ordered_quota(items(spark, d), ["signature", "graph"], {"tier": (["category"], 20), "graph": (["graph"], 30)}, ["id"]).select("id", "decision")


@query("w11_largest_remainder", f"WITH {ITEMS}, c AS (SELECT category, count(*) AS n FROM items GROUP BY 1), e AS (SELECT *, round(n / sum(n) OVER () * 101, 9) AS x FROM c), f AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY round(floor(x) - x, 9), category) AS r, 101 - sum(floor(x)) OVER () AS rest FROM e) SELECT category, (f + (r <= rest)::INT)::BIGINT AS quota FROM f")
def _(spark, d):
    return selection.largest_remainder(items(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n")), "n", 101, "category").select("category", "quota")


@query("w14_stratified_sample", f"WITH {ITEMS} SELECT id, n / least(n, 20) AS weight FROM (SELECT id, row_number() OVER (w ORDER BY {HASH}, id) AS r, count(*) OVER w AS n FROM items WINDOW w AS (PARTITION BY graph, category)) WHERE r <= 20")
def _(spark, d):
    return selection.stratified_sample(items(spark, d), ["graph", "category"], 20).select("id", "weight")


@query("w16_annotators", f"WITH {ITEMS}, p AS (SELECT id, row_number() OVER (PARTITION BY graph ORDER BY {HASH}, id) AS r FROM items), q AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM p WHERE r <= 20) SELECT id, n % 5 = 0 AS shared, unnest(CASE WHEN n % 5 = 0 THEN ['a', 'b', 'c'] ELSE [['a', 'b', 'c'][(n % 3 + 1)::INT]] END) AS annotator FROM q")
def _(spark, d):
    packet = selection.stratified_sample(items(spark, d), ["graph"], 20)
    return selection.assign_annotators(packet, ["a", "b", "c"], 5, ["id"]).select("id", "shared", "annotator")


@query("w17_quartiles", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1")
def _(spark, d):
    out = statistics.quartiles(read(spark, d, "customer"), "c_acctbal", ["c_mktsegment"])
    return out.withColumns({c: F.round(c, 6) for c in ("median", "q1", "q3")})


@query("w18_average_ranks", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rank FROM part")
def _(spark, d):
    return statistics.average_ranks(read(spark, d, "part"), "p_size").select("p_partkey", "rank")


@query("w19_hash_fraction", f"SELECT o_orderkey FROM orders WHERE ('0x' || substr(sha256('{SEED}:' || o_custkey::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 < 0.05")
def _(spark, d):
    return selection.hash_fraction(read(spark, d, "orders"), ["o_custkey"], 0.05).select("o_orderkey")


@query("w20_rotation", "SELECT n_nationkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 - 2 + 5) % 5 AS turn FROM nation")
def _(spark, d):
    return selection.rotate(read(spark, d, "nation"), ["n_regionkey"], ["n_nationkey"], 2).select("n_nationkey", "turn")


@query("w21_fill_deficits", f"WITH {ITEMS}, need AS (SELECT category, count(*) // 10 AS need FROM items WHERE graph = 'F' GROUP BY 1) SELECT id, row_number() OVER (PARTITION BY category ORDER BY {HASH}, id) <= coalesce(need, 0) AS used FROM items LEFT JOIN need USING (category) WHERE graph = 'O'")
def _(spark, d):
    rows = items(spark, d)
    needs = rows.filter("graph = 'F'").groupBy("category").agg(F.expr("count(1) div 10").alias("need"))
    return selection.fill_deficits(rows.filter("graph = 'O'"), needs, ["category"], [selection.hash_key("id"), "id"]).select("id", "used")


@query("w22_carve_dev", f"WITH {ITEMS} SELECT id, CASE WHEN row_number() OVER (PARTITION BY graph ORDER BY {HASH}, id) <= round_even(count(*) OVER (PARTITION BY graph) * 0.05, 0) THEN 'dev' ELSE 'train' END AS split FROM items")
def _(spark, d):
    return selection.carve_dev(items(spark, d), ["graph"], 0.05).select("id", "split")


# -- grouped summaries


@query("a09_metric_means", f"WITH {EVALS} SELECT dimension, value, n, round(accuracy, 9) AS accuracy, round(mean_value, 6) AS mean_value FROM (SELECT 'all' AS dimension, 'all' AS value, count(*) AS n, avg(solved::INT) AS accuracy, avg(value) AS mean_value FROM ev UNION ALL SELECT 'category', category, count(*), avg(solved::INT), avg(value) FROM ev GROUP BY category UNION ALL SELECT 'model', model::VARCHAR, count(*), avg(solved::INT), avg(value) FROM ev GROUP BY model)")
def _(spark, d):
    rows = evaluations(spark, d).withColumn("accuracy", F.col("solved")).withColumn("mean_value", F.col("value"))
    return summaries.metric_means(rows, ["accuracy", "mean_value"], ["category", "model"]).select("dimension", "value", "n", F.round("accuracy", 9).alias("accuracy"), F.round("mean_value", 6).alias("mean_value"))


@query("a10_top_counts", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def _(spark, d):
    return summaries.top_counts(read(spark, d, "orders"), "o_custkey", 12)


@query("a11_cross_counts", "SELECT o_orderstatus || '::' || o_orderpriority AS cell, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return summaries.cross_counts(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("a12_export_counts", f"WITH {ITEMS} SELECT 'graph' AS dimension, graph AS value, count(*) AS n FROM items GROUP BY graph UNION ALL SELECT 'category', category, count(*) FROM items GROUP BY category UNION ALL SELECT 'signature', signature, count(*) FROM items GROUP BY signature")
def _(spark, d):
    return summaries.export_counts(items(spark, d), ["graph", "category", "signature"])


@query("a13_distribution", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY p_brand) AS p FROM c) SELECT p_brand, sum(n)::BIGINT AS total, count(*) AS \"unique\", round(sum(-p * log2(p)), 9) AS entropy_bits, round(1 - sum(p * p), 9) AS simpson, round(max(p), 9) AS top_share, round(CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 1 END, 9) AS normalized_entropy, round(pow(2, sum(-p * log2(p))), 6) AS effective_count FROM p GROUP BY 1")
def _(spark, d):
    out = summaries.distribution(read(spark, d, "part"), "p_type", ["p_brand"])
    return out.select("p_brand", "total", "unique", *[F.round(c, 9).alias(c) for c in ("entropy_bits", "simpson", "top_share", "normalized_entropy")], F.round("effective_count", 6).alias("effective_count"))


@query("a14_coverage", "SELECT count(DISTINCT p_type)::INT AS used, 5 AS known, count(DISTINCT p_type) / 5 AS share FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE', 'PROMO', 'NONE')")
def _(spark, d):
    return summaries.coverage(read(spark, d, "part").select(F.array("p_type").alias("t")), "t", ["ECONOMY", "SMALL", "LARGE", "PROMO", "NONE"])


@query("a15_latency", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events GROUP BY 1")
def _(spark, d):
    out = summaries.latency_summary(read(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], "max")


def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as generation records: modular arithmetic gives every gate some rows."""
    k = F.col("l_orderkey") * 7 + F.col("l_partkey")
    code = F.element_at(F.array(*[F.lit(c) for c in ("wrong_direction", "unknown_label", "invalid_categorical_value", "something_new", "not_read_only")]), (k % 5 + 1).cast("int"))
    return read(spark, d, "lineitem").select(
        F.when(k % 4 == 0, F.array(code)).otherwise(F.array().cast("array<string>")).alias("issues"), (k % 11 != 0).alias("read_only"), (k % 13 != 0).alias("syntax"), (k % 17 != 0).alias("schema"), (k % 3 != 0).alias("success"), (k % 9).alias("rows"),
        (k % 2 == 0).alias("passed"), F.when(k % 6 == 1, "Duplicate question").when(k % 6 == 3, "wrong label used").when(k % 6 == 5, "ambiguous wording").otherwise("").alias("reason"), (k % 19 == 0).alias("accepted"), F.col("l_returnflag").alias("flag"),
    )


GATES = "g AS (SELECT *, k % 4 = 0 AS has, ['wrong_direction', 'unknown_label', 'invalid_categorical_value', 'something_new', 'not_read_only'][(k % 5 + 1)::INT] AS code, k % 11 <> 0 AS read_only, k % 13 <> 0 AS syntax, k % 17 <> 0 AS schema, k % 3 <> 0 AS success, k % 9 AS rows, k % 2 = 0 AS passed, CASE k % 6 WHEN 1 THEN 'Duplicate question' WHEN 3 THEN 'wrong label used' WHEN 5 THEN 'ambiguous wording' ELSE '' END AS reason, k % 19 = 0 AS accepted FROM (SELECT l_orderkey * 7 + l_partkey AS k, l_returnflag AS flag FROM lineitem))"


@query("a16_gate_impact", f"WITH {GATES} SELECT CASE WHEN has AND code = 'not_read_only' THEN 'read_only' WHEN has AND code = 'unknown_label' THEN 'schema' WHEN has AND code = 'wrong_direction' THEN 'direction' WHEN has AND code = 'invalid_categorical_value' THEN 'value' WHEN has THEN 'validation' WHEN NOT read_only THEN 'read_only' WHEN NOT syntax THEN 'syntax' WHEN NOT schema THEN 'schema' WHEN NOT success THEN 'execution' WHEN rows = 0 THEN 'empty_result' WHEN NOT passed THEN CASE WHEN reason LIKE 'Duplicate%' THEN 'duplicate_or_diversity' ELSE 'judge' END WHEN accepted THEN 'accepted' ELSE 'other_reject' END AS gate, count(*) AS n FROM g GROUP BY 1")
def _(spark, d):
    c = F.col
    gate = summaries.blocking_gate(c("issues"), c("read_only"), c("syntax"), c("schema"), c("success"), c("rows"), c("passed"), c("reason"), c("accepted"))
    return gate_rows(spark, d).groupBy(gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query("a17_failure_taxonomy", f"WITH {GATES} SELECT CASE WHEN accepted THEN 'accepted' WHEN reason LIKE 'Duplicate%' THEN 'diversity_control' WHEN NOT read_only THEN 'read_only_safety' WHEN NOT syntax THEN 'syntax_invalid' WHEN NOT schema THEN 'schema_invalid' WHEN NOT success THEN 'execution_error' WHEN rows = 0 THEN 'empty_result' WHEN NOT passed THEN 'judge_reject' ELSE 'other_reject' END AS bucket, CASE WHEN reason LIKE 'Dup%' THEN 'diversity_control' WHEN reason LIKE 'amb%' THEN 'ambiguity' WHEN reason LIKE '%label%' THEN 'schema_mismatch' ELSE 'other' END AS reason_bucket, count(*) AS n FROM g GROUP BY ALL")
def _(spark, d):
    c = F.col
    bucket = summaries.failure_bucket(c("accepted"), c("reason"), c("read_only"), c("syntax"), c("schema"), c("success"), c("rows"), c("passed"))
    return gate_rows(spark, d).groupBy(bucket.alias("bucket"), summaries.reason_bucket(c("reason")).alias("reason_bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("a18_downstream_errors", f"WITH {GATES}, b AS (SELECT flag, CASE WHEN accepted THEN 'correct' WHEN reason <> '' THEN 'prediction_error' WHEN NOT syntax THEN 'parse_invalid' WHEN NOT read_only THEN 'unsafe_or_not_read_only' WHEN NOT schema THEN 'schema_invalid' WHEN NOT success THEN 'execution_failed' WHEN rows > 4 THEN 'partial_answer_mismatch' ELSE 'answer_mismatch' END AS bucket FROM g) SELECT flag, bucket, n, round(n / sum(n) OVER (PARTITION BY flag), 9) AS share FROM (SELECT flag, bucket, count(*) AS n FROM b GROUP BY ALL)")
def _(spark, d):
    c = F.col
    bucket = summaries.downstream_bucket(c("accepted"), c("reason"), c("syntax"), c("read_only"), c("schema"), c("success"), F.when(c("rows") > 4, 0.5).otherwise(0.0))
    return summaries.shares(gate_rows(spark, d).withColumn("bucket", bucket), "bucket", ["flag"]).withColumn("share", F.round("share", 9))


@query("a19_issue_counts", f"WITH {GATES} SELECT flag, code AS issue, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected FROM g WHERE has GROUP BY ALL")
def _(spark, d):
    return summaries.issue_counts(gate_rows(spark, d), "issues", ["flag"], "accepted")


@query("a20_tag_rates", "WITH t AS (SELECT p_type, unnest(list_distinct([p_brand, 'size' || (p_size % 3)::VARCHAR])) AS tag FROM part), n AS (SELECT p_type, count(*) AS c FROM part GROUP BY 1) SELECT p_type, tag, count(*) AS n, round(count(*) / any_value(c), 9) AS rate FROM t JOIN n USING (p_type) GROUP BY ALL")
def _(spark, d):
    rows = read(spark, d, "part").select("p_type", F.array("p_brand", F.concat(F.lit("size"), (F.col("p_size") % 3).cast("string"))).alias("tags"))
    return summaries.tag_rates(rows, "tags", "p_type").withColumn("rate", F.round("rate", 9))


@query("a22_spread", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM events GROUP BY 1")
def _(spark, d):
    return summaries.spread(read(spark, d, "events"), "value", ["event_type"]).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("a23_capacity", "SELECT p_type, count(*) AS templates, sum(CASE WHEN p_size % 4 > 0 THEN 25 ELSE 1 END)::BIGINT AS capacity FROM part GROUP BY 1")
def _(spark, d):
    return summaries.capacity(read(spark, d, "part").withColumn("slots", F.col("p_size") % 4), "slots", "p_type", 25)


@query("a24_transfer", f"WITH {EVALS}, m AS (SELECT model, category, round(avg(solved::INT), 9) AS m FROM ev GROUP BY ALL) SELECT model, arg_max(category, (m, category)) AS best_control, max(m) AS best, round(max(m) - min(m), 9) AS delta FROM m GROUP BY 1")
def _(spark, d):
    return summaries.transfer(evaluations(spark, d), "model", "category", "solved")


@query("a25_spend", "SELECT l_returnflag, count(*) AS calls, round(sum(l_tax), 6) AS cost, round(avg((l_discount > 0.05)::INT), 9) AS cached_share, count(*) FILTER (l_quantity > 45) AS accepted, round(sum(l_tax) / count(*) FILTER (l_quantity > 45), 9) AS per_accepted FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = read(spark, d, "lineitem").withColumn("c", F.col("l_discount") > 0.05).withColumn("a", F.col("l_quantity") > 45)
    return summaries.spend(rows, "l_tax", "c", "a", ["l_returnflag"]).select("l_returnflag", "calls", F.round("cost", 6).alias("cost"), F.round("cached_share", 9).alias("cached_share"), "accepted", F.round("per_accepted", 9).alias("per_accepted"))


@query("x03_modal_value", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, sha256(p_type)) AS r FROM c) WHERE r = 1")
def _(spark, d):
    return summaries.modal_value(read(spark, d, "part"), ["p_brand"], "p_type")


@query("x25_missing", "WITH t(category, target) AS (VALUES ('1-URGENT', 3000), ('2-HIGH', 10), ('6-NEW', 7)), h AS (SELECT o_orderpriority, count(*) AS c FROM orders GROUP BY 1) SELECT category, target, coalesce(c, 0) AS have, greatest(target - coalesce(c, 0), 0)::BIGINT AS missing FROM t LEFT JOIN h ON o_orderpriority = category")
def _(spark, d):
    return summaries.missing_against_targets(read(spark, d, "orders"), "o_orderpriority", {"1-URGENT": 3000, "2-HIGH": 10, "6-NEW": 7})


@query("x26_thin_cells", f"WITH {ITEMS}, c AS (SELECT category, graph, count(*) AS n FROM items GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY category) AS share, CASE graph WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.3 ELSE 0.5 END AS quota FROM c) SELECT category, graph, n, round(share, 9) AS share, quota::DOUBLE AS quota FROM s WHERE share < quota / 2")
def _(spark, d):
    return summaries.thin_cells(items(spark, d), ["category"], "graph", {"F": 0.9, "O": 0.3, "P": 0.5}).select("category", "graph", "n", F.round("share", 9).alias("share"), "quota")


@query("x27_go_no_go", "SELECT 'rows' AS \"check\", count(*)::DOUBLE AS value, count(*) >= 100 AS passed FROM orders UNION ALL SELECT 'open_share', round(avg((o_orderstatus = 'O')::INT), 9), round(avg((o_orderstatus = 'O')::INT), 9) <= 0.2 FROM orders")
def _(spark, d):
    return summaries.checks(read(spark, d, "orders"), {"rows": (F.count(F.lit(1)), ">=", 100), "open_share": (F.round(F.avg((F.col("o_orderstatus") == "O").cast("double")), 9), "<=", 0.2)})


# -- joins


@query("j01_join_predictions", "SELECT id, known FROM (SELECT event_id AS id, o_orderkey IS NOT NULL AS known FROM events LEFT JOIN orders ON o_orderkey = event_id)")
def _(spark, d):
    predictions = read(spark, d, "events").select(F.col("event_id").alias("id"))
    joined, unknown = joins.join_predictions(predictions, items(spark, d))
    return joined.select("id", F.lit(True).alias("known")).unionByName(unknown.select("id", F.lit(False).alias("known")))


@query("j02_paired", f"WITH {EVALS}, a AS (SELECT item, value AS a FROM ev WHERE model = 1 AND category <> 'click'), b AS (SELECT item, value AS b FROM ev WHERE model = 2 AND category <> 'view') SELECT coalesce(a.item, b.item) AS item, a, b, CASE WHEN a.item IS NULL THEN 'only_b' WHEN b.item IS NULL THEN 'only_a' ELSE 'paired' END AS status FROM a FULL JOIN b ON a.item = b.item")
def _(spark, d):
    e = evaluations(spark, d)
    return joins.paired(e.filter("model = 1 AND category <> 'click'"), e.filter("model = 2 AND category <> 'view'"), "value", "item")


@query("j03_overlap", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) || c_nationkey::VARCHAR IN (SELECT lower(c_mktsegment) || c_nationkey::VARCHAR FROM customer WHERE c_acctbal > 9500)")
def _(spark, d):
    c = read(spark, d, "customer")
    return joins.overlapping(c, c.filter("c_acctbal > 9500"), F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))).select("c_custkey")


@query("j04_flag", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1) AS upstream FROM part")
def _(spark, d):
    other = read(spark, d, "lineitem").filter("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_partkey").alias("p_partkey"))
    return joins.flagged(read(spark, d, "part"), other, "p_partkey", "upstream").select("p_partkey", "upstream")


@query("j05_few_shot", "WITH n AS (SELECT n_nationkey AS id, n_regionkey AS g, n_nationkey % 2 AS c FROM nation) SELECT id, shot, rank::INT AS rank FROM (SELECT a.id, b.id AS shot, row_number() OVER (PARTITION BY a.id ORDER BY (a.c <> b.c)::INT, b.id) AS rank FROM n a JOIN n b ON a.g = b.g AND a.id <> b.id) WHERE rank <= 2")
def _(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("g"), (F.col("n_nationkey") % 2).alias("c"))
    return joins.few_shot(n, n, "g", "c", 2)


@query("j06_cosine_neighbours", """WITH r AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark), t AS (SELECT id, unnest(w) AS t FROM r), b AS (SELECT id, t, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1),
s AS (SELECT x.id, y.id AS other, round(sum(x.n * y.n) / (any_value(mx.norm) * any_value(my.norm)), 9) AS similarity FROM b x JOIN b y ON x.t = y.t AND x.id <> y.id JOIN m mx ON mx.id = x.id JOIN m my ON my.id = y.id GROUP BY ALL),
a AS (SELECT x.id, y.id AS other, coalesce(s.similarity, 0)::DOUBLE AS similarity FROM r x JOIN r y ON x.id <> y.id LEFT JOIN s ON s.id = x.id AND s.other = y.id)
SELECT id, other, similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM a WHERE similarity < 0.995) WHERE rank <= 3""")
def _(spark, d):
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.tokenize(F.col("text")).alias("t"))
    return joins.cosine_neighbours(b, "t", 3).select("id", "other", "similarity", "rank")


@query("j07_judge_pairs", f"WITH {EVALS} SELECT x.model AS a, y.model AS b, count(*) AS items, round(avg((x.solved = y.solved)::INT), 9) AS agree FROM ev x JOIN ev y ON x.item = y.item AND x.model < y.model GROUP BY ALL")
def _(spark, d):
    return joins.judge_pairs(evaluations(spark, d), "model", "item", "solved").withColumn("agree", F.round("agree", 9))


@query("j09_solve_rates", f"WITH {EVALS} SELECT item, count(*) AS evaluated, count(*) FILTER (solved) AS solved, count(*) FILTER (solved) / count(*) AS rate, count(*) = 10 AS complete FROM ev GROUP BY 1")
def _(spark, d):
    return joins.solve_rates(evaluations(spark, d), "item", "solved", 10)


@query("j10_gold_status", "SELECT o_orderkey AS id, CASE WHEN c IS NULL THEN 'not_audited' WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN c < 2 THEN 'empty' ELSE 'ok' END AS gold_status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    audits = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("c")).select("id", (F.col("id") % 3 != 0).alias("success"), F.when(F.col("c") < 2, 0).otherwise(F.col("c")).alias("rows"))
    return joins.audit_status(items(spark, d), audits, "id", "success", "rows").select("id", "gold_status")


@query("j11_atom_impact", "WITH c(atom, k, o, p) AS (VALUES ('label:Brand#11', 'label', '', 'Brand#11'), ('prop:*.size', 'prop', '*', 'size'), ('prop:PROMO.price', 'prop', 'PROMO', 'price')), i AS (SELECT p_partkey AS id, 'label' AS k, '' AS o, p_brand AS p FROM part UNION ALL SELECT p_partkey, 'prop', p_type, CASE WHEN p_size < 25 THEN 'size' ELSE 'price' END FROM part) SELECT DISTINCT id, atom FROM i JOIN c ON i.k = c.k AND i.p = c.p AND (i.o = c.o OR c.o = '*')")
def _(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("label:"), "p_brand"), F.concat(F.lit("prop:"), F.col("p_type"), F.when(F.col("p_size") < 25, ".size").otherwise(".price"))).alias("atoms"))
    changed = spark.createDataFrame([("label:Brand#11",), ("prop:*.size",), ("prop:PROMO.price",)], "atom string")
    return joins.atom_impact(p, changed, "id", "atoms")


@query("j12_stale_accuracy", f"WITH {EVALS}, s AS (SELECT item, solved AS s FROM ev WHERE model = 3), f AS (SELECT item, solved AS f FROM ev WHERE model = 4 AND category <> 'click') SELECT count(*) FILTER (s AND coalesce(f, false)) AS both, count(*) FILTER (s AND NOT coalesce(f, false)) AS only_stale, count(*) FILTER (NOT s AND coalesce(f, false)) AS only_fresh, count(*) FILTER (NOT s AND NOT coalesce(f, false)) AS neither, round(100 * (avg(s::INT) - avg(coalesce(f, false)::INT)), 6) AS misestimate_pp FROM s LEFT JOIN f USING (item)")
def _(spark, d):
    e = evaluations(spark, d)
    return joins.stale_accuracy(e.filter("model = 3"), e.filter("model = 4 AND category <> 'click'"), "solved", "item")


@query("j13_subset_accuracy", f"WITH {EVALS} SELECT 'clicks' AS subset, model, count(*) AS n, round(avg(solved::INT), 9) AS accuracy FROM ev WHERE category = 'click' GROUP BY model UNION ALL SELECT 'low', model, count(*), round(avg(solved::INT), 9) FROM ev WHERE value < 50 GROUP BY model")
def _(spark, d):
    e = evaluations(spark, d)
    return joins.subset_accuracy(e, {"clicks": e.filter("category = 'click'").select("id"), "low": e.filter("value < 50").select("id")}, "model", "solved")


@query("j14_corrected", "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS graph, o_totalprice > 300000 AS was_corrected FROM orders")
def _(spark, d):
    rows = items(spark, d)
    return joins.corrected(rows, rows.filter("price > 300000").select("id", F.lit("X").alias("graph")), "graph").select("id", "graph", "was_corrected")


@query("j15_drift", "SELECT k, 'missing' AS side FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) WHERE k NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT k, 'extra' FROM (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) WHERE k NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def _(spark, d):
    return joins.drift(read(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), read(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), ["k"])


@query("x08_cluster_keys", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN 'gold:' || o_orderstatus WHEN o_orderpriority <> '5-LOW' THEN 'template:' || o_orderpriority ELSE 'id:' || o_orderkey::VARCHAR END AS cluster, CASE WHEN o_orderstatus <> 'P' THEN 'gold' WHEN o_orderpriority <> '5-LOW' THEN 'template' ELSE 'singleton' END AS cluster_source FROM orders")
def _(spark, d):
    rows = items(spark, d).withColumn("gold", F.nullif("graph", F.lit("P"))).withColumn("template", F.nullif("category", F.lit("5-LOW")))
    return joins.cluster_keys(rows, ["gold", "template"]).select("id", "cluster", "cluster_source")


@query("x12_disagreements", f"WITH {EVALS} SELECT item, count(*) AS votes, count(*) FILTER (solved) AS \"for\" FROM ev GROUP BY 1 HAVING count(*) FILTER (solved) BETWEEN 1 AND count(*) - 1")
def _(spark, d):
    return joins.disagreements(evaluations(spark, d), "item", "solved")


@query("x24_unseen", "SELECT c_custkey FROM customer WHERE (c_nationkey, c_mktsegment) NOT IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_acctbal < 0)")
def _(spark, d):
    c = read(spark, d, "customer")
    return joins.unseen(c, c.filter("c_acctbal < 0"), ["c_nationkey", "c_mktsegment"]).select("c_custkey")


# -- texts


@query("f07_tokenize", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::INT AS tokens FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(text.tokenize(F.coalesce("text", F.lit("")))).alias("tokens"))


@query("f08_normalize_answer", "SELECT item_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[[:punct:]]', ' ', 'g')), '\\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ') AS answer FROM benchmark")
def _(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.normalize_answer(F.col("text")).alias("answer"))


@query("f09_ngrams", f"WITH {PAIRS} SELECT id, {grams_sql('p', 3)} AS grams FROM pr")
def _(spark, d):
    return pairs(spark, d).select("id", text.ngrams(F.col("p"), 3).alias("grams"))


def _rouge_sql(n: int) -> str:
    return f"SELECT id, {n} AS n, round(CASE WHEN o = 0 THEN 0 ELSE 2.0 * o / (len(a) + len(b)) END, 9)::DOUBLE AS f1 FROM (SELECT id, a, b, {overlap_sql('a', 'b')} AS o FROM (SELECT id, {grams_sql('p', n)} AS a, {grams_sql('r', n)} AS b FROM pr))"


@query("f11_rouge", f"WITH {PAIRS} {_rouge_sql(1)} UNION ALL {_rouge_sql(2)}")
def _(spark, d):
    one = lambda n: pairs(spark, d).select("id", F.lit(n).alias("n"), F.round(text.rouge_n(F.col("p"), F.col("r"), n)["f1"], 9).alias("f1"))
    return one(1).unionByName(one(2))


#: The longest common subsequence by rows of its table: tokens as numbers in lists of one, so that one fold carries the row.
LCS = """list_reduce(list_prepend(list_transform(range(0, len(r) + 1), lambda i: 0::BIGINT), list_transform(p, lambda x: [list_position(u, x)::BIGINT])),
  lambda row, x: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(r) + 1), lambda j: [j])), lambda acc, j: list_append(acc, CASE WHEN list_position(u, r[j[1]]) = x[1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], acc[j[1]]) END)))[len(r) + 1]"""


@query("f12_rouge_l", f"WITH {PAIRS}, v AS (SELECT *, list_distinct(list_concat(p, r)) AS u FROM pr) SELECT id, round(CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = len(r))::INT ELSE 2.0 * {LCS} / (len(p) + len(r)) END, 9)::DOUBLE AS rouge_l FROM v")
def _(spark, d):
    return pairs(spark, d).select("id", F.round(text.rouge_l_f1(F.col("p"), F.col("r")), 9).alias("rouge_l"))


@query("f13_bleu", f"WITH {PAIRS}, g AS (SELECT id, p, r, " + ", ".join(f"{grams_sql('p', n)} AS a{n}, {grams_sql('r', n)} AS b{n}" for n in range(1, 5)) + " FROM pr) SELECT id, round(CASE WHEN len(list_intersect(p, r)) = 0 THEN 0 ELSE (CASE WHEN len(p) < len(r) THEN exp(1 - len(r) / len(p)) ELSE 1 END) * exp((" + " + ".join(f"CASE WHEN len(p) >= {n} THEN ln(({overlap_sql(f'a{n}', f'b{n}')} + 1) / (len(a{n}) + 1)) ELSE 0 END" for n in range(1, 5)) + ") / least(4, len(p))) END, 9)::DOUBLE AS bleu FROM g")
def _(spark, d):
    return pairs(spark, d).select("id", F.round(text.bleu(F.col("p"), F.col("r")), 9).alias("bleu"))


#: The k-th use of a word meets its k-th use in the other text; a chunk ends where either text's next place isn't the following.
@query("f14_meteor", f"WITH {PAIRS}, a AS (SELECT id, i, w, row_number() OVER (PARTITION BY id, w ORDER BY i) AS k FROM (SELECT id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM pr)), b AS (SELECT id, i, w, row_number() OVER (PARTITION BY id, w ORDER BY i) AS k FROM (SELECT id, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM pr)), m AS (SELECT a.id, a.i, b.i AS j FROM a JOIN b USING (id, w, k)), c AS (SELECT id, count(*) AS m, count(*) FILTER (pi IS NULL OR i <> pi + 1 OR j <> pj + 1) AS chunks FROM (SELECT *, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM m WINDOW w AS (PARTITION BY id ORDER BY i)) GROUP BY 1) SELECT id, round(CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = len(r))::INT WHEN m IS NULL THEN 0 ELSE (1 - 0.5 * pow(chunks / m, 3)) * 10 * (m / len(p)) * (m / len(r)) / (m / len(r) + 9 * (m / len(p))) END, 9)::DOUBLE AS meteor FROM pr LEFT JOIN c USING (id)")
def _(spark, d):
    return pairs(spark, d).select("id", F.round(text.meteor(F.col("p"), F.col("r")), 9).alias("meteor"))


@query("f15_bag_cosine", f"WITH {PAIRS} SELECT id, round(list_sum(list_transform(list_distinct(p), lambda g: len(list_filter(p, lambda x: x = g)) * len(list_filter(r, lambda x: x = g)))) / (sqrt(list_sum(list_transform(list_distinct(p), lambda g: pow(len(list_filter(p, lambda x: x = g)), 2)))) * sqrt(list_sum(list_transform(list_distinct(r), lambda g: pow(len(list_filter(r, lambda x: x = g)), 2))))), 9)::DOUBLE AS cosine FROM pr")
def _(spark, d):
    return pairs(spark, d).select("id", F.round(text.bag_cosine(F.col("p"), F.col("r")), 9).alias("cosine"))


@query("f16_jaro_winkler", "WITH n AS (SELECT n_nationkey, n_name, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey), j AS (SELECT n_nationkey, n_name, c_name, jaro_similarity(n_name, c_name) AS j, CASE WHEN n_name[1] <> c_name[1] THEN 0 WHEN n_name[2] <> c_name[2] THEN 1 WHEN n_name[3] <> c_name[3] THEN 2 WHEN n_name[4] <> c_name[4] THEN 3 ELSE 4 END AS p FROM n) SELECT n_name, c_name, round(j + 0.1 * p * (1 - j), 9)::DOUBLE AS jw FROM j")
def _(spark, d):
    rows = read(spark, d, "nation").join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("n_name", "c_name", F.round(text.jaro_winkler(F.col("n_name"), F.col("c_name")), 9).alias("jw"))


@query("f17_gleu", f"WITH {PAIRS}, g AS (SELECT id, " + ", ".join(f"{grams_sql('p', n)} AS a{n}, {grams_sql('r', n)} AS b{n}" for n in range(1, 5)) + " FROM pr) SELECT id, round(least((" + " + ".join(overlap_sql(f"a{n}", f"b{n}") for n in range(1, 5)) + ") / (len(a1) + len(a2) + len(a3) + len(a4)), (" + " + ".join(overlap_sql(f"a{n}", f"b{n}") for n in range(1, 5)) + ") / (len(b1) + len(b2) + len(b3) + len(b4))), 9)::DOUBLE AS gleu FROM g")
def _(spark, d):
    return pairs(spark, d).select("id", F.round(text.gleu(F.col("p"), F.col("r")), 9).alias("gleu"))


@query("f18_jaccard", f"WITH {PAIRS} SELECT id, round(len(list_intersect(p, r)) / len(list_distinct(list_concat(p, r))), 9)::DOUBLE AS jaccard FROM pr")
def _(spark, d):
    return pairs(spark, d).select("id", F.round(text.jaccard(F.col("p"), F.col("r")), 9).alias("jaccard"))


@query("f19_distinct_n", f"WITH {PAIRS}, g AS (SELECT unnest({grams_sql('p', 2)}) AS g FROM pr) SELECT count(*) AS total, count(DISTINCT g) AS distinct_grams, round(count(DISTINCT g) / count(*), 9) AS ratio FROM g")
def _(spark, d):
    grams = pairs(spark, d).select(F.explode(text.ngrams(F.col("p"), 2)).alias("g"))
    return grams.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("g").alias("distinct_grams")).withColumn("ratio", F.round(F.col("distinct_grams") / F.col("total"), 9))


def cypher_texts(spark: SparkSession, d: str) -> DataFrame:
    """One query text for each part."""
    p = spread(read(spark, d, "part"), "p_partkey")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("MATCH (p:Part {brand: '"), "p_brand", F.lit("'})-[r:SOLD]->(c)  WHERE p.size > "), F.col("p_size").cast("string"), F.lit(" RETURN p.name, c.Price LIMIT 10")).alias("cypher"))


CYPHERS = "cy AS (SELECT p_partkey AS id, 'MATCH (p:Part {brand: ''' || p_brand || '''})-[r:SOLD]->(c)  WHERE p.size > ' || p_size::VARCHAR || ' RETURN p.name, c.Price LIMIT 10' AS cypher FROM part)"


@query("f21_query_signature", f"WITH {CYPHERS} SELECT id, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(cypher, '''[^'']*''', '<str>', 'g'), '\\b\\d+(\\.\\d+)?\\b', '<num>', 'g'), '\\(([A-Za-z_][A-Za-z0-9_]*)\\s*:', '(<var>:', 'g'), '\\b[A-Za-z_][A-Za-z0-9_]*\\.', '<var>.', 'g')), '\\s+', ' ', 'g')) AS signature FROM cy")
def _(spark, d):
    return cypher_texts(spark, d).select("id", text.query_signature(F.col("cypher")).alias("signature"))


@query("f23_question_key", "SELECT item_id, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[?.!\\s]+$', '') AS key FROM benchmark")
def _(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.question_key(F.col("text")).alias("key"))


@query("f24_content_id", """SELECT c_custkey, 'pc_' || substr(sha256('{"category": "' || c_mktsegment || '", "cypher": "", "graph_profile": "g \\u00e9", "question": "' || c_name || '"}'), 1, 16) AS cid FROM customer""")
def _(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.content_id({"question": F.col("c_name"), "category": F.col("c_mktsegment"), "graph_profile": F.lit("g é"), "cypher": F.lit(None).cast("string")}).alias("cid"))


@query("f27_redact", "SELECT c_custkey, replace(c_name || ' in ' || c_mktsegment, c_mktsegment, '<v_' || substr(sha256('salt' || c_mktsegment), 1, 10) || '>') AS question FROM customer")
def _(spark, d):
    c = read(spark, d, "customer")
    return c.select("c_custkey", privacy.redact_values(F.concat("c_name", F.lit(" in "), "c_mktsegment"), F.array("c_mktsegment"), "salt").alias("question"))


@query("f28_residual", "SELECT c_custkey, list_filter([c_mktsegment, c_name], lambda v: contains('BUILDING ' || c_name, v)) AS found FROM customer")
def _(spark, d):
    c = read(spark, d, "customer")
    return c.select("c_custkey", privacy.residual_values(F.concat(F.lit("BUILDING "), "c_name"), F.array("c_mktsegment", "c_name")).alias("found"))


@query("f32_clean_query", f"WITH {CYPHERS} SELECT id, trim(regexp_replace(cypher, '\\s+', ' ', 'g')) AS cleaned FROM cy")
def _(spark, d):
    wrapped = F.concat(F.lit("<|im|>```cypher\n"), "cypher", F.lit("; MATCH (x) RETURN x```</s>"))
    return cypher_texts(spark, d).select("id", text.clean_query(wrapped).alias("cleaned"))


@query("f34_panel", f"WITH {EVALS} SELECT item, bool_and(solved) AS passed, max(value) AS ambiguity, min(value) AS alignment, count(*) AS judges FROM ev GROUP BY 1")
def _(spark, d):
    return statistics.panel_verdict(evaluations(spark, d), "item", "solved", "value", "value")


@query("f35_wilson", f"WITH {EVALS}, k AS (SELECT model, count(*) FILTER (solved) AS k, count(*) AS n FROM ev GROUP BY 1), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, k / n AS p FROM k) SELECT model, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM z")
def _(spark, d):
    k = evaluations(spark, d).groupBy("model").agg(F.count_if(F.col("solved")).alias("k"), F.count(F.lit(1)).alias("n"))
    return k.select("model", statistics.wilson(F.col("k"), F.col("n")).alias("w")).select("model", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


# -- scores and statistics


@query("t01_answer_sets", "WITH s AS (SELECT n_nationkey, (SELECT list(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 8000) AS p, (SELECT list(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS g FROM nation), l AS (SELECT n_nationkey, coalesce(p, []) AS p, coalesce(g, []) AS g FROM s), o AS (SELECT *, len(list_intersect(p, g)) AS o FROM l) SELECT n_nationkey, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 OR o = 0 THEN 0.0 ELSE round(2 * (o / len(p)) * (o / len(g)) / (o / len(p) + o / len(g)), 9) END::DOUBLE AS f1, len(p) = o AND len(g) = o AS exact FROM o")
def _(spark, d):
    c = read(spark, d, "customer")
    collected = c.groupBy("c_nationkey").agg(F.collect_set(F.when(F.col("c_acctbal") > 8000, F.col("c_mktsegment"))).alias("p"), F.collect_set(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))).alias("g"))
    empty = F.array().cast("array<string>")
    rows = read(spark, d, "nation").join(collected, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", statistics.set_scores(F.coalesce("p", empty), F.coalesce("g", empty)).alias("s"))
    return rows.select("n_nationkey", F.round("s.f1", 9).alias("f1"), "s.exact")


@query("t03_compare_answers", "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'), u AS (SELECT a.o_custkey IS NOT NULL AS x, b.o_custkey IS NOT NULL AS y FROM a FULL JOIN b USING (o_custkey)) SELECT bool_and(x AND y) AS equal, count(*) FILTER (x AND y) / count(*) AS jaccard, count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (y AND NOT x) AS b_only FROM u")
def _(spark, d):
    o = read(spark, d, "orders")
    return statistics.compare_answers(o.filter("o_orderstatus = 'P'").select("o_custkey"), o.filter("o_orderpriority = '5-LOW'").select("o_custkey"))


def poisson_sql() -> str:
    """A Poisson weight of mean 1 from u in [0, 1)."""
    return " + ".join(f"(u >= {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r}::DOUBLE)::INT" for k in range(8))


def word_sql(digest: str, j: str) -> str:
    """The j-th 32 bits of a sha256 in hex."""
    return f"('0x' || substr({digest}, 8 * ({j}) + 1, 8))::BIGINT"


def draws_sql(name: str, units: str, seed: str, cell: str = "") -> str:
    """(units, rep, w) of the table ``units`` with a column bucket: Poisson weights; ``cell``: SQL of the text of its other keys with colons behind them."""
    return f"""{name} AS (SELECT * EXCLUDE (d, u), {poisson_sql()} AS w FROM (SELECT *, {word_sql("d", "(rep - 1) % 8")} / 4294967296.0 AS u FROM (SELECT k.*, rep, sha256('{seed}:' || ((rep - 1) // 8)::VARCHAR || ':' || {cell} bucket::VARCHAR) AS d FROM {units} k, (SELECT unnest(range(1, 2001)) AS rep))))"""


def bucket_sql(key: str, seed: str) -> str:
    return f"('0x' || substr(sha256('{seed}:' || {key}::VARCHAR), 1, 3))::INT"


def boot_sql(sums: str, cell: str = "", seed: str = "boot") -> str:
    """Common table expressions of the cluster bootstrap over ``sums`` (g, key, total, n): p has the means, b the bounds."""
    return f"""s AS MATERIALIZED ({sums}), k AS MATERIALIZED (SELECT g, {bucket_sql("key", seed)} AS bucket, sum(total) AS total, sum(n) AS n FROM s GROUP BY ALL),
{draws_sql("w", "k", seed, cell)}, m AS (SELECT g, rep, sum(w * total) / sum(w * n) AS m FROM w GROUP BY ALL),
b AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1), p AS (SELECT g, sum(total) / sum(n) AS mean, count(*) AS clusters FROM s GROUP BY 1)"""


def unit_boot_sql(sums: str, replicates: int = 2000) -> str:
    """As ``boot_sql``, with a weight for each unit and replicate."""
    return f"""k AS MATERIALIZED ({sums}), r AS (SELECT unnest(range(1, {replicates + 1})) AS rep), u AS (SELECT k.*, rep, ('0x' || substr(sha256('boot:' || rep::VARCHAR || ':' || key::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM k, r),
w AS (SELECT g, rep, total, n, {poisson_sql()} AS w FROM u), m AS (SELECT g, rep, sum(w * total) / sum(w * n) AS m FROM w GROUP BY ALL),
b AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1), p AS (SELECT g, sum(total) / sum(n) AS mean, count(*) AS clusters FROM k GROUP BY 1)"""


@query("t03_ordered_equal", "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_custkey AS c FROM orders WHERE o_orderstatus <> 'P'), s AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, CASE WHEN o_orderkey % 997 = 996 THEN o_custkey + 1 ELSE o_custkey END AS c FROM orders WHERE o_orderstatus <> 'P'), t AS (SELECT * FROM o WHERE i <= (SELECT count(*) FROM o) - 3), x AS (SELECT 'same' AS answer, a.i, a.c IS NOT DISTINCT FROM b.c AND a.i = b.i AS eq FROM o a FULL JOIN o b USING (i) UNION ALL SELECT 'changed', coalesce(a.i, b.i), a.c IS NOT DISTINCT FROM b.c AND a.i IS NOT NULL AND b.i IS NOT NULL FROM o a FULL JOIN s b USING (i) UNION ALL SELECT 'truncated', coalesce(a.i, b.i), a.c IS NOT DISTINCT FROM b.c AND a.i IS NOT NULL AND b.i IS NOT NULL FROM o a FULL JOIN t b ON a.i = b.i) SELECT answer, bool_and(eq) AS ordered_equal, coalesce(min(i) FILTER (NOT eq) - 1, count(*))::BIGINT AS equal_prefix FROM x GROUP BY 1")
def _(spark, d):
    """An answer against itself, against one with other values in some places, and against its own beginning."""
    o = read(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    changed = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 997 == 996, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    last = [r[0] for r in o.orderBy(F.desc("o_orderkey")).limit(3).select("o_orderkey").collect()]
    answers = {"same": o, "changed": changed, "truncated": o.filter(F.col("o_orderkey") < min(last))}
    parts = [statistics.ordered_equal(o, other, ["o_orderkey"]).select(F.lit(name).alias("answer"), "*") for name, other in answers.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("t05_row_bootstrap", f"WITH {EVALS}, {unit_boot_sql('SELECT category AS g, id AS key, solved::INT::DOUBLE AS total, 1 AS n FROM ev')} SELECT g AS category, clusters, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM p JOIN b USING (g)")
def _(spark, d):
    out = statistics.cluster_bootstrap(evaluations(spark, d), "id", "solved", ["category"])
    return out.select("category", "clusters", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("t06_cluster_bootstrap", f"WITH {EVALS}, {unit_boot_sql('SELECT 0 AS g, cluster AS key, sum(solved::INT)::DOUBLE AS total, count(*) AS n FROM ev GROUP BY ALL')} SELECT clusters, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM p JOIN b USING (g)")
def _(spark, d):
    out = statistics.cluster_bootstrap(evaluations(spark, d), "cluster", "solved")
    return out.select("clusters", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("t07_sign_flip", "WITH c AS (SELECT n_regionkey * 2 + (n_nationkey % 2) AS k, sum(c_acctbal - 4600) AS s FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), i AS (SELECT s, row_number() OVER (ORDER BY k) - 1 AS i FROM c), m AS (SELECT m, sum(CASE WHEN (m >> i) & 1 = 1 THEN s ELSE -s END) AS v FROM range(0, 1024) t(m), i GROUP BY m) SELECT 10::BIGINT AS clusters, round((SELECT sum(s) FROM i), 4) AS observed, avg((round(abs(v), 6) >= round(abs((SELECT sum(s) FROM i)), 6))::INT) AS p FROM m")
def _(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select((F.col("n_regionkey") * 2 + F.col("n_nationkey") % 2).alias("k"), (F.col("c_acctbal") - 4600).alias("d"))
    return statistics.sign_flip(rows, "k", "d").select("clusters", F.round("observed", 4).alias("observed"), "p")


@query("t08_mcnemar", f"WITH {EVALS}, a AS (SELECT item, solved AS a FROM ev WHERE model = 1), b AS (SELECT item, solved AS b FROM ev WHERE model = 2) SELECT count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only FROM a JOIN b USING (item)")
def _(spark, d):
    e = evaluations(spark, d)
    both = joins.paired(e.filter("model = 1"), e.filter("model = 2"), "solved", "item").filter("status = 'paired'")
    return both.agg(F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(F.col("b") & ~F.col("a")).alias("b_only"))


@query("t09_kendall_tau_b", "WITH n AS (SELECT n_nationkey AS i, avg(c_acctbal) AS x, count(*)::DOUBLE AS y FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), p AS (SELECT sign(a.x - b.x) AS sa, sign(a.y - b.y) AS sb FROM n a JOIN n b ON a.i < b.i) SELECT count(*) AS pairs, count(*) FILTER (sa * sb > 0) AS concordant, count(*) FILTER (sa * sb < 0) AS discordant, round((count(*) FILTER (sa * sb > 0) - count(*) FILTER (sa * sb < 0)) / sqrt(count(*) FILTER (sa <> 0) * count(*) FILTER (sb <> 0)), 9) AS tau_b FROM p")
def _(spark, d):
    n = read(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return statistics.kendall_tau_b(n, "c_nationkey", "x", "y").withColumn("tau_b", F.round("tau_b", 9))


@query("t09_kendall_rows", "WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*)::HUGEINT AS n FROM lineitem GROUP BY ALL), p AS (SELECT sum(a.n * b.n) FILTER (sign(a.x - b.x) * sign(a.y - b.y) > 0) AS up, sum(a.n * b.n) FILTER (sign(a.x - b.x) * sign(a.y - b.y) < 0) AS down, sum(a.n * b.n) FILTER (a.x <> b.x) AS ua, sum(a.n * b.n) FILTER (a.y <> b.y) AS ub FROM c a, c b) SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM lineitem)::BIGINT AS pairs, (up // 2)::BIGINT AS concordant, (down // 2)::BIGINT AS discordant, round((up // 2 - down // 2) / sqrt((ua // 2)::DOUBLE * (ub // 2)::DOUBLE), 9) AS tau_b FROM p")
def _(spark, d):
    """All rows of the largest table, with many ties."""
    out = statistics.kendall_tau_b(read(spark, d, "lineitem"), "l_orderkey", "l_quantity", "l_discount")
    return out.withColumn("tau_b", F.round("tau_b", 9))


@query("t09_kendall_prices", "WITH o AS (SELECT o_orderkey AS i, o_totalprice AS x, o_custkey AS y FROM orders), p AS (SELECT sign(a.x - b.x) AS sa, sign(a.y - b.y) AS sb FROM o a JOIN o b ON a.i < b.i) SELECT count(*) AS pairs, count(*) FILTER (sa * sb > 0) AS concordant, count(*) FILTER (sa * sb < 0) AS discordant, round((count(*) FILTER (sa * sb > 0) - count(*) FILTER (sa * sb < 0)) / sqrt((count(*) FILTER (sa <> 0))::DOUBLE * count(*) FILTER (sb <> 0)), 9) AS tau_b FROM p")
def _(spark, d):
    """Nearly all values differ."""
    out = statistics.kendall_tau_b(read(spark, d, "orders"), "o_orderkey", "o_totalprice", "o_custkey")
    return out.withColumn("tau_b", F.round("tau_b", 9))


@query("t09_spearman", "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part) SELECT p_brand, count(*) AS n, round(corr(a, b), 9) AS rho FROM r GROUP BY 1")
def _(spark, d):
    return statistics.spearman(read(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("s"), "p_retailprice"), "s", "p_retailprice", ["p_brand"]).withColumn("rho", F.round("rho", 9))


@query("t12_total_variation", "WITH a AS (SELECT o_orderpriority AS k, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) / sum(count(*)) OVER () AS q FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) AS distance FROM a FULL JOIN b USING (k)")
def _(spark, d):
    rows = items(spark, d)
    return statistics.total_variation(rows.filter("graph = 'F'"), rows.filter("graph = 'P'"), "category").select(F.round("distance", 9).alias("distance"))


@query("t13_agreement", "WITH x AS (SELECT lang, quality = 1 AS a, toxic = 1 AS b FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) AS n, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, count(*) FILTER (NOT a AND NOT b) AS tn FROM x GROUP BY 1), q AS (SELECT *, (tp + tn) / n AS po, (tp + a_only) / n AS pa, (tp + b_only) / n AS pb FROM c) SELECT lang, n, round(po, 9) AS observed, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa, round((po - 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2)) / (1 - 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2)), 9) AS ac1 FROM q")
def _(spark, d):
    out = statistics.agreement(labels(spark, d), "quality", "toxic", ["lang"])
    return out.select("lang", "n", F.round("observed", 9).alias("observed"), F.round("kappa", 9).alias("kappa"), F.round("ac1", 9).alias("ac1"))


@query("t13_fleiss", f"WITH {EVALS}, c AS (SELECT item, solved, count(*) AS c FROM ev GROUP BY ALL), i AS (SELECT item, sum(c) AS n, sum(c * c) AS s FROM c GROUP BY 1), l AS (SELECT solved, sum(c) AS c FROM c GROUP BY 1), e AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS pe FROM l) SELECT count(*) AS items, max(n)::BIGINT AS raters, round((avg((s - n) / (n * (n - 1))) - any_value(pe)) / (1 - any_value(pe)), 9) AS kappa FROM i, e")
def _(spark, d):
    return statistics.fleiss_kappa(evaluations(spark, d), "item", "solved").withColumn("kappa", F.round("kappa", 9))


@query("t14_precision_recall", f"WITH {EVALS}, c AS (SELECT category, count(*) AS n, count(*) FILTER (solved AND model < 5) AS tp, count(*) FILTER (solved AND model >= 5) AS fp, count(*) FILTER (NOT solved AND model < 5) AS fn, count(*) FILTER (NOT solved AND model >= 5) AS tn FROM ev GROUP BY 1) SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round((tp + tn) / n, 9) AS accuracy FROM c")
def _(spark, d):
    out = statistics.precision_recall(evaluations(spark, d).withColumn("low", F.col("model") < 5), "solved", "low", ["category"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "accuracy")})


@query("t15_weighted_rate", "SELECT c_mktsegment, count(*) AS n, round(sum((c_nationkey + 1) * (c_acctbal > 0)::INT) / sum(c_nationkey + 1), 9) AS rate FROM customer GROUP BY 1")
def _(spark, d):
    c = read(spark, d, "customer").withColumn("w", F.col("c_nationkey") + 1).withColumn("y", F.col("c_acctbal") > 0)
    return statistics.weighted_rate(c, "y", "w", ["c_mktsegment"]).withColumn("rate", F.round("rate", 9))


@query("t15_weighted_interval", f"WITH {boot_sql('SELECT c_mktsegment AS g, c_custkey AS key, ((c_nationkey + 1) * (c_acctbal > 0)::INT)::DOUBLE AS total, (c_nationkey + 1)::DOUBLE AS n FROM customer', "g || ':' ||", 'weighted')} SELECT g AS c_mktsegment, clusters AS n, round(mean, 9) AS rate, round(low, 9) AS low, round(high, 9) AS high FROM p JOIN b USING (g)")
def _(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 0).alias("y"), (F.col("c_nationkey") + 1).alias("w"))
    return statistics.weighted_interval(c, "c_custkey", "y", "w", ["c_mktsegment"]).select("c_mktsegment", "n", *[F.round(x, 9).alias(x) for x in ("rate", "low", "high")])


@query("t15_stratified_rate", "WITH s AS (SELECT c_mktsegment AS k, count(*) AS n, avg((c_acctbal > 0)::INT) AS p FROM customer WHERE c_nationkey < 8 GROUP BY 1), z AS (SELECT c_mktsegment AS k, count(*) AS size FROM customer GROUP BY 1) SELECT round(sum(size * p) / sum(size), 9) AS rate, round(sqrt(sum(size * size * (1 - n / size) * p * (1 - p) / (n - 1))) / sum(size), 9) AS se FROM s JOIN z USING (k)")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("k"), "c_nationkey", (F.col("c_acctbal") > 0).alias("y"))
    return statistics.stratified_rate(c.filter("c_nationkey < 8"), "y", "k", c.groupBy("k").agg(F.count(F.lit(1)).alias("size"))).select(F.round("rate", 9).alias("rate"), F.round("se", 9).alias("se"))


@query("t16_consensus", "WITH c AS (SELECT o_custkey, o_orderstatus AS l, count(*) AS c FROM orders GROUP BY ALL), g AS (SELECT o_custkey, sum(c) AS n, max(c) AS m, arg_max(l, (c, l)) AS top FROM c GROUP BY 1) SELECT o_custkey, CASE WHEN m * 2 > n THEN top END AS consensus, CASE WHEN m = n THEN 'unanimous' WHEN m * 2 > n THEN 'majority' ELSE 'none' END AS source FROM g")
def _(spark, d):
    return statistics.consensus(read(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("t17_auc", "WITH r AS (SELECT event_type, user_id % 2 = 0 AS y, rank() OVER (PARTITION BY event_type ORDER BY round(value, 12)) + (count(*) OVER (PARTITION BY event_type, round(value, 12)) - 1) / 2 AS r FROM events) SELECT event_type, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 9) AS auc FROM r GROUP BY 1")
def _(spark, d):
    e = read(spark, d, "events").withColumn("y", F.col("user_id") % 2 == 0)
    return statistics.auc(e, "value", "y", ["event_type"]).withColumn("auc", F.round("auc", 9))


@query("x07_run_validity", f"WITH {EVALS} SELECT count(*) AS rows, count(*) - count(DISTINCT id) AS duplicate_ids, round(avg((value < 1)::INT), 9) AS failure_rate, 0::BIGINT AS missing_metric, avg((value < 1)::INT) <= 0.01 AS valid FROM ev")
def _(spark, d):
    return statistics.run_validity(evaluations(spark, d).withColumn("failed", F.col("value") < 1), "id", "failed", "value").withColumn("failure_rate", F.round("failure_rate", 9))
