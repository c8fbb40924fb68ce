"""Graph queries in Cypher over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import table_graph
from .compiler import cypher

NEXT_SQL = "(SELECT * FROM (SELECT event_id AS a, user_id, ts AS ta, value AS va, lead(event_id) OVER w AS b, lead(ts) OVER w AS tb, lead(value) OVER w AS vb FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE b IS NOT NULL)"
TRADES_SQL = "(SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4)) DESC, 1, 2 LIMIT 40)"

#: name -> (Cypher, SQL, parameters)
GRAPH_QUERIES: dict[str, tuple] = {
    "s07_label_scan": ("MATCH (c:Customer {segment: 'BUILDING'}) RETURN c.custKey AS custKey, c.name AS name", "SELECT c_custkey AS \"custKey\", c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "s08_all_nodes": ("MATCH (n) RETURN labels(n) AS labels, COUNT(n) AS n", "SELECT [l] AS labels, n FROM (SELECT 'Region' AS l, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Event', count(*) FROM events)"),
    "g01_one_hop": ("MATCH (c:Customer {segment: 'MACHINERY'})-[:PLACED]->(o:Order) WHERE o.priority = '1-URGENT' RETURN c.custKey AS custKey, o.orderKey AS orderKey", "SELECT c_custkey AS \"custKey\", o_orderkey AS \"orderKey\" FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '1-URGENT'"),
    "g02_incoming": ("MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE c.acctBal > 9000 RETURN c.custKey AS custKey, o.orderKey AS orderKey", "SELECT c_custkey AS \"custKey\", o_orderkey AS \"orderKey\" FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000"),
    "g03_multi_hop": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region {name: 'ASIA'}) RETURN c.name AS customer, n.name AS nation", "SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "g04_comma_cycle": ("MATCH (c:Customer)-[:PLACED]->(o:Order)-[:FULFILLED_BY]->(s:Supplier), (c)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s) RETURN n.name AS nation, COUNT(*) AS matches, COUNT(DISTINCT c) AS customers", "SELECT n_name AS nation, count(*) AS matches, count(DISTINCT c_custkey) AS customers FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name"),
    "g05_several_matches": ("MATCH (c:Customer)-[:PLACED]->(o:Order {status: 'F'}) MATCH (c)-[:PLACED]->(p:Order {priority: '1-URGENT'}) RETURN COUNT(*) AS pairs, COUNT(DISTINCT c) AS customers", "SELECT count(*) AS pairs, count(DISTINCT a.o_custkey) AS customers FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_orderpriority = '1-URGENT'"),
    "g06_product": ("MATCH (r:Region), (n:Nation) WHERE n.name STARTS WITH 'NATION_1' OR n.nationKey < 3 RETURN r.name AS region, n.name AS nation ORDER BY region, nation LIMIT 20", "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE starts_with(n_name, 'NATION_1') OR n_nationkey < 3 ORDER BY 1, 2 LIMIT 20"),
    "g07_undirected": ("MATCH (a:Nation)-[:TRADES_WITH]-(b:Nation) RETURN a.name AS nation, COUNT(b) AS partners", f"SELECT n_name AS nation, count(*) AS partners FROM (SELECT a, b FROM {TRADES_SQL} UNION ALL SELECT b, a FROM {TRADES_SQL} WHERE a <> b) t JOIN nation ON n_nationkey = t.a GROUP BY n_nationkey, n_name"),
    "g08_alternation": ("MATCH (x)-[r:SUPPLIES|CONTAINS]->(p:Part {brand: 'Brand#11'}) RETURN type(r) AS kind, labels(x) AS labels, COUNT(*) AS n", "SELECT kind, labels, count(*) AS n FROM (SELECT 'SUPPLIES' AS kind, ['Supplier'] AS labels, l_partkey FROM lineitem UNION ALL SELECT 'CONTAINS', ['Order'], l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#11' GROUP BY ALL"),
    "g09_variable_length": ("MATCH (a:Event)-[:NEXT*1..3]->(b:Event) WHERE a.type = 'purchase' RETURN a.eventId AS start, COUNT(b) AS reached", f"WITH RECURSIVE n AS MATERIALIZED {NEXT_SQL}, p(a, b, d) AS (SELECT a, b, 1 FROM n UNION ALL SELECT p.a, n.b, d + 1 FROM p JOIN n ON n.a = p.b WHERE d < 3) SELECT p.a AS start, count(*) AS reached FROM p JOIN events ON event_id = p.a WHERE event_type = 'purchase' GROUP BY p.a"),
    "g09_distinct_ends": ("MATCH (a:Event)-[:NEXT*1..6]->(b:Event) WHERE a.type = 'purchase' RETURN DISTINCT b.eventId AS eventId", "SELECT event_id AS \"eventId\" FROM (SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS near FROM events) WHERE near = 1"),
    "g10_reachable": ("MATCH (a:Nation)-[:TRADES_WITH*0..]-(b:Nation) RETURN a.name AS nation, COUNT(DISTINCT b) AS reached", f"WITH RECURSIVE t AS MATERIALIZED {TRADES_SQL}, e AS (SELECT a, b FROM t UNION ALL SELECT b, a FROM t), w(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b) SELECT n_name AS nation, count(*) AS reached FROM w JOIN nation ON n_nationkey = w.a GROUP BY 1"),
    "g10_exists_reach": ("MATCH (a:Event) WHERE a.type = 'click' AND EXISTS { (a)-[:NEXT*1..4]->(:Event {type: 'purchase'}) } RETURN a.eventId AS eventId", "SELECT event_id AS \"eventId\" FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS near FROM events) WHERE near = 1 AND event_type = 'click'"),
    "g10_variable_undirected": ("MATCH (a:Nation {nationKey: 3})-[:TRADES_WITH*1..2]-(b:Nation) RETURN b.name AS nation, COUNT(*) AS trails", f"WITH t AS {TRADES_SQL}, e AS (SELECT a, b, a * 1000 + b AS i FROM t UNION ALL SELECT b, a, a * 1000 + b FROM t WHERE a <> b), p AS (SELECT b FROM e WHERE a = 3 UNION ALL SELECT y.b FROM e x JOIN e y ON x.b = y.a AND x.i <> y.i WHERE x.a = 3) SELECT n_name AS nation, count(*) AS trails FROM p JOIN nation ON n_nationkey = p.b GROUP BY n_nationkey, n_name"),
    "g11_shortest_path": ("MATCH p = shortestPath((a:Nation {nationKey: 3})-[:TRADES_WITH*..4]-(b:Nation)) RETURN b.name AS nation, length(p) AS hops", f"WITH RECURSIVE t AS MATERIALIZED {TRADES_SQL}, e AS (SELECT a, b FROM t UNION ALL SELECT b, a FROM t), w(b, d) AS (SELECT DISTINCT b, 1 FROM e WHERE a = 3 UNION SELECT e.b, d + 1 FROM w JOIN e ON e.a = w.b WHERE d < 4) SELECT n_name AS nation, min(d)::BIGINT AS hops FROM w JOIN nation ON n_nationkey = w.b WHERE w.b <> 3 GROUP BY n_nationkey, n_name"),
    "g11_both_ends": ("MATCH p = shortestPath((a:Event)-[:NEXT*..8]->(b:Event)) WHERE a.type = 'purchase' AND b.value > 100 RETURN a.eventId AS a, b.eventId AS b, length(p) AS hops", "WITH r AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT x.event_id AS a, y.event_id AS b, y.i - x.i AS hops FROM r x JOIN r y USING (user_id) WHERE x.event_type = 'purchase' AND y.value > 100 AND y.i BETWEEN x.i + 1 AND x.i + 8"),
    "g12_optional": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.priority = '1-URGENT' RETURN c.custKey AS custKey, COUNT(o) AS urgent", "SELECT c_custkey AS \"custKey\", count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey"),
    "g13_anti_pattern": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {priority: '1-URGENT'}) RETURN c.custKey AS custKey", "SELECT c_custkey AS \"custKey\" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "g14_not_exists": ("MATCH (o:Order) WHERE NOT EXISTS { MATCH (o)-[:CONTAINS]->(p:Part) WHERE p.size > 10 } RETURN o.orderKey AS orderKey", "SELECT o_orderkey AS \"orderKey\" FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_size > 10)"),
    "g14_exists": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalPrice > c.acctBal * 40 } RETURN c.custKey AS custKey", "SELECT c_custkey AS \"custKey\" FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)"),
    "g15_exists_column": ("MATCH (c:Customer) RETURN c.custKey AS custKey, EXISTS { (c)-[:PLACED]->(:Order {priority: '1-URGENT'}) } AS has_urgent", "SELECT c_custkey AS \"custKey\", c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS has_urgent FROM customer"),
    "g15_count_positive": ("MATCH (n:Nation {nationKey: 7}) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctBal < 0 RETURN COUNT(s) > 0 AS any_in_debt", "SELECT count(s_suppkey) > 0 AS any_in_debt FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 WHERE n_nationkey = 7"),
    "g16_context_anti": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WHERE n.nationKey < 5 AND NOT (c)-[:PLACED]->(:Order {priority: '2-HIGH'}) RETURN n.name AS nation, c.custKey AS custKey", "SELECT n_name AS nation, c_custkey AS \"custKey\" FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey < 5 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')"),
    "g17_inequality": ("MATCH (a:Customer {segment: 'BUILDING'})-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(b:Customer {segment: 'MACHINERY'}) WHERE a <> b AND a.acctBal < b.acctBal - 9500 RETURN a.custKey AS a, b.custKey AS b", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'MACHINERY' AND a.c_acctbal < b.c_acctbal - 9500"),
    "g18_temporal_chain": ("MATCH (u:User)-[:DID]->(a:Event)-[:NEXT]->(b:Event) WHERE a.type = 'click' AND b.type = 'purchase' AND b.ts > a.ts RETURN u.userId AS userId, COUNT(*) AS n", f"SELECT e.user_id AS \"userId\", count(*) AS n FROM {NEXT_SQL} e JOIN events x ON x.event_id = e.a JOIN events y ON y.event_id = e.b WHERE x.event_type = 'click' AND y.event_type = 'purchase' AND y.ts > x.ts GROUP BY 1"),
    "g19_edge_property": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.discount >= 0.08 RETURN p.brand AS brand, SUM(r.quantity) AS quantity, COUNT(r) AS lines", "SELECT p_brand AS brand, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount >= 0.08 GROUP BY 1"),
    "g21_parameters": ("MATCH (c:Customer {segment: $segment}) WHERE c.acctBal > $least RETURN c.custKey AS custKey", "SELECT c_custkey AS \"custKey\" FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_acctbal > 9900", {"segment": "FURNITURE", "least": 9900}),
    "p01_comparisons": ("MATCH (p:Part) WHERE (p.size >= 10 AND p.size <= 20 OR p.brand IN ['Brand#11', 'Brand#12']) AND NOT p.type = 'STANDARD' XOR p.size = 1 RETURN p.partKey AS partKey", "SELECT p_partkey AS \"partKey\" FROM part WHERE ((p_size BETWEEN 10 AND 20 OR p_brand IN ('Brand#11', 'Brand#12')) AND NOT p_type = 'STANDARD') <> (p_size = 1)"),
    "p02_null_tests": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {priority: '1-URGENT'}) WITH c, o WHERE o IS NULL OR o.totalPrice IS NULL RETURN c.custKey AS custKey", "SELECT c_custkey AS \"custKey\" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "p03_text_predicates": ("MATCH (c:Customer) WHERE c.name CONTAINS '11' AND c.name STARTS WITH 'Customer' AND c.name ENDS WITH '1' RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE contains(c_name, '11') AND starts_with(c_name, 'Customer') AND ends_with(c_name, '1')"),
    "p05_expressions": ("MATCH (o:Order) RETURN o.orderKey AS orderKey, o.orderKey / 7 AS q, o.orderKey % 7 AS r, o.totalPrice * 2 AS twice, o.status + '-' + o.priority AS tag", "SELECT o_orderkey AS \"orderKey\", o_orderkey // 7 AS q, o_orderkey % 7 AS r, o_totalprice * 2 AS twice, o_orderstatus || '-' || o_orderpriority AS tag FROM orders"),
    "p06_distinct": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.segment AS segment, o.priority AS priority", "SELECT DISTINCT c_mktsegment AS segment, o_orderpriority AS priority FROM customer JOIN orders ON o_custkey = c_custkey"),
    "p07_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, COUNT(o) AS orders WHERE orders > 14 RETURN c.custKey AS custKey, orders", "SELECT o_custkey AS \"custKey\", count(*) AS orders FROM orders GROUP BY 1 HAVING count(*) > 14"),
    "p08_with_distinct": ("MATCH (c:Customer)-[:PLACED]->(o:Order {priority: '1-URGENT'}) WITH DISTINCT c MATCH (c)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, COUNT(c) AS customers", "SELECT n_name AS nation, count(*) AS customers FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name"),
    "p10_skip_limit": ("MATCH (o:Order) RETURN o.orderKey AS orderKey, o.totalPrice AS price ORDER BY o.totalPrice DESC, orderKey SKIP 5 LIMIT 12", "SELECT o_orderkey AS \"orderKey\", o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12 OFFSET 5"),
    "p11_top_customers": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, SUM(o.totalPrice) AS total RETURN DISTINCT c.custKey AS custKey, c.name AS name, round(total, 2) AS total ORDER BY total DESC LIMIT 10", "SELECT c_custkey AS \"custKey\", c_name AS name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY 3 DESC LIMIT 10"),
    "p15_union": ("MATCH (c:Customer) WHERE c.acctBal < -900 RETURN c.name AS name UNION MATCH (s:Supplier) WHERE s.acctBal < 0 RETURN s.name AS name", "SELECT c_name AS name FROM customer WHERE c_acctbal < -900 UNION SELECT s_name FROM supplier WHERE s_acctbal < 0"),
    "p15_union_all": ("MATCH (c:Customer) RETURN c.segment AS x UNION ALL MATCH (o:Order) RETURN o.status AS x", "SELECT c_mktsegment AS x FROM customer UNION ALL SELECT o_orderstatus FROM orders"),
    "p17_unwind": ("UNWIND [1, 2, 3] AS k MATCH (n:Nation) WHERE n.nationKey % 3 + 1 = k RETURN k, COUNT(n) AS nations", "SELECT (n_nationkey % 3 + 1)::BIGINT AS k, count(*) AS nations FROM nation GROUP BY 1"),
    "p18_case": ("MATCH (o:Order) RETURN CASE WHEN o.totalPrice < 50000 THEN 'small' WHEN o.totalPrice < 200000 THEN 'middle' ELSE 'large' END AS band, COUNT(*) AS n", "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'large' END AS band, count(*) AS n FROM orders GROUP BY 1"),
    "p19_subquery": ("MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN MAX(c.acctBal) AS best } RETURN n.name AS nation, best", "SELECT n_name AS nation, max(c_acctbal) AS best FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"),
    "a01_counts": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {status: 'P'}) RETURN COUNT(*) AS rows, COUNT(o.orderKey) AS orders", "SELECT count(*) AS rows, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'"),
    "a02_count_distinct_node": ("MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) RETURN s.suppKey AS suppKey, COUNT(p) AS lines, COUNT(DISTINCT p) AS parts", "SELECT l_suppkey AS \"suppKey\", count(*) AS lines, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1"),
    "a03_sum_of_nothing": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctBal > 9000 RETURN n.name AS nation, round(SUM(s.acctBal), 2) AS total", "SELECT n_name AS nation, round(coalesce(sum(s_acctbal), 0), 2) AS total FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY n_nationkey, n_name"),
    "a04_avg_min_max": ("MATCH (c:Customer) RETURN c.segment AS segment, round(AVG(c.acctBal), 6) AS mean, MIN(c.acctBal) AS low, MAX(c.acctBal) AS high", "SELECT c_mktsegment AS segment, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1"),
    "a05_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, size(COLLECT(n.name)) AS nations, size(COLLECT(DISTINCT n.regionKey)) AS none", "SELECT r_name AS region, count(*) AS nations, 0::BIGINT AS none FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "a06_spread": ("MATCH (e:Event) RETURN e.type AS type, round(STDEV(e.value), 6) AS sd, round(STDEVP(e.value), 6) AS sdp, round(percentileCont(e.value, 0.95), 6) AS p95, percentileDisc(e.value, 0.5) AS p50", "SELECT event_type AS type, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sdp, round(quantile_cont(value, 0.95), 6) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY 1"),
    "a07_group_by_node": ("MATCH (p:Part)<-[r:CONTAINS]-(o:Order) WITH p, COUNT(r) AS lines RETURN p.brand AS brand, MAX(lines) AS most, COUNT(p) AS parts", "SELECT p_brand AS brand, max(n) AS most, count(*) AS parts FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "a08_staged": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, COUNT(o) AS orders MATCH (c)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, round(AVG(orders), 6) AS mean_orders", "SELECT n_name AS nation, round(avg(k), 6) AS mean_orders FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name"),
    "f01_text_functions": ("MATCH (c:Customer) RETURN trim('  ' + c.name + ' ') AS t, head(split(c.name, '#')) AS h, replace(c.name, 'Customer', 'C') AS r, toString(c.custKey) AS s, size(c.name) AS n, coalesce(c.missing, 'none') AS m", "SELECT c_name AS t, split_part(c_name, '#', 1) AS h, replace(c_name, 'Customer', 'C') AS r, c_custkey::VARCHAR AS s, length(c_name) AS n, 'none' AS m FROM customer"),
    "f02_conversions": ("UNWIND ['1', ' 2', 'x', '3.7', 'true', 'FALSE'] AS v RETURN v, toInteger(v) AS i, toFloat(v) AS f, toBoolean(v) AS b", "SELECT * FROM (VALUES ('1', 1::BIGINT, 1.0::DOUBLE, NULL::BOOLEAN), (' 2', 2, 2.0, NULL), ('x', NULL, NULL, NULL), ('3.7', 3, 3.7, NULL), ('true', NULL, NULL, true), ('FALSE', NULL, NULL, false)) t(v, i, f, b)"),
    "f03_temporal": ("MATCH (e:Event) WHERE e.ts >= datetime('2024-01-10T00:00:00') AND e.ts < datetime('2024-01-10T00:00:00') + duration('P1DT12H') RETURN e.eventId AS eventId, e.ts.hour AS hour, e.ts.day AS day", "SELECT event_id AS \"eventId\", hour(ts) AS hour, day(ts) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11 12:00:00'"),
    "f06_list_predicates": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, COLLECT(o.status) AS statuses WHERE none(s IN statuses WHERE s = 'P') AND 'F' IN statuses RETURN c.custKey AS custKey, size([s IN statuses WHERE s = 'O']) AS open", "SELECT o_custkey AS \"custKey\", count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') = 0 AND count(*) FILTER (o_orderstatus = 'F') > 0"),
}


def graph_query(name: str):
    entry = GRAPH_QUERIES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cypher(spark, table_graph(spark, sf_dir), entry[0], entry[2] if len(entry) > 2 else None)

    return query


QUERIES = {name: graph_query(name) for name in GRAPH_QUERIES}
SQL = {name: entry[1] for name, entry in GRAPH_QUERIES.items()}
