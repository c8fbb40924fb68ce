"""Property graphs as DataFrames: one for each node label and one for each (start, type, end) pattern."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Triple = tuple[str, str, str]
#: Types as the schema names them, by Spark's.
KINDS = {"string": "STRING", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "double": "FLOAT", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME", "date": "DATE"}


class Lazy(Mapping):
    """Frames that are made on first use, so that a query opens only the files that it reads."""

    def __init__(self, makers: Mapping[Any, Callable[[], DataFrame]]):
        self.makers, self.made = dict(makers), {}

    def __getitem__(self, key: Any) -> DataFrame:
        if key not in self.made:
            self.made[key] = self.makers[key]()
        return self.made[key]

    def __iter__(self) -> Iterator:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)

    def __contains__(self, key: Any) -> bool:
        return key in self.makers


def is_property(name: str) -> bool:
    return not name.startswith("_")


@dataclass(frozen=True)
class GraphCatalog:
    """``nodes``: label -> frame with ``_id`` (unique) and properties; ``edges``: triple -> frame with ``_src``, ``_dst``,
    ``_eid`` (tells parallel edges apart) and properties; ``symmetric``: types stored once a pair and matched both ways;
    ``also``: further labels of a label's nodes."""

    nodes: Mapping[str, DataFrame]
    edges: Mapping[Triple, DataFrame]
    symmetric: frozenset[str] = frozenset()
    also: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def with_label(self, label: str) -> frozenset[str]:
        return frozenset(x for x in self.nodes if x == label or label in self.also.get(x, ()))

    def node_properties(self, label: str) -> dict[str, str]:
        return {c: t for c, t in self.nodes[label].dtypes if is_property(c)} if label in self.nodes else {}

    def edge_properties(self, triple: Triple) -> dict[str, str]:
        return {c: t for c, t in self.edges[triple].dtypes if is_property(c)}

    def changed(self, nodes: Mapping[str, DataFrame | None] | None = None, edges: Mapping[Triple, DataFrame | None] | None = None) -> GraphCatalog:
        """A copy with some frames replaced, or removed where None."""

        def merge(old: Mapping, new: Mapping | None) -> Lazy:
            makers: dict = {k: (lambda k=k: old[k]) for k in old}
            for k, v in (new or {}).items():
                makers.pop(k, None)
                if v is not None:
                    makers[k] = lambda v=v: v
            return Lazy(makers)

        return replace(self, nodes=merge(self.nodes, nodes), edges=merge(self.edges, edges))

    # -- introspection

    def schema_nodes(self, spark: SparkSession) -> DataFrame:
        """(label, property, type), from the frames' schemas; no data is read."""
        rows = [(label, c, KINDS.get(t, "ANY" if not t.startswith("array") else "LIST")) for label in sorted(self.nodes) for c, t in self.node_properties(label).items()]
        return spark.createDataFrame(rows, "label string, property string, type string")

    def schema_edges(self, spark: SparkSession) -> DataFrame:
        """(type, property, value_type)."""
        rows = sorted({(t[1], c, KINDS.get(k, "ANY")) for t in self.edges for c, k in self.edge_properties(t).items()})
        return spark.createDataFrame(rows, "type string, property string, value_type string")

    def pattern_counts(self) -> DataFrame:
        """(start_label, type, end_label, count): one count for each edge frame."""
        parts = [df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(s).alias("start_label"), F.lit(t).alias("type"), F.lit(e).alias("end_label"), "count") for (s, t, e), df in sorted(self.edges.items())]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def categorical_domain(self, label: str, prop: str, max_values: int = 20, max_chars: int = 80) -> DataFrame:
        """(value): the ordered distinct non-null short values, or nothing if there are more than ``max_values``."""
        values = self.nodes[label].select(F.col(prop).cast("string").alias("value")).filter(F.col("value").isNotNull() & (F.length("value") <= max_chars)).distinct()
        few = values.orderBy("value").limit(max_values + 1)
        return few.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())).filter(F.col("_n") <= max_values).drop("_n")

    def all_nodes(self) -> DataFrame:
        """(label, id) of every node."""
        parts = [df.select(F.lit(label).alias("label"), F.col("_id").cast("string").alias("id")) for label, df in sorted(self.nodes.items())]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def table_graph(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """The graph over the driver's tables.

    Columns are renamed and nothing is computed that a query doesn't use: each frame is a projection of a scan,
    so filters and needed columns reach the files. TRADES_WITH, which is an aggregate, is lazy too.
    """
    read = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    long = lambda c: F.col(c).cast("long")

    def nodes(table: str, key: str, **props: str) -> Callable[[], DataFrame]:
        return lambda: read(table).select(long(key).alias("_id"), *[F.col(c).alias(p) for p, c in props.items()])

    def edges(table: str, src: str, dst: str, eid: str | None, **props: str) -> Callable[[], DataFrame]:
        """Without a key the edge id is a hash of the whole row; rows are distinct."""

        def make() -> DataFrame:
            key = F.xxhash64(*read(table).columns) if eid is None else long(eid)
            return read(table).select(long(src).alias("_src"), long(dst).alias("_dst"), key.alias("_eid"), *[F.col(c).alias(p) for p, c in props.items()])

        return make

    def following() -> DataFrame:
        per_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
        gap = F.unix_micros(F.lead("ts").over(per_user).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
        rows = read("events").select("event_id", F.lead("event_id").over(per_user).alias("next_id"), gap.alias("gap")).filter("next_id IS NOT NULL")
        return rows.select(long("event_id").alias("_src"), long("next_id").alias("_dst"), long("event_id").alias("_eid"), "gap")

    return GraphCatalog(
        nodes=Lazy({
            "Region": nodes("region", "r_regionkey", regionKey="r_regionkey", name="r_name"),
            "Nation": nodes("nation", "n_nationkey", nationKey="n_nationkey", name="n_name"),
            "Customer": nodes("customer", "c_custkey", custKey="c_custkey", name="c_name", acctBal="c_acctbal", segment="c_mktsegment"),
            "Supplier": nodes("supplier", "s_suppkey", suppKey="s_suppkey", name="s_name", acctBal="s_acctbal"),
            "Part": nodes("part", "p_partkey", partKey="p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", retailPrice="p_retailprice"),
            "Order": nodes("orders", "o_orderkey", orderKey="o_orderkey", status="o_orderstatus", totalPrice="o_totalprice", orderDate="o_orderdate", priority="o_orderpriority"),
            "User": lambda: read("events").select(long("user_id").alias("_id"), F.col("user_id").alias("userId")).distinct(),
            "Event": nodes("events", "event_id", eventId="event_id", ts="ts", type="event_type", value="value", props="props"),
        }),
        edges=Lazy({
            ("Nation", "IN_REGION", "Region"): edges("nation", "n_nationkey", "n_regionkey", "n_nationkey"),
            ("Customer", "IN_NATION", "Nation"): edges("customer", "c_custkey", "c_nationkey", "c_custkey"),
            ("Supplier", "IN_NATION", "Nation"): edges("supplier", "s_suppkey", "s_nationkey", "s_suppkey"),
            ("Customer", "PLACED", "Order"): edges("orders", "o_custkey", "o_orderkey", "o_orderkey", orderDate="o_orderdate"),
            ("Order", "CONTAINS", "Part"): edges("lineitem", "l_orderkey", "l_partkey", None, quantity="l_quantity", price="l_extendedprice", discount="l_discount", shipDate="l_shipdate"),
            ("Supplier", "SUPPLIES", "Part"): edges("lineitem", "l_suppkey", "l_partkey", None),
            ("Order", "FULFILLED_BY", "Supplier"): edges("lineitem", "l_orderkey", "l_suppkey", None),
            ("User", "DID", "Event"): edges("events", "user_id", "event_id", "event_id"),
            ("Event", "NEXT", "Event"): following,
            ("Nation", "TRADES_WITH", "Nation"): lambda: trades(*map(read, ("customer", "supplier", "orders", "lineitem"))),
        }),
        symmetric=frozenset({"TRADES_WITH"}),
    )


def trades(customer: DataFrame, supplier: DataFrame, orders: DataFrame, lineitem: DataFrame, pairs: int = 40) -> DataFrame:
    """The ``pairs`` unordered nation pairs of largest revenue, once a pair."""
    lines = lineitem.select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("revenue"))
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), lines["l_orderkey"] == F.col("o_orderkey")).join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    a, b = F.least("c_nationkey", "s_nationkey").cast("long"), F.greatest("c_nationkey", "s_nationkey").cast("long")
    totals = joined.groupBy(a.alias("_src"), b.alias("_dst")).agg(F.sum("revenue").alias("revenue"))
    top = totals.orderBy(F.desc("revenue"), "_src", "_dst").limit(pairs)
    return top.select("_src", "_dst", (F.col("_src") * 1000 + F.col("_dst")).alias("_eid"), F.col("revenue").cast("double").alias("revenue"))
