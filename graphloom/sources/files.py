"""Graph loads from delimited files, JSON lines, benchmark packages and checksums."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.query_text import Schema
from ..operators.selection import hash_key
from ..plans.catalog import GraphCatalog

CASTS = {"INTEGER": "bigint", "FLOAT": "double", "BOOLEAN": "boolean", "DATETIME": "timestamp", "DATE": "date", "STRING": "string"}


def read_delimited(spark: SparkSession, path: str | Sequence[str], separator: str = "|") -> DataFrame:
    """All columns as text; empty text is null."""
    df = spark.read.csv(path, sep=separator, header=True, quote='"', escape='"', multiLine=False)
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def typed(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Cast columns by kind; what can't be cast is null. STRINGARRAY splits at ``;``."""
    one = lambda c, k: F.split(c, ";") if k == "STRINGARRAY" else c.try_cast(CASTS[k])
    return df.select(*[one(F.col(c), kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def load_nodes(df: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Upsert by key: of rows with one key the last (by ``order``) stays. Rows without a key are dropped."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in (order or [c for c in df.columns if c != key] or [key])])
    last = df.filter(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return last.withColumn("_id", F.col(key).cast("long"))


def load_edges(df: DataFrame, src: str, dst: str, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges whose two ends exist, repeats kept; ``_eid`` is a hash of the row and its number among equal rows."""
    own = [c for c in df.columns if c not in (src, dst)]
    same = Window.partitionBy(*df.columns).orderBy(F.lit(1))
    rows = df.withColumn("_k", F.row_number().over(same)).select(F.col(src).cast("long").alias("_src"), F.col(dst).cast("long").alias("_dst"), F.xxhash64(*df.columns, "_k").alias("_eid"), *own)
    return rows.join(starts.select(F.col("_id").alias("_src")), "_src", "left_semi").join(ends.select(F.col("_id").alias("_dst")), "_dst", "left_semi")


def unite(graphs: Mapping[str, GraphCatalog], replicas: int = 1) -> GraphCatalog:
    """One catalog of all graphs with labels and types prefixed by their names (and replica numbers)."""
    names = [(f"{n}_" if replicas == 1 else f"{n}{i}_", g) for n, g in graphs.items() for i in range(1, replicas + 1)]
    nodes = {f"{p}{label}": df for p, g in names for label, df in g.nodes.items()}
    edges = {(f"{p}{a}", f"{p}{t}", f"{p}{b}"): df for p, g in names for (a, t, b), df in g.edges.items()}
    return GraphCatalog(nodes, edges, frozenset(f"{p}{t}" for p, g in names for t in g.symmetric))


def read_lines(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """JSON lines by an explicit schema; missing files and blank lines give no rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    fs = spark._jvm.org.apache.hadoop.fs
    there = [p for p in paths if fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(p))]
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(there) if there else spark.createDataFrame([], schema)


def read_runs(spark: SparkSession, paths: Mapping[str, str], schema: StructType | str) -> DataFrame:
    """Records of several runs with ``_source_run`` and ``_source_records_path``."""
    parts = [read_lines(spark, p, schema).withColumn("_source_run", F.lit(run)).withColumn("_source_records_path", F.input_file_name()) for run, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_package(df: DataFrame, path: str, id_col: str = "id", split: str = "split") -> dict:
    """``all`` and one folder a split as JSON lines, with stats and a manifest; returns the manifest.

    The digest is over the rows' canonical JSON in id order: each partition is digested in place after one range sort, and
    the driver digests the partitions' digests, so it never holds the rows.
    """
    df.write.mode("overwrite").json(f"{path}/all")
    df.write.mode("overwrite").partitionBy(split).json(f"{path}/splits")
    counts = {r[0]: r[1] for r in df.groupBy(split).count().collect()}
    manifest = {"rows": sum(counts.values()), "splits": dict(sorted(counts.items())), "sha256": content_digest(df, id_col)}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_package(spark: SparkSession, path: str, schema: StructType | str, part: str | None = None, split: str = "split") -> DataFrame:
    """A package's rows: all of them, or the slice of one split, of which only its folder is read."""
    return read_lines(spark, f"{path}/all" if part is None else f"{path}/splits/{split}={part}", schema)


def content_digest(df: DataFrame, id_col: str) -> str:
    """A digest of the rows that depends on neither their order nor their partitioning: rows fall in 256 hash buckets, each digested in id order."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
    rows = df.select(F.sha2(line, 256).alias("h"), F.substring(hash_key(id_col), 1, 2).alias("b"))
    sums = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.conv(F.substring("h", 13, 12), 16, 10).cast("long")).alias("x"))
    return sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "n", "s", "x"))), "\n"), 256)).first()[0]


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def schema_of(catalog: GraphCatalog, counts: Mapping[tuple[str, str, str], int] | None = None, domains: Mapping[str, Sequence[str]] | None = None) -> Schema:
    """The schema that query analysis uses, from a catalog."""
    rels: dict[str, dict[str, str]] = {}
    for t in catalog.edges:
        rels.setdefault(t[1], {}).update(catalog.edge_properties(t))
    return Schema({x: catalog.node_properties(x) for x in catalog.nodes}, rels, {t: (counts or {}).get(t, 0) for t in catalog.edges}, {k: tuple(v) for k, v in (domains or {}).items()}, catalog.symmetric)


def schema_json(s: Schema) -> str:
    return json.dumps({"nodes": s.nodes, "rels": s.rels, "patterns": [[*k, v] for k, v in sorted(s.patterns.items())], "domains": s.domains, "symmetric": sorted(s.symmetric)}, sort_keys=True)


def schema_from_json(text: str) -> Schema:
    d = json.loads(text)
    return Schema(d["nodes"], d["rels"], {tuple(p[:3]): p[3] for p in d["patterns"]}, {k: tuple(v) for k, v in d["domains"].items()}, frozenset(d["symmetric"]))


def schema_text(s: Schema, most: int = 200) -> str:
    """A sorted, capped rendering for people."""
    lines = [f"(:{label} {{{', '.join(f'{p}: {t}' for p, t in sorted(ps.items()))}}})" for label, ps in sorted(s.nodes.items())]
    lines += [f"(:{a})-[:{t}]->(:{b})" for a, t, b in sorted(s.patterns)]
    lines += [f"{k} in {', '.join(v)}" for k, v in sorted(s.domains.items())]
    return "\n".join(lines[:most])
