"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws -ln(u) / weight, with u from a hash of the key and the child's name, and the
least draw wins; a child wins in proportion to its weight. A node's weight is the sum of its shards'. A draw
depends on nothing but key, name and weight, so a changed weight moves rows only into or out of the subtrees
whose weights change: between regions only those to or from a changed region, and so on downwards.

A tree that grows by a shard in a region of its own changes no other weight, so rows move into that shard only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_number, id_text, md5_salt, table, text_or_empty

#: (region, rack, shard, weight) of each shard.
Tree = Sequence[tuple[int, int, int, float]]
RACKS, SHARDS = 2, 5


def standard_tree(shards: int, base: int = 40) -> list[tuple[int, int, int, float]]:
    """The tree that a shard count decides: the first ``base`` shards in regions of 2 racks of 5, each later one in a region of its own."""
    size = RACKS * SHARDS
    grid = [(s // size, s % size // SHARDS, s, 1.0) for s in range(min(shards, base))]
    return grid + [(base // size + s - base + 1, 0, s, 1.0) for s in range(base, shards)]


def uniform(key: Column, label: Column) -> Column:
    """A number in (0, 1), the same in every SQL engine: 13 hex digits of an MD5, which a double holds exactly."""
    return (F.conv(F.substring(F.md5(F.concat(key, label)), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def descend(key: Column, children: Column, level: str) -> Column:
    """The child (of array<struct<id, weight>>) with the least draw; ties go to the lesser id."""
    draw = lambda c: F.struct((-F.log(uniform(key, F.concat(F.lit(f"/{level}/"), c["id"].cast("string")))) / c["weight"]).alias("draw"), c["id"].alias("id"))
    return F.array_min(F.transform(children, draw))["id"]


def children(weights: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in sorted(weights.items())])


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a text key: three draws over a few children each, not one over all shards.

    Shards of weight 0 get nothing. Rack names hold their region's, so equal rack numbers draw apart.
    """
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    width = 1 + max(rack for _, rack, _, _ in tree)
    for region, rack, shard, weight in tree:
        if weight > 0:
            name = region * width + rack
            regions[region] = regions.get(region, 0) + weight
            racks.setdefault(region, {})[name] = racks.get(region, {}).get(name, 0) + weight
            shards.setdefault(name, {})[shard] = weight
    lookup = lambda of: F.create_map(*[x for k, v in sorted(of.items()) for x in (F.lit(k), children(v))])
    region = descend(key, children(regions), "region")
    rack = descend(key, F.element_at(lookup(racks), region), "rack")
    return descend(key, F.element_at(lookup(shards), rack), "shard")


def hash_tree_shards(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its shard by ``id_col`` alone, and by the ``grown`` tree where one is given.

    Returns doc_id, size (UTF-8 bytes of the text and 16; null: 16), text_crc32, shard, slot (gapless from 0 in
    each shard, ordered by a hash of id, size and crc, then by them), grown_shard. A null id is the empty key. Repeated
    rows get slots of their own. Empty texts and tables are no special case; other columns are ignored.
    Only ids and three numbers are shuffled, dealt by (shard, salt), so a shard is never in one task.
    """
    text, key = text_or_empty(text_col).cast("binary"), id_text(id_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(key, tree).cast("int").alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    rows = rows.withColumn("_salt", md5_salt(F.col("doc_id"), F.col("size"), F.col("text_crc32")))
    return gapless_number(rows, "shard", "_salt", ["doc_id", "size", "text_crc32"], "slot").drop("_salt")


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hash_tree_shards(table(spark, sf_dir, "documents"), standard_tree(40), standard_tree(41))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _draw_sql(level: str, weights: dict[int, float], label: int | None = None) -> str:
    """The child with the least draw, of children given as a literal list."""
    items = ", ".join(f"{{'id': {i}, 'w': {w!r}}}" for i, w in sorted(weights.items()))
    return f"list_sort(list_transform([{items}], lambda c: {{'draw': -ln((('0x' || substr(md5(key || '/{level}/' || c.id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / c.w, 'id': c.id}}))[1].id"


def _shard_sql(tree: Tree, prefix: str) -> str:
    """Columns {prefix}region, {prefix}rack and {prefix}shard of a table d with key, as three nested selects."""
    width = 1 + max(rack for _, rack, _, _ in tree)
    regions, racks, shards = {}, {}, {}
    for region, rack, shard, weight in tree:
        regions[region] = regions.get(region, 0.0) + weight
        racks.setdefault(region, {})[region * width + rack] = racks.get(region, {}).get(region * width + rack, 0.0) + weight
        shards.setdefault(region * width + rack, {})[shard] = weight
    cases = lambda of, column, level: "CASE " + column + " " + " ".join(f"WHEN {k} THEN {_draw_sql(level, v)}" for k, v in sorted(of.items())) + " END"
    return f"SELECT *, {cases(shards, prefix + 'rack', 'shard')} AS {prefix}shard FROM (SELECT *, {cases(racks, prefix + 'region', 'rack')} AS {prefix}rack FROM (SELECT *, {_draw_sql('region', regions)} AS {prefix}region FROM"


#: The CRC of a text's bytes: a table of 256 remainders by eight halvings each, then one step a byte (of the text in hex).
OP2_SQL = f"""
WITH RECURSIVE c(b, step, r) AS (SELECT b, 0, b::UINTEGER FROM range(256) t(b) UNION ALL SELECT b, step + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UINTEGER) ELSE r >> 1 END FROM c WHERE step < 8),
crc AS (SELECT list(r ORDER BY b) AS steps FROM c WHERE step = 8),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, encode(coalesce(text, '')) AS bytes FROM documents),
e AS (SELECT *, octet_length(bytes)::BIGINT + 16 AS size, list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: ('0x' || x)::UINTEGER)) AS codes FROM d),
f AS (SELECT doc_id, key, size, xor(list_reduce(codes, lambda acc, x: xor(acc >> 8, steps[(xor(acc, x) & 255) + 1])), 4294967295::UINTEGER)::BIGINT AS text_crc32 FROM e, crc),
g AS ({_shard_sql(standard_tree(40), '')} f))),
h AS ({_shard_sql(standard_tree(41), 'grown_')} g)))
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key || '/' || size || '/' || text_crc32), 1, 2), doc_id, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM h
"""
QUERIES = {"op2_hash_tree_shards": op2_hash_tree_shards}
SQL = {"op2_hash_tree_shards": OP2_SQL}
