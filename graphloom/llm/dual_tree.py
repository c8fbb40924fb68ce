"""Centroid clustering by dual-tree Lloyd rounds, in whole numbers.

The vectors of a partition are cut into blocks, and each block gets a cover tree once: centres come in farthest-first order, so that
those that were at least 2 ** i from all earlier ones are a net of level i, and each hangs below the nearest centre of the
level above. The blocks are written, with their trees and each node's number and sums of vectors. Each round the
driver puts the centroids (k of them) into a binary tree, too, and the tasks walk both trees: pairs of a vector node and a
centroid node meet, and a pair goes when its least possible distance exceeds the greatest possible distance to the best
other one. A vector node that only one centroid is left for is assigned as a whole, by its sums; where both are
leaves, the vectors are compared exactly. Bounds are doubles with slack, the distances that decide are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

#: Vectors of a block, and of a leaf of its tree, about.
BLOCK, LEAF = 2048, 12
#: Components are whole numbers up to this size, so that squared distances of 64 of them are exact in 64 bits.
MOST = 1 << 27
#: Up to this size products of 64 components are exact in doubles, too, which are faster.
EXACT_DOUBLE = 1 << 22
SLACK = 1e-6


@dataclass
class Tree:
    """A block's vectors in tree order, and its nodes: each has the vectors from ``low`` to ``high``, a centre and a radius.

    ``first`` and ``last`` are the children's places (none: a leaf); the root is node 0.
    """

    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The cover tree of the rows of ``x`` (whole numbers), and the order in which it has them. Equal rows have one centre."""
    n = len(x)
    at = x.astype(np.float64)
    square = np.einsum("ij,ij->i", at, at)
    centres, gap, near, which = [0], [], np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    while True:
        c = centres[-1]
        d = np.maximum(square + square[c] - 2 * (at @ at[c]), 0.0)
        closer = d < near
        near[closer], which[closer] = d[closer], len(centres) - 1
        far = int(near.argmax())
        if near[far] <= 0.5 or len(centres) * leaf >= n:
            break
        gap.append(float(near[far]))
        centres.append(far)
    places = at[centres]
    pairs = np.maximum(square[centres][:, None] + square[centres][None, :] - 2 * places @ places.T, 0.0)
    # A centre's level: it was more than 2 ** level from all before it. Its parent is the nearest centre of a higher level.
    level = np.floor(0.5 * np.log2(np.maximum(gap, 1e-300))).astype(np.int64) if gap else np.empty(0, dtype=np.int64)
    below: list[list[int]] = [[] for _ in centres]
    for k in range(1, len(centres)):
        higher = 1 + int(np.searchsorted(-level, -level[k - 1], side="left"))  # levels fall, as gaps do
        below[int(pairs[k, :higher].argmin())].append(k)
    members = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[members], np.arange(len(centres) + 1))
    order, low, high, first, last, centre = [], [0], [0], [0], [0], [0]

    def leaf_of(node: int, k: int) -> None:
        low[node] = len(order)
        order.extend(members[edges[k] : edges[k + 1]].tolist())
        high[node] = len(order)

    # A node is a centre with the children from one of its levels down; it is opened into that level's children and itself.
    open_nodes: list[tuple[int, int, int, bool]] = [(0, 0, 0, False)]
    while open_nodes:
        node, k, start, done = open_nodes.pop()
        if done:
            high[node] = len(order)
            continue
        children = below[k][start:]
        if not children:
            leaf_of(node, k)
            continue
        top = level[children[0] - 1]
        stop = next((i for i, c in enumerate(children) if level[c - 1] != top), len(children))
        low[node], first[node] = len(order), len(low)
        made = [(c, 0) for c in children[:stop]] + [(k, start + stop)]
        last[node] = first[node] + len(made)
        for column in (low, high, first, last):
            column.extend([0] * len(made))
        centre.extend(c for c, _ in made)
        open_nodes.append((node, k, start, True))
        open_nodes.extend((first[node] + i, c, s, False) for i, (c, s) in enumerate(made))
    order = np.array(order, dtype=np.int64)
    vectors, low, high, first, last = x[order], *(np.array(c, dtype=np.int64) for c in (low, high, first, last))
    centre = x[np.array(centres, dtype=np.int64)[centre]] if n else x
    radius = np.zeros(len(low))
    for i in range(len(low) if n else 0):
        d = vectors[low[i] : high[i]].astype(np.float64) - centre[i]
        radius[i] = np.sqrt(np.einsum("ij,ij->i", d, d).max())
    return Tree(vectors, low, high, first, last, centre, radius), order


def centroid_tree(centroids: np.ndarray) -> Tree:
    """A binary tree over the centroids: a node is split by its two farthest apart (from an end of the longest side), down to one each."""
    at = centroids.astype(np.float64)
    first, last, centre, radius = [], [], [], []
    rows: list[np.ndarray] = [np.arange(len(centroids))]
    node = 0
    while node < len(rows):  # breadth first, so that children lie together
        mine = rows[node]
        middle = mine[int(np.linalg.norm(at[mine] - at[mine].mean(axis=0), axis=1).argmin())]
        centre.append(middle)
        radius.append(float(np.linalg.norm(at[mine] - at[middle], axis=1).max()))
        first.append(0)
        last.append(0)
        if len(mine) > 1:
            a = mine[int(np.linalg.norm(at[mine] - at[middle], axis=1).argmax())]
            to_a = np.linalg.norm(at[mine] - at[a], axis=1)
            b = mine[int(to_a.argmax())]
            left = to_a < np.linalg.norm(at[mine] - at[b], axis=1)
            if left.all() or not left.any():  # equal centroids
                left = np.arange(len(mine)) < len(mine) // 2
            first[node], last[node] = len(rows), len(rows) + 2
            rows += [mine[left], mine[~left]]
        node += 1
    members = np.array([m[0] for m in rows], dtype=np.int64)  # of a leaf: its centroid
    return Tree(centroids, members, members + 1, *(np.array(c, dtype=np.int64) for c in (first, last)), centroids[np.array(centre)], np.array(radius))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT_DOUBLE:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def walk(tree: Tree, other: Tree) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """Dual traversal: (low, high, centroid or the candidates of the vectors of a leaf). The ranges cover all vectors once."""
    node, mate = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)  # pairs, sorted by node
    while len(node):
        d = np.sqrt(((tree.centre[node].astype(np.float64) - other.centre[mate]) ** 2).sum(axis=1))
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.append(starts, len(node)))
        # The centre of a centroid node is one of its centroids, so no vector of the node has its nearest centroid farther than this.
        reach = np.repeat(np.minimum.reduceat(d + tree.radius[node], starts), sizes)
        stay = d - tree.radius[node] - other.radius[mate] <= reach * (1 + SLACK) + SLACK
        node, mate = node[stay], mate[stay]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.append(starts, len(node)))
        inner, deep = other.last[mate] > other.first[mate], tree.last[node] > tree.first[node]
        widest = np.repeat(np.maximum.reduceat(np.where(inner, other.radius[mate], -1.0), starts), sizes)
        split_mate = (widest >= 0) & ((widest >= tree.radius[node]) | ~deep)  # the larger of the two is opened
        closed = widest < 0
        single = np.repeat(sizes == 1, sizes) & closed
        ready = closed & ~deep
        for s, size in zip(starts[single[starts] | ready[starts]].tolist(), sizes[single[starts] | ready[starts]].tolist(), strict=True):
            v = node[s]
            yield int(tree.low[v]), int(tree.high[v]), other.low[mate[s : s + size]]
        going = ~(single | ready)
        by_mate, by_node = going & split_mate, going & ~split_mate
        pieces_n, pieces_m = [], []
        if by_mate.any():
            opened = by_mate & inner
            pieces_n += [np.repeat(node[opened], 2), node[by_mate & ~inner]]
            pieces_m += [np.stack([other.first[mate[opened]], other.first[mate[opened]] + 1], axis=1).ravel(), mate[by_mate & ~inner]]
        if by_node.any():
            n, m = node[by_node], mate[by_node]
            many = tree.last[n] - tree.first[n]
            offset = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
            pieces_n.append(np.repeat(tree.first[n], many) + offset)
            pieces_m.append(np.repeat(m, many))
        if not pieces_n:
            return
        node, mate = np.concatenate(pieces_n), np.concatenate(pieces_m)
        order = np.argsort(node, kind="stable")
        node, mate = node[order], mate[order]


def nearest(x: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest of the candidates, squared distance) of each row, exactly; ties go to the smaller number."""
    candidates = np.sort(candidates)
    d = squared(x, centroids[candidates])
    at = d.argmin(axis=1)
    return candidates[at], d[np.arange(len(x)), at]


def sums_of(tree: Tree, centroids: np.ndarray, other: Tree, counts: np.ndarray, sums: np.ndarray) -> None:
    """Add each centroid's number and sums of the block's vectors; of vector nodes with one centroid left at once."""
    total = np.concatenate([np.zeros((1, tree.vectors.shape[1]), dtype=np.int64), tree.vectors.cumsum(axis=0)])
    for low, high, candidates in walk(tree, other):
        if len(candidates) == 1:
            counts[candidates[0]] += high - low
            sums[candidates[0]] += total[high] - total[low]
            continue
        where, _ = nearest(tree.vectors[low:high], centroids, candidates)
        counts += np.bincount(where, minlength=len(counts))
        for c in np.unique(where):
            sums[c] += tree.vectors[low:high][where == c].sum(axis=0)


def assigned(tree: Tree, centroids: np.ndarray, other: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each of the block's vectors."""
    cluster, distance = np.empty(len(tree.vectors), dtype=np.int64), np.empty(len(tree.vectors), dtype=np.int64)
    for low, high, candidates in walk(tree, other):
        cluster[low:high], distance[low:high] = nearest(tree.vectors[low:high], centroids, candidates)
    return cluster, distance


COLUMNS = ("low", "high", "first", "last", "centre", "radius")
BLOCKS = "ids array<long>, vectors binary, " + ", ".join(f"{c} binary" for c in COLUMNS)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, dims: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of the vectors with ``dims`` components, none null, NaN or infinite."""
    sound = (F.size(vector_col) == dims) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vector_col).isNotNull() & sound)
    scaled = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    checked = F.forall(vector_col, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(float(MOST)))
    v = F.when(checked, F.transform(vector_col, scaled)).otherwise(F.raise_error(F.lit(f"a component is {MOST} or more in size, beyond exact 64-bit distances")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def blocks_of(whole: DataFrame, dims: int, block: int) -> DataFrame:
    """The vectors in blocks with their cover trees, a row each, written."""
    small_batches(whole.sparkSession)

    def make(ids: list, held: list[np.ndarray]) -> pa.RecordBatch:
        tree, order = cover_tree(np.concatenate(held))
        values = [pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([tree.vectors.astype("<i4").tobytes()], pa.binary())]
        values += [pa.array([np.ascontiguousarray(getattr(tree, c)).astype("<f8" if c == "radius" else "<i4").tobytes()], pa.binary()) for c in COLUMNS]
        return pa.RecordBatch.from_arrays(values, names=["ids", "vectors", *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            held.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims))
            while len(ids) >= block:
                rows = np.concatenate(held)
                yield make(ids[:block], [rows[:block]])
                ids, held = ids[block:], [rows[block:]]
        if ids:
            yield make(ids, held)

    return materialise(whole.mapInArrow(run, BLOCKS), "blocks")


def read_block(batch: pa.RecordBatch, row: int, dims: int) -> tuple[list, Tree]:
    value = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), dtype=kind).astype(np.int64 if kind == "<i4" else np.float64)
    low, high, first, last, centre, radius = (value(2 + i, "<f8" if c == "radius" else "<i4") for i, c in enumerate(COLUMNS))
    return batch.column(0)[row].as_py(), Tree(value(1, "<i4").reshape(-1, dims), low, high, first, last, centre.reshape(-1, dims), radius)


def one_round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of exact means; those without vectors stay. k x dims sums reach the driver."""
    k, dims = centroids.shape
    other = centroid_tree(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                sums_of(read_block(batch, row, dims)[1], centroids, other, counts, sums)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = blocks.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("dim", "s"))
    found = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return out


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def dual_tree_lloyd(vectors: DataFrame, k: int, rounds: int, seed: str, scale: int = 1024, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Lloyd's rounds in whole numbers: (vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>, centroid_sha256).

    Vectors with ``dims`` components, none null or not finite, are kept, as floor(scale * x). The centroids start as the k kept
    vectors with the smallest sha256 of ``seed:vec_id`` (null ids as the empty text; equal hashes, as of repeated ids, by the vector); of fewer vectors
    there are fewer. A vector goes to the nearest centroid, ties to the smaller number; a centroid becomes the floor of its
    vectors' mean, one without vectors stays. Repeated rows count as rows, an empty table gives an empty result, other columns are
    ignored; scaled components of MOST or more raise an error, as distances would not be exact. Nothing is shuffled but k x dims
    partial sums of each task; the driver holds the k centroids only. Blocks, and the last assignment, are written steps.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, id_col, vector_col, scale, dims)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = whole.withColumn("_k", key).orderBy("_k", "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in start], dtype=np.int64)
    blocks = blocks_of(whole, dims, block)
    for _ in range(rounds):
        centroids = one_round(blocks, centroids)
    other = centroid_tree(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, tree = read_block(batch, row, dims)
                cluster, distance = assigned(tree, centroids, other)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    last = materialise(blocks.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    facts = [(i, inertia.get(i, 0), sum(inertia.values()), c.tolist(), digest(c.tolist())) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return last.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")  # k rows


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree_lloyd(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed="3").drop("centroid")


def round_sql(i: int) -> str:
    """A round in SQL: vectors to their nearest centroid, then floors of means."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT v.r, first(c.n ORDER BY list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.n) AS n FROM v, c{i} c GROUP BY v.r),
m{i} AS (
  SELECT n, d, floor(sum(x) // count(*))::BIGINT - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END AS x
  FROM (SELECT a.n, unnest(range(64)) AS d, unnest(v.x)::HUGEINT AS x FROM a{i} a JOIN v ON a.r = v.r) GROUP BY n, d),
c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT n, list(x ORDER BY d) AS x FROM m{i} GROUP BY n) m ON c.n = m.n),"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k, x) - 1 AS n, x FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS k, x FROM v ORDER BY k, x LIMIT 8)),
{"".join(map(round_sql, range(10)))}
e AS (SELECT v.r, v.vec_id, c.n, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d, c.x FROM v, c10 c),
b AS MATERIALIZED (SELECT r, first(vec_id) AS vec_id, first(n ORDER BY d, n) AS n, min(d) AS d FROM e GROUP BY r)
SELECT b.vec_id, b.n::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.n))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM b JOIN c10 c ON b.n = c.n
"""
QUERIES = {"op13_dual_tree_lloyd": op13_dual_tree_lloyd}
SQL = {"op13_dual_tree_lloyd": OP13_SQL}
