"""SimHash near-dedup with pivot distance tables.

A text's fingerprint is the bitwise majority of its shingles' hashes. Distinct fingerprints meet where they
agree on some of a few bit blocks: two that differ in at most ``radius`` bits agree on all but ``radius`` of
the blocks, so they share at least one of the keys made of the others, and no link is lost. Where several
meet, pivot tables decide: each fingerprint's Hamming distances to many reference fingerprints are computed
once, a pair whose distances to any of them differ by more than ``radius`` is discarded (the triangle
inequality), and the survivors are verified.

Only distinct fingerprints are joined, so exact copies cost nothing. Where more than ``BLOCK`` meet under one key,
they are split into blocks and every pair of blocks is a group of its own, so that no task holds
an unbounded group; under a key of more than ``HOT`` they meet again under longer keys instead. A group
returns a spanning forest of its links, not all pairs.

Texts alike by Jaccard similarity (``similar_components``) meet where samples of their shingles have fingerprints with
equal rows in the pivot table; at the wide radius of their whole fingerprints the pivot tables are of blocks of bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, forget, map_rows, materialise, path_of, steps, table, text_or_empty
from .components import connected_components

SEED, BITS = 42, 64
#: Fingerprints of one group; a group of two blocks has twice as many at most.
BLOCK = 1024
#: Fingerprints of a key from which on it is made longer.
HOT = 20 * BLOCK
NO_ID = (1 << 63) - 1
#: Reference fingerprints of the pivot tables, by a rule: hashes of 0, 1, 2, ...
PIVOTS = np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(16)], dtype=np.uint64)
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Reference blocks of four bits: two blocks that differ in up to three bits have distances to one of them that differ as much.
BLOCK_PIVOTS = np.array([0b0000, 0b0011, 0b0101, 0b0110], dtype=np.uint8)
COLUMN = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of the ``k``-word shingles, repeats included, A-Z lower-cased; fewer words are one shingle, none give none."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the white space \x20, \x09-\x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, SEED)], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.fromiter((h(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :], strict=False)), dtype=np.uint64, count=len(words) - k + 1)


def fingerprint(text: str, k: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; a text without words has 0."""
    hashes = shingle_hashes(text, k)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    cells = hashes.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + COLUMN
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel()).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_masks(radius: int, extra: int = 3, bits: Sequence[int] = range(BITS)) -> list[int]:
    """Masks of the keys: all choices of ``extra`` of radius + extra blocks of the ``bits``."""
    edges = [round(i * len(bits) / (radius + extra)) for i in range(radius + extra + 1)]
    blocks = [sum(1 << b for b in bits[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, extra)]


def apart(fps: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Hamming distances between rows of words."""
    return np.bitwise_count(fps ^ others).sum(axis=-1, dtype=np.int16)


def pivot_table(fps: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Each row's distances to its group's first row and to the PIVOTS, of which every word takes another stretch."""
    width = fps.shape[1]
    first = fps[np.searchsorted(group, group, side="left")]
    return np.stack([apart(fps, first), *(apart(fps, np.roll(PIVOTS, -p)[:width]) for p in range(len(PIVOTS)))], axis=1)


def block_table(fps: np.ndarray) -> np.ndarray:
    """Each row's distances to each of the BLOCK_PIVOTS, in every block of four bits: rows x pivots x blocks."""
    cells = np.ascontiguousarray(fps).view(np.uint8)
    blocks = np.concatenate([cells >> 4, cells & 15], axis=1)
    return np.bitwise_count(blocks[:, None, :] ^ BLOCK_PIVOTS[:, None]).astype(np.int8)


def least_apart(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bounds from below on the distances of rows i and j: in each block the triangle inequality by its best pivot, then the sum."""
    return np.abs(table[i] - table[j]).max(axis=1).sum(axis=1, dtype=np.int16)


def linked_pairs(fps: np.ndarray, group: np.ndarray, radius: int, may=None, by_block: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of one group that differ in at most ``radius`` bits (and that ``may(i, j)`` allows); rows (words) are sorted by group.

    ``by_block``: the pivot table has distances in each block of bits, for a radius at which those of whole fingerprints tell nothing.
    """
    near = pivot_table(fps, group)
    order = np.lexsort((near[:, 0], group))
    fps, group, near = fps[order], group[order], near[order]
    blocks = block_table(fps) if by_block else None
    found_i, found_j = [], []
    # In a group sorted by the first distance, only rows within ``radius`` of it can link.
    sort_key = group.astype(np.int64) * 1024 + near[:, 0]
    reach = np.searchsorted(sort_key, sort_key + radius, side="right")
    reach = np.minimum(reach, np.searchsorted(group, group, side="right"))
    todo = np.arange(len(fps))
    step = 1
    while len(todo := todo[todo + step < reach[todo]]):
        i, j = todo, todo + step
        if may is not None:
            keep = may(order[i], order[j])
            i, j = i[keep], j[keep]
        if by_block and len(i):
            keep = least_apart(blocks, i, j) <= radius
            i, j = i[keep], j[keep]
        for p in range(1, 1 if by_block else near.shape[1]):
            if not len(i):
                break
            keep = np.abs(near[i, p] - near[j, p]) <= radius
            i, j = i[keep], j[keep]
        verified = apart(fps[i], fps[j]) <= radius
        found_i.append(order[i[verified]])
        found_j.append(order[j[verified]])
        step += 1
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if (root == before).all():
            return root


GROUP = ["t", "key", "bi", "bj"]


def whole_groups(links, rows: int = 4 * BLOCK):
    """A function over the batches of a partition sorted by group that gives ``links`` whole groups, from so many rows on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rest[GROUP].iloc[-1]
            whole = (rest[GROUP] != last).any(axis=1)
            if whole.any() and len(rest) >= rows:
                yield links(rest[whole].reset_index(drop=True))
                rest = rest[~whole].reset_index(drop=True)
        if rest is not None and len(rest):
            yield links(rest)

    return run


def forests(columns: list[str], pairs):
    """Of partitions sorted by group: links (a, b) that connect what each group connects. ``pairs``: (fingerprints, groups) -> linked positions."""

    def links(part: pd.DataFrame) -> pd.DataFrame:
        group = (part[GROUP] != part[GROUP].shift()).any(axis=1).cumsum().to_numpy()
        fps = part[columns].to_numpy().astype(np.int64).view(np.uint64)
        i, j = pairs(fps, group)
        node = part["node"].to_numpy()
        used, at = np.unique(np.concatenate([node[i], node[j]]), return_inverse=True)
        root = forest(len(used), at[: len(i)], at[len(i) :])
        moved = root != np.arange(len(used))
        return pd.DataFrame({"a": used[moved], "b": used[root[moved]]})

    return whole_groups(links)


def dealt(keyed: DataFrame, shared: DataFrame, fingerprints: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that share a key (t, key) with another, in partitions sorted by group: a key of many rows becomes pairs of blocks.

    ``keyed``: (node, t, key); ``shared``: (t, key, n) of the keys of more than one row. Fingerprints join only the rows that share a key.
    """
    met = keyed.join(shared, ["t", "key"]).join(fingerprints, "node")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("t", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "node", *[c for c in columns if c != "node"])
    return met.repartition(*GROUP).sortWithinPartitions(*GROUP)


def sizes_of(keyed: DataFrame) -> DataFrame:
    """(t, key, n) of the keys of more than one row, written."""
    return materialise(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "keys")


def refined(keyed: DataFrame, hot: DataFrame, fingerprints: DataFrame, radius: int) -> DataFrame:
    """The rows of hot keys under longer keys: the bits outside a key are cut into blocks anew, and fingerprints within ``radius`` bits agree there on all but ``radius`` of them, too.

    So each row of a hot key gets as many keys as there are choices of blocks, instead of a copy for every block of its rows.
    """
    masks = block_masks(radius)
    finer = [[signed(m | inner) for inner in block_masks(radius, bits=[b for b in range(BITS) if not m >> b & 1])] for m in masks]
    of_key = F.element_at(F.array(*[F.array(*map(F.lit, f)) for f in finer]), F.col("t") + 1)
    rows = keyed.join(broadcast_if_small(hot.select("t", "key")), ["t", "key"], "left_semi").join(fingerprints.select("node", "fp"), "node")
    rows = rows.select("node", "t", "fp", F.posexplode(of_key).alias("u", "mask"))
    return rows.select("node", (F.lit(len(masks)) + F.col("t") * len(finer[0]) + F.col("u")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def components_of(distinct: DataFrame, links: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, component): the least rep of each node's component. ``distinct``: (columns, rep, node); nodes are unique, reps need not be."""
    roots = connected_components(links)
    linked = materialise(distinct.select("node", "rep").join(roots, "node"), "linked")
    least = materialise(linked.groupBy("root").agg(F.min("rep").alias("component")), "components")
    named = linked.join(broadcast_if_small(least), "root").select("node", "component")
    return distinct.join(named, "node", "left").select(*columns, F.coalesce("component", "rep").alias("component"))


def near_links(fingerprints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between nodes that connect all fingerprints within ``radius`` bits. ``fingerprints``: one row (fp, node) for each."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(block_masks(radius))])
    keyed = fingerprints.select("node", F.explode(keys).alias("k")).select("node", "k.t", "k.key")
    shared = sizes_of(keyed)
    hot = shared.filter(F.col("n") > HOT)
    parts = dealt(keyed, shared.filter(F.col("n") <= HOT), fingerprints, ["fp"])
    links = parts.mapInPandas(forests(["fp"], lambda fps, group: linked_pairs(fps, group, radius)), "a long, b long")
    if hot.isEmpty():
        return links
    longer = materialise(refined(keyed, hot, fingerprints, radius), "longer")
    more = dealt(longer, sizes_of(longer), fingerprints, ["fp"])
    return links.unionByName(more.mapInPandas(forests(["fp"], lambda fps, group: linked_pairs(fps, group, radius)), "a long, b long"))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, fp (the fingerprint as a signed long), component_id.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest
    doc_id reachable. Texts without words (null, empty, white space) have fingerprint 0 and link like any
    other. A null id counts as the largest; a component of null ids only has component_id null. Repeated rows
    are rows of one component. An empty table gives an empty result; other columns are ignored.
    """

    def make():
        def step(columns):
            return [columns[0], [signed(fingerprint(t, shingle)) for t in columns[1]]]

        return step

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    light = materialise(map_rows(texts, make, "doc_id long, fp long"), "simhash")
    distinct = materialise(light.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep")).withColumn("node", F.col("fp")), "distinct")
    of_fp = components_of(distinct, near_links(distinct, radius), ["fp"])
    return light.join(of_fp, "fp").select("doc_id", "fp", F.nullif("component", F.lit(NO_ID)).alias("component_id"))


#: For similar texts of any kind: Jaccard similarity ALIKE[0] / ALIKE[1] of the shingle sets, exactly.
ALIKE = (4, 5)
#: Sets meet where the fingerprints of one of SAMPLES samples of their shingles have the same distances to all PIVOTS. A sample takes each
#: shingle by its hash, with a chance that depends on the set's size only, so that similar sets often have exactly the same sample:
#: with chance 0.25 or more at 0.8, so that 1 - (1 - 0.25)^SAMPLES (0.99999) meet, however large the corpus is.
SAMPLES = 40
FACTORS, OFFSETS = (np.array([xxhash.xxh32_intdigest(i.to_bytes(8, "little"), SEED + s) | 1 for i in range(SAMPLES)], dtype=np.uint32) for s in (0, 1))


def size_classes(most: int = 1 << 31) -> np.ndarray:
    """Least sizes of classes such that similar sets are in the same or in adjacent ones."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, ALIKE[1] * (edges[-1] - 1) // ALIKE[0] + 1))
    return np.array(edges, dtype=np.int64)


CLASSES = size_classes()
#: By class: below which hash a shingle is in the sample (for about 3.5 shingles and more), and how many make one (fewer are common to unlike sets).
LIMITS = (np.minimum(0.35, 1 - np.exp(-3.5 / CLASSES)) * (1 << 32)).astype(np.uint32)
ENOUGH = np.where(CLASSES < 16, 1, 3)
#: 256 bits tell which sets of a group are worth comparing: sets of similarity j differ in arccos(2j / (1 + j)) / pi of
#: the bits, 39 at 0.8 (deviation 6; 48 and 6 for sets of 4 and 5). Pairs over WIDE_RADIUS are let go (0.47 by the mean).
WIDE_WORDS, WIDE_RADIUS = 4, 72
#: Rows and elements of a block of an open group, about, and columns of a piece of its membership matrix.
WIDE_BLOCK, BLOCK_ELEMENTS, PIECE = 1024, 1_000_000, 4096


def mix(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from a hash (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (word + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """WIDE_WORDS signed longs of majority bits over distinct shingles; zeros without any."""
    return [signed(majority(mix(hashes, w))) for w in range(WIDE_WORDS)] if len(hashes) else [0] * WIDE_WORDS


def samples(hashes: np.ndarray, levels: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the shingles in each sample of the classes ``levels``, by place: a class has the first or the second half of the places, by turns."""
    high, places, held = (hashes >> np.uint64(32)).astype(np.uint32), [], []
    for at in range(0, len(hashes), 2048):  # so that long texts stay in the cache
        with np.errstate(over="ignore"):
            value = high[at : at + 2048, None] * FACTORS + OFFSETS
        row, t = np.nonzero(value < LIMITS[levels[0]])
        value = value[row, t]
        for level in levels:
            within = value < LIMITS[level]  # the limits fall from class to class
            places.append(t[within] + level % 2 * SAMPLES)
            held.append(hashes[at + row[within]])
    place, held = np.concatenate(places), np.concatenate(held)
    order = np.argsort(place, kind="stable")
    return place[order], held[order]


def pivot_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether there is one) of a set of hashes: for each sample in the set's class of sizes and in the one below, its fingerprint's row of the pivot table.

    Samples whose rows differ are different (the triangle inequality at radius 0). Sets of fewer than two shingles are like no other and have none.
    """
    keys, there = np.zeros(2 * SAMPLES, dtype=np.uint64), np.zeros(2 * SAMPLES, dtype=bool)
    own = int(np.searchsorted(CLASSES, len(hashes), side="right")) - 1
    if own < 1:
        return keys, there
    place, held = samples(hashes, (own - 1, own))
    if len(place):
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        sizes = np.diff(starts, append=len(place))
        bits = np.unpackbits(held.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        prints = np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").astype(np.uint64)
        near = np.bitwise_count(prints ^ PIVOTS).view(np.uint64)
        at = place[starts]
        level = np.where(at // SAMPLES == own % 2, own, own - 1)
        keys[at] = mix(mix(near[:, 0] ^ mix((level * SAMPLES + at % SAMPLES).astype(np.uint64), 0), 1) ^ near[:, 1], 2)
        there[at] = sizes >= ENOUGH[level]
    return keys, there


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set, of which similar sets share one at the same place; those that it lacks are like no other set's."""
    keys, there = pivot_keys(hashes)
    lacking = mix(np.arange(len(keys), dtype=np.uint64), 3) ^ np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
    return np.where(there, keys, lacking)


def fits_in(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements can be similar at all."""
    return ALIKE[1] * np.minimum(n, m) >= ALIKE[0] * np.maximum(n, m)


def common_elements(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common, by products of pieces of their membership matrix."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = holders[column] > 1  # the others are in one set only
    _, column = np.unique(column[shared], return_inverse=True)
    rows = rows[shared]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, PIECE):
        i, j = np.searchsorted(column, [start, start + PIECE])
        piece = np.zeros((len(sets), PIECE), dtype=np.float32)
        piece[rows[i:j], column[i:j] - start] = 1.0
        out += piece @ piece.T
    return out.astype(np.int64)


def open_links(columns: list[str]):
    """Of partitions sorted by group: links (a, b) that connect what each group connects.

    Of pairs of different components and fitting sizes, pivot tables of blocks of the wide fingerprints discard those over WIDE_RADIUS;
    the sets of the others' rows are compared exactly. A group (bi < 0, bj) has a block of the key's largest component and one of the rest.
    """

    def links(part: pd.DataFrame) -> pd.DataFrame:
        group = (part[GROUP] != part[GROUP].shift()).any(axis=1).cumsum().to_numpy()
        fps = part[columns].to_numpy().astype(np.int64).view(np.uint64)
        size, component, bulk, mixed = (part[c].to_numpy() for c in ("elements", "component", "bulk", "bi"))
        may = lambda i, j: (component[i] != component[j]) & fits_in(size[i], size[j]) & ((mixed[i] >= 0) | (bulk[i] != bulk[j]))
        i, j = linked_pairs(fps, group, WIDE_RADIUS, may, by_block=True)
        node, shingles = part["node"].to_numpy(), part["shingles"].to_numpy()
        order = np.argsort(group[i], kind="stable")
        i, j = i[order], j[order]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for of in np.split(np.arange(len(i)), np.flatnonzero(np.diff(group[i])) + 1) if len(i) else []:
            used, at = np.unique(np.concatenate([i[of], j[of]]), return_inverse=True)
            x, y = at[: len(of)], at[len(of) :]
            common = common_elements([unpacked(shingles[u]) for u in used])[x, y]
            alike = ALIKE[1] * common >= ALIKE[0] * (size[used][x] + size[used][y] - common)
            root = forest(len(used), x[alike], y[alike])
            moved = np.flatnonzero(root != np.arange(len(used)))
            a.append(node[used[moved]])
            b.append(node[used[root[moved]]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return whole_groups(links, 1)  # sets may be long


def packed(hashes: np.ndarray) -> bytes:
    """A set of hashes by the first 40 bits of each; a chance agreement of two in the union of sets of thousands is 1 in 10,000."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, 3:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel().astype(np.uint64)


def alike(a: bytes, b: bytes) -> bool:
    """Whether two packed sets have at least the similarity."""
    x, y = unpacked(a), unpacked(b)
    common = len(np.intersect1d(x, y))
    return ALIKE[1] * common >= ALIKE[0] * (len(x) + len(y) - common)


def shingle_sets(texts: DataFrame, owners: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the texts of ``owners`` (owner, own_th: a row's id and hash of its text); the sets are made again, so that only texts with candidates move."""
    held = texts.join(broadcast_if_small(owners), (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("owner")) & (F.col("th") == F.col("own_th")), "left_semi").select("text")

    def make():
        def step(columns):
            hashes = [np.unique(shingle_hashes(t, shingle)) for t in columns[0]]
            return [[set_node(h) for h in hashes], [packed(h) for h in hashes]]

        return step

    return materialise(map_rows(held, make, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}"))

    def compare():
        def step(columns):
            links = [(a, b) for a, b, x, y in zip(*columns, strict=True) if alike(x, y)]
            return [[p[0] for p in links], [p[1] for p in links]]

        return step

    return map_rows(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b"), compare, "a long, b long")


def set_node(hashes: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def stars(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b): every node with the least node b of each key that it shares. Their number is linear in the keys, however hot one is."""
    heads = materialise(keyed.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "b"), "heads")
    return keyed.join(heads, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def open_rows(keyed: DataFrame, named: DataFrame) -> DataFrame:
    """(node, key, component) of the keys of more than two nodes that are not all of one component. ``named``: (node, component) of all nodes that share keys."""
    here = keyed.join(named, "node")
    keys = here.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high AND n > 2")
    return here.join(materialise(keys.select("key"), "open"), "key", "left_semi").select("node", "key", "component")


def open_groups(rows: DataFrame, distinct: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """The nodes of open keys with their sets, in partitions sorted by the groups in which they meet again.

    ``rows``: (node, key, component). A key's largest component meets the rest only, never itself, so that a few rows beside one
    very large component cost rows in proportion; where the rest has several blocks, every pair of its blocks is a group.
    """
    keyed = rows.join(distinct.select("node", "elements"), "node")
    sizes = keyed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("elements").alias("e"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("m", "component", "e")).alias("top"), F.sum("m").alias("n"), F.sum("e").alias("e"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda n, e: F.ceil(F.greatest(n / F.lit(WIDE_BLOCK), e / F.lit(BLOCK_ELEMENTS))).cast("int")
    keys = materialise(keys.select("key", F.col("top.component").alias("largest"), blocks(F.col("top.m"), F.col("top.e")).alias("of_bulk"), blocks(F.col("n") - F.col("top.m"), F.col("e") - F.col("top.e")).alias("of_rest")), "open")
    met = keyed.drop("elements").join(keys, "key").join(distinct.select("node", *columns), "node").join(sets, "node")
    bulk = F.col("component") == F.col("largest")
    own = F.pmod(F.xxhash64("node"), F.when(bulk, F.col("of_bulk")).otherwise(F.col("of_rest"))).cast("int")
    pair = lambda i, j: F.struct(i.alias("bi"), j.alias("bj"))
    of_bulk = F.transform(F.sequence(F.lit(0), F.col("of_rest") - 1), lambda r: pair(-1 - F.col("own"), r))
    of_rest = F.concat(F.transform(F.sequence(F.lit(0), F.col("of_bulk") - 1), lambda b: pair(-1 - b, F.col("own"))), F.transform(F.sequence(F.lit(0), F.col("of_rest") - 1), lambda r: pair(F.least("own", r), F.greatest("own", r))))
    met = met.withColumn("own", own).withColumn("bulk", bulk.cast("int")).withColumn("g", F.explode(F.when(bulk, of_bulk).otherwise(of_rest)))
    met = met.select(F.lit(0).alias("t"), "key", "g.bi", "g.bj", "node", "component", "bulk", *columns, "shingles")
    return met.repartition(*GROUP).sortWithinPartitions(*GROUP)


def similar_rows(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, least) for each row: a hash of its text, and (id, th) of the least row of its component (a null id as NO_ID). See ``similar_components``."""
    words = [f"f{w}" for w in range(WIDE_WORDS)]
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def make():
        def step(columns):
            hashes = [np.unique(shingle_hashes(t, shingle)) for t in columns[2]]
            prints, keys = [wide_fingerprint(h) for h in hashes], [pivot_keys(h) for h in hashes]
            return [columns[0], columns[1], [set_node(h) for h in hashes], [len(h) for h in hashes], *([p[w] for p in prints] for w in range(WIDE_WORDS)), [k[there].view(np.int64) for k, there in keys]]

        return step

    light = materialise(map_rows(texts, make, "doc_id long, th long, node long, elements long, " + ", ".join(f"{w} long" for w in words) + ", keys array<long>"), "wide")
    columns = [*words, "elements"]
    row = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th")
    distinct = materialise(light.groupBy("node").agg(F.min(row).alias("rep"), *[F.first(c).alias(c) for c in (*columns, "keys")]), "distinct")
    keyed = distinct.select("node", F.explode("keys").alias("key"))
    tried = materialise(stars(keyed), "stars")
    met = materialise(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met")
    owners = materialise(distinct.select("node", "rep").join(met, "node", "left_semi").select(F.col("rep.id").alias("owner"), F.col("rep.th").alias("own_th")).distinct(), "owners")
    sets = shingle_sets(texts, owners, shingle)
    roots = materialise(connected_components(compared(tried, sets)), "roots")
    named = met.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    parts = open_groups(materialise(open_rows(keyed, named), "open-rows"), distinct, sets, columns)
    more = materialise(parts.mapInPandas(open_links(words), "a long, b long").distinct(), "links")
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return light.select("doc_id", "th", "node").join(components_of(distinct, links, ["node"]), "node").select("doc_id", "th", F.col("component").alias("least"))


def similar_components(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for texts whose shingle sets have a Jaccard similarity of at least ALIKE.

    Sets meet where fingerprints of samples of their shingles have the same row in the pivot table (see SAMPLES), whose recall does not
    depend on the size of the corpus. First each set is compared with the least of every key that it shares, which joins nearly
    all copies at a cost linear in the keys. Then the sets under keys that are not all of one component meet again; in each group pivot
    tables of blocks of the whole sets' fingerprints discard, the rest are compared, and a spanning forest of links is returned, not all pairs. Only sets
    that are similar (by hashes of 40 bits) are linked. Nulls, empty texts and repeats are as in ``simhash_components``.
    """
    return similar_rows(docs, shingle, id_col, text_col).select("doc_id", F.nullif("least.id", F.lit(NO_ID)).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one of each group of similar texts: that of the smallest id (null ids are the largest).

    Rows are told apart by id and text, so rows that share an id or have none are judged each by its own text; of several of one id in
    a group the one whose text has the least hash stays. Only rows alike in both, which nothing tells apart, stay together. Null and
    empty texts are alike. Very long texts are compared whole. An empty table gives an empty result; other columns pass
    through, whatever their names.
    """
    here, before = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th"), steps()
    rows = similar_rows(docs, shingle, id_col, text_col)
    lose = materialise(rows.filter(here != F.col("least")).select(F.col("doc_id").alias("__gl_id"), F.col("th").alias("__gl_th")).distinct(), "copies")
    forget(docs.sparkSession, steps() - before - {path_of(lose)})  # the result reads only these
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__gl_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("__gl_th"))
    return docs.join(broadcast_if_small(lose), same, "left_anti")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash_pivots": op5_simhash_pivots}
SQL: dict[str, str] = {}
