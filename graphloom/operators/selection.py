"""Ranking, caps, splits, quotas and samples: window plans with hash order in place of random numbers."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import written
from .ranks import dealt, hash_places, hash_top, join_groups, left_groups, running_sums

SEED = "graphloom"
#: Rows of ``ordered_quota`` that are settled one after the other in a round.
AT_ONCE = 20_000
#: Best rows of a group that one task chooses from in a round; up to 1,000 the planner cuts each task's rows before they are exchanged.
POOL_ROWS = 1_000


def hash_key(id_: Column | str, seed: str = SEED) -> Column:
    """sha256 of ``seed:id`` in hex: a deterministic random order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), (F.col(id_) if isinstance(id_, str) else id_).cast("string")), 256)


def unit_interval(*keys: Column | str, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the keys' sha256, exact in a double and alike in other engines."""
    columns = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), *columns), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row of each key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def without_repeats(df: DataFrame, group: Sequence[str], order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Drop rows whose keys equal those of the row before, in each group's order."""
    w = Window.partitionBy(*group).orderBy(*order)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lag(k).over(w)) for k in keys])
    return df.withColumn("_same", same & (F.row_number().over(w) > 1)).filter(~F.col("_same")).drop("_same")


def cap_per_group(df: DataFrame, group: Sequence[str], limit: int, id_col: str = "id", seed: str = SEED) -> DataFrame:
    """At most ``limit`` rows of each group, in hash order; 0 keeps all. Adds ``dropped``, the group's rows that went."""
    if limit <= 0:
        return df.withColumn("dropped", F.lit(0).cast("long"))
    top = hash_top(df, group, hash_key(id_col, seed), limit, [id_col])  # a hot group is cut in its 256 parts first
    return top.withColumn("dropped", F.greatest(F.col("_n") - limit, F.lit(0))).drop("_rn", "_n")


def cap_round_robin(df: DataFrame, cell: Sequence[str], signature: str, limit: int, id_col: str = "id", seed: str = SEED) -> DataFrame:
    """At most ``limit`` rows of each cell, taken in rounds: one row of each signature (sorted), in hash order."""
    rounds = df.withColumn("_round", F.row_number().over(Window.partitionBy(*cell, signature).orderBy(hash_key(id_col, seed), id_col)))
    rounds = rounds.filter(F.col("_round") <= limit)  # no later round is reached, so a cell holds limit rows a signature at most
    return rounds.withColumn("_rn", F.row_number().over(Window.partitionBy(*cell).orderBy("_round", signature))).filter(F.col("_rn") <= limit).drop("_rn", "_round")


def split_counts(n: Column, test: float = 0.1, dev: float = 0.1) -> tuple[Column, Column]:
    """(test, dev) rows of a group of n: halves round to even, at least 1 each; one row is train, two are train and test."""
    t, d = F.greatest(F.bround(n * F.lit(test)), F.lit(1)).cast("long"), F.greatest(F.bround(n * F.lit(dev)), F.lit(1)).cast("long")
    full = t + d >= n
    some = lambda x, two: F.when(n <= 1, 0).when(n == 2, two).when(full, 1).otherwise(x).cast("long")
    return some(t, 1), some(d, 0)


def random_splits(df: DataFrame, group: Sequence[str], id_col: str = "id", test: float = 0.1, dev: float = 0.1, seed: str = SEED) -> DataFrame:
    """``split``: train, then dev, then test in each group's hash order."""
    placed = hash_places(df, group, hash_key(id_col, seed), [id_col])
    t, d = split_counts(F.col("_n"), test, dev)
    rn, n = F.col("_rn"), F.col("_n")
    return placed.withColumn("split", F.when(rn <= n - t - d, "train").when(rn <= n - t, "dev").otherwise("test")).drop("_rn", "_n")


def repair_splits(df: DataFrame, id_col: str = "id", split: str = "split") -> DataFrame:
    """Give each empty split the last row (by id) of the largest, if there are three rows at all.

    Only the three counts reach the driver.
    """
    counts = {r[0]: r[1] for r in df.groupBy(split).count().collect()}
    if sum(counts.values()) < 3:
        return df
    for name in ("train", "dev", "test"):
        if counts.get(name):
            continue
        donors = [s for s in ("train", "dev", "test") if counts.get(s, 0) > 1]
        if not donors:
            return df
        donor = max(donors, key=lambda s: counts[s])
        last = df.filter(F.col(split) == donor).agg(F.max(id_col)).first()[0]
        df = df.withColumn(split, F.when((F.col(split) == donor) & (F.col(id_col) == F.lit(last)), name).otherwise(F.col(split)))
        counts[donor] -= 1
        counts[name] = 1
    return df


def signature_splits(df: DataFrame, group: Sequence[str], signature: str, test: float = 0.1, dev: float = 0.1, seed: str = SEED) -> DataFrame:
    """``split`` with every signature of a group in one split.

    Signatures in hash order fill test up to its share, then dev, the rest is train; a group of fewer than three
    signatures is train. One running sum over the signatures decides: filling stops at the first prefix
    that reaches the target, and the last signature always stays for train. The sum is a prefix scan over ranges, so a group of many
    signatures is not one task.
    """
    key = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(g).cast("string") for g in group], F.col(signature).cast("string")), 256)
    sizes = df.groupBy(*group, signature).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", key)
    placed = running_sums(sizes, group, ["_k", signature], {"_before": F.col("_n"), "_at": F.lit(1)}, totals=True)
    target = lambda share: F.greatest(F.bround(F.col("_before_all") * F.lit(share)), F.lit(1))
    last = F.col("_at") + 1 == F.col("_at_all")
    placed = placed.withColumn("_test", (F.col("_before") < target(test)) & ~last)
    filled = placed.groupBy(*group).agg(F.sum(F.when(F.col("_test"), F.col("_n")).otherwise(0)).alias("_filled"))
    placed = join_groups(placed, filled, group)
    in_dev = ~F.col("_test") & (F.col("_before") - F.col("_filled") < target(dev)) & ~last
    split = F.when(F.col("_at_all") < 3, "train").when(F.col("_test"), "test").when(in_dev, "dev").otherwise("train")
    return df.join(placed.select(*group, signature, split.alias("split")), [*group, signature])


def split_leakage(df: DataFrame, block: str, split: str = "split") -> DataFrame:
    """(block, splits): blocks that lie in more than one split."""
    return df.groupBy(block).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def block_splits(df: DataFrame, block: str, shares: Mapping[str, float]) -> DataFrame:
    """Whole blocks, largest first, each to the split that is farthest below its share. Sequential over the blocks' sizes."""
    names = list(shares)

    def assign(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values(["n", "block"], ascending=[False, True])
        total, got, out = int(sizes["n"].sum()), dict.fromkeys(names, 0), []
        for n in sizes["n"]:
            to = max(names, key=lambda s: (shares[s] * total - got[s], -names.index(s)))
            got[to] += int(n)
            out.append(to)
        return pd.DataFrame({"block": sizes["block"].to_numpy(), "split": out})

    sizes = df.groupBy(F.col(block).cast("string").alias("block")).agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    placed = sizes.groupBy("_all").applyInPandas(assign, "block string, split string")
    return df.join(placed, df[block].cast("string") == placed["block"]).drop(placed["block"])


#: Weights of the terms of example selection, and of the penalty of a soft cap: fixed values.
TERM_WEIGHTS = {"signature": 0.24, "family": 0.18, "substructures": 0.22, "schema_atoms": 0.14, "values": 0.08, "tokens": 0.10, "quality": 0.04, "operators": 0.03}
CAP_PENALTY, SIGNATURE_SHARE, FAMILY_SHARE = 0.35, 0.20, 0.25


def picked(rows: pd.DataFrame, features: Mapping[str, tuple[str, float]], target: int, quality: tuple[str, float] | None, lexical: tuple[str, float] | None, caps: Sequence[tuple[str, float, float]], before: int = 0, last: int | None = None) -> list[int]:
    """Places of the rows that a greedy selection takes, in order; ``rows`` are the ``before`` ones that were taken already, in their order, and others sorted by id.

    No term ever grows while rows are chosen, so a gain that was computed before is a bound: a heap gives the row with the greatest one, and
    only that is computed anew. ``last`` is the place of a row that all rows that are missing here come after as things are at the start: the selection ends
    when the next row comes after it, too.
    """
    sets = {f: [frozenset(v) for v in rows[c]] for f, (c, _) in features.items()}
    words = [frozenset(v) for v in rows[lexical[0]]] if lexical else []
    limited = [[frozenset(v) for v in rows[c]] for c, _, _ in caps]
    most = [max(2, math.ceil(target * share)) for _, share, _ in caps]
    base = (rows[quality[0]].astype(float) * quality[1]).tolist() if quality else [0.0] * len(rows)
    seen, used, chosen = {f: set() for f in features}, [{} for _ in caps], []
    nearest, compared = [0.0] * len(rows), [0] * len(rows)

    def gain(i: int) -> float:
        out = base[i]
        for f, (_, weight) in features.items():
            own = sets[f][i]
            out += weight * (len(own - seen[f]) / len(own) if own else 0.0)
        if lexical:
            for j in chosen[compared[i] :]:
                union = len(words[i] | words[j])
                nearest[i] = max(nearest[i], len(words[i] & words[j]) / union if union else 1.0)
            compared[i] = len(chosen)
            out += lexical[1] * (1.0 - nearest[i])
        for n, (_, _, penalty) in enumerate(caps):
            if any(used[n].get(v, 0) >= most[n] for v in limited[n][i]):
                out -= penalty
        return out

    def take(i: int) -> None:
        chosen.append(i)
        for f in features:
            seen[f] |= sets[f][i]
        for n in range(len(caps)):
            for v in limited[n][i]:
                used[n][v] = used[n].get(v, 0) + 1

    for i in range(before):
        take(i)
    heap = [(-gain(i), i, before) for i in range(before, len(rows))]
    end = next((x[:2] for x in heap if x[1] == last), None)
    heapq.heapify(heap)
    while heap and len(chosen) < target:
        value, i, known = heapq.heappop(heap)
        if known < len(chosen):
            heapq.heappush(heap, (-gain(i), i, len(chosen)))
            continue
        if end and len(chosen) > before and (value, i) > end:
            break
        take(i)
    return chosen[before:]


def kinds_of(df: DataFrame, group: str, id_col: str, columns: Sequence[str], k: int, quality: str | None) -> DataFrame:
    """(_g, _id, _q with ``quality``, the array columns as sets, _target): the ``k`` least ids of each kind of row.

    Rows alike in all columns that count always gain the same, so only these can be chosen; that the others go first changes nothing.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(id_col).alias("_id"), *([F.coalesce(F.col(quality).cast("double"), F.lit(0.0)).alias("_q")] if quality else []), *[F.array_distinct(F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array()).cast("array<string>")).alias(c) for c in columns])
    rows = join_groups(rows, rows.groupBy("_g").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("_target")), ["_g"])
    kind = [*(["_q"] if quality else []), *columns]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_g", *kind).orderBy("_id"))).filter(F.col("_rn") <= k).drop("_rn")


def columns_of(features: Mapping[str, tuple[str, float]], lexical: tuple[str, float] | None, caps: Sequence[tuple[str, float, float]]) -> list[str]:
    return [*dict.fromkeys([*[c for c, _ in features.values()], *([lexical[0]] if lexical else []), *[c for c, _, _ in caps]])]


def diverse_selection(df: DataFrame, group: str, id_col: str, features: Mapping[str, tuple[str, float]], k: int, quality: tuple[str, float] | None = None, lexical: tuple[str, float] | None = None, caps: Sequence[tuple[str, float, float]] = (), pool_rows: int = POOL_ROWS) -> DataFrame:
    """(group, id, pick): greedy maximal-marginal selection of ``k`` rows in each group.

    ``features``: name -> (array<string> column, weight): a row gains the weight times the share of its values that no chosen row has (none: 0).
    ``lexical``: (array column, weight) times one less the greatest Jaccard similarity to a chosen row. ``quality``: (column, weight). ``caps``:
    (array column, share of the rows to choose, penalty): the penalty is taken once a value has its share (2 at least). Ties go to the lesser id.

    The order is the exact greedy one in groups of any size. All rows are scored, and one task takes the ``pool_rows`` best of a group. As gains
    never grow, its choices are those of the whole group until a row comes after the last of the pool; then all rows are scored again, against what is chosen.
    Each round chooses one row at least, so there are k at most, and no task has more of a group than its pool. Null groups are a group; null arrays are empty.
    """
    columns, none, by_id = columns_of(features, lexical, caps), F.array().cast("array<string>"), [F.col("_id").asc_nulls_last(), F.col("_row")]
    rows = written(kinds_of(df, group, id_col, columns, k, quality[0] if quality else None).withColumn("_row", F.monotonically_increasing_id()), "kinds")
    score = ("_q", quality[1]) if quality else None

    def state(chosen: DataFrame) -> DataFrame:
        """What the rows of a group that has not its target are scored against: values seen, word sets, values that have their share."""
        every = chosen.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.first("_target").alias("_most"), *[F.flatten(F.collect_list(c)).alias(f"_all_{c}") for c in columns], *([F.collect_list(lexical[0]).alias("_near")] if lexical else []))
        every = every.filter("_n < _most").withColumns({f"_seen_{c}": F.array_distinct(f"_all_{c}") for c in columns})
        full = lambda c, share: F.filter(f"_seen_{c}", lambda v: F.size(F.filter(f"_all_{c}", lambda x: x == v)) >= F.greatest(F.lit(2), F.ceil(F.col("_most") * F.lit(float(share)))))
        return every.withColumns({f"_full{n}": full(c, share) for n, (c, share, _) in enumerate(caps)}).drop("_n", "_most", *[f"_all_{c}" for c in columns])

    def gain(first: bool) -> Column:
        """As in ``picked``: the same sums in the same order."""
        out = F.col("_q") * F.lit(float(quality[1])) if quality else F.lit(0.0)
        for c, weight in features.values():
            new = F.size(c) if first else F.size(F.array_except(c, f"_seen_{c}"))
            out = out + F.lit(float(weight)) * F.when(F.size(c) > 0, new / F.size(c)).otherwise(0.0)
        if lexical:
            union = lambda w: F.size(F.array_union(F.col(lexical[0]), w))
            alike = lambda w: F.when(union(w) > 0, F.size(F.array_intersect(F.col(lexical[0]), w)) / union(w)).otherwise(1.0)
            out = out + F.lit(float(lexical[1])) * (1.0 - (F.lit(0.0) if first else F.aggregate("_near", F.lit(0.0), lambda m, w: F.greatest(m, alike(w)))))
        for n, (c, _, penalty) in enumerate(caps):
            out = out if first else out - F.when(F.arrays_overlap(c, f"_full{n}"), F.lit(float(penalty))).otherwise(0.0)
        return out

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at").reset_index(drop=True)
        before, last = int((pdf["_pick"] > 0).sum()), pdf.index[pdf["_place"] == pool_rows]
        places = picked(pdf, features, int(pdf["_target"].iloc[0]), score, lexical, caps, before, int(last[0]) if len(last) else None)
        return pd.DataFrame({"_row": pdf["_row"].loc[places].tolist(), "_pick": range(before + 1, before + 1 + len(places))})

    best, order = Window.partitionBy("_g").orderBy(F.desc("_gain"), *by_id), Window.partitionBy("_g").orderBy(F.col("_pick").asc_nulls_last(), *by_id)
    chosen, scored = None, rows.withColumn("_gain", gain(True))
    while True:
        pool = scored.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= pool_rows).select(*rows.columns, "_place", F.lit(None).cast("int").alias("_pick"))
        if chosen is not None:
            pool = pool.unionByName(join_groups(chosen.withColumn("_place", F.lit(0)), held.select("_g"), ["_g"]))
        found = pool.withColumn("_at", F.row_number().over(order)).groupBy("_g").applyInPandas(choose, "_row long, _pick int")
        found = written(rows.join(found, "_row"), "picked")
        chosen = found if chosen is None else chosen.unionByName(found)
        held = written(state(chosen), "held")
        if held.isEmpty():
            return chosen.select(F.col("_g").alias(group), F.col("_id").alias(id_col), F.col("_pick").alias("pick"))
        scored = join_groups(rows.join(chosen.select("_row"), "_row", "left_anti"), held, ["_g"]).withColumn("_gain", gain(False))


def selection_in_parts(df: DataFrame, group: str, id_col: str, features: Mapping[str, tuple[str, float]], k: int, quality: tuple[str, float] | None, lexical: tuple[str, float] | None, caps: Sequence[tuple[str, float, float]], part_rows: int) -> DataFrame:
    """(group, id, pick): an approximation of ``diverse_selection`` for those who ask for it; no query does.

    A group of more than ``part_rows`` (or 4 k) kinds of rows is dealt into parts by a hash of the id; each part picks k, and these are dealt
    again until one part holds them.
    """
    part_rows = max(part_rows, 4 * k)
    columns = columns_of(features, lexical, caps)
    rows = kinds_of(df, group, id_col, columns, k, quality[0] if quality else None)
    kind = [*(["_q"] if quality else []), *columns]
    score = ("_q", quality[1]) if quality else None
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_part").sort_values("_id").reset_index(drop=True)
        chosen = picked(pdf, features, int(pdf["_target"].iloc[0]), score, lexical, caps)
        return pdf.loc[chosen].assign(_pick=range(1, len(chosen) + 1))

    while True:
        sizes = rows.select("_g", *kind).distinct().groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("long").alias("_parts"))
        dealt_out = join_groups(rows, sizes, ["_g"]).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts"))).drop("_parts")
        found = dealt_out.groupBy("_g", "_part").applyInPandas(choose, f"{schema}, _pick int")
        if sizes.filter("_parts > 1").isEmpty():
            return found.select(F.col("_g").alias(group), F.col("_id").alias(id_col), F.col("_pick").alias("pick"))
        rows = written(found.drop("_pick"), "picked")


def example_selection(df: DataFrame, group: str, id_col: str, k: int, terms: Mapping[str, str], weights: Mapping[str, float] = TERM_WEIGHTS, part_rows: int | None = None, pool_rows: int = POOL_ROWS) -> DataFrame:
    """(group, id, pick): ``diverse_selection`` with the eight terms of benchmark examples and soft caps on signatures and template families.

    ``terms``: signature, family and operators (string columns), substructures, schema_atoms, values and tokens (array columns), quality -> column.
    Only a caller who gives ``part_rows`` gets the approximation of ``selection_in_parts``.
    """
    single = [t for t in ("signature", "family", "operators") if t in terms]
    rows = df.withColumns({f"_{t}": F.array(F.col(terms[t]).cast("string")) for t in single})
    column = {t: f"_{t}" if t in single else c for t, c in terms.items()}
    features = {t: (column[t], weights[t]) for t in ("signature", "family", "substructures", "schema_atoms", "values", "operators") if t in terms}
    caps = [(column[t], share, CAP_PENALTY) for t, share in (("signature", SIGNATURE_SHARE), ("family", FAMILY_SHARE)) if t in terms]
    quality = (terms["quality"], weights["quality"]) if "quality" in terms else None
    lexical = (column["tokens"], weights["tokens"]) if "tokens" in terms else None
    if part_rows is not None:
        return selection_in_parts(rows, group, id_col, features, k, quality, lexical, caps, part_rows)
    return diverse_selection(rows, group, id_col, features, k, quality, lexical, caps, pool_rows)


def entity_cap(df: DataFrame, group: Sequence[str], value: str, order: Sequence[str], limit: int) -> DataFrame:
    """``over_cap``: whether the value already had ``limit`` rows before this one, in order."""
    w = Window.partitionBy(*group, value).orderBy(*order)
    return df.withColumn("over_cap", F.row_number().over(w) > limit)


def ordered_quota(df: DataFrame, duplicates: Sequence[str], quotas: Mapping[str, tuple[Sequence[str], int]], order: Sequence[str], at_once: int = AT_ONCE) -> DataFrame:
    """``decision`` in acceptance order: duplicate if an accepted row has the key, else the first quota that accepted rows have filled, else accept.

    ``quotas``: name -> (columns, most accepted rows of each of their values); the key is a quota of 1. Only accepted rows count, so a
    decision depends on those before it. Two bounds close in on them: a row is surely accepted if even all rows that may still be
    accepted leave it room, and surely rejected if the surely accepted ones fill a quota before it. Rows that depend on each
    other in a long chain would settle one a round; so each round also settles the first ``at_once`` open rows of
    the order one after the other, in one task. There is no limit of rounds: each ends at least so many rows. Counts are
    prefix scans over ranges, so no value of a quota is one task; each round is written. ``order`` must tell rows apart.
    """
    limits = {"duplicate": (tuple(duplicates), 1)} | {f"quota:{n}": (tuple(c), q) for n, (c, q) in quotas.items()}
    part = {n: f"_part{i}" for i, n in enumerate(limits)}
    state = df.withColumn("sure", F.lit(False)).withColumn("gone", F.lit(False))
    for n, (columns, _) in limits.items():
        state = dealt(state, columns, order, part[n])

    def counted(rows: DataFrame) -> DataFrame:
        """How many rows before each are surely accepted (_t) and may be accepted (_p), for each limit."""
        for i, (n, (columns, _)) in enumerate(limits.items()):
            rows = running_sums(rows, columns, order, {f"_t{i}": F.col("sure").cast("int"), f"_p{i}": (~F.col("gone")).cast("int")}, part[n])
        return rows

    most = [q for _, q in limits.values()]
    full = reduce(lambda a, b: a | b, [F.col(f"_t{i}") >= q for i, q in enumerate(most)])
    room = reduce(lambda a, b: a & b, [F.col(f"_p{i}") < q for i, q in enumerate(most)])
    names = [*df.columns, *part.values()]
    while True:
        sure, gone = F.col("sure") | (~F.col("gone") & room), F.col("gone") | (~F.col("sure") & full)
        state = written(counted(state).select(*names, sure.alias("sure"), gone.alias("gone"), *[f"_t{i}" for i in range(len(most))]), "quota")
        still = state.filter("NOT sure AND NOT gone")
        if still.isEmpty():
            break
        # What is surely accepted before a row of the head may have grown in this round, so it is counted anew.
        head = counted(state.drop(*[f"_t{i}" for i in range(len(most))])).filter("NOT sure AND NOT gone").orderBy(*order).limit(at_once)
        keys = head.select(*order, *[F.to_json(F.struct(*c), {"ignoreNullFields": "false"}).alias(f"_k{i}") for i, (c, _) in enumerate(limits.values())], *[f"_t{i}" for i in range(len(most))], F.lit(0).alias("_head"))
        kinds = dict(df.dtypes)
        settled = keys.groupBy("_head").applyInPandas(in_turn(order, most), ", ".join(f"`{c}` {kinds[c]}" for c in order) + ", _yes boolean")
        settled = written(settled, "head")
        state = join_groups(state.drop(*[f"_t{i}" for i in range(len(most))]), settled, order, "left")
        state = state.withColumn("sure", F.col("sure") | F.coalesce("_yes", F.lit(False))).withColumn("gone", F.col("gone") | ~F.coalesce("_yes", F.lit(True))).drop("_yes")
    decision = F.lit("accept")
    final = counted(state.drop(*[f"_t{i}" for i in range(len(most))]))
    for i, (n, (_, q)) in reversed(list(enumerate(limits.items()))):
        decision = F.when(~F.col("sure") & (F.col(f"_t{i}") >= q), n).otherwise(decision)
    return final.withColumn("decision", decision).select(*df.columns, "decision")


def in_turn(order: Sequence[str], most: Sequence[int]):
    """Settles rows one after the other; they have the accepted rows before them that are known, without those among themselves."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order))
        taken: list[dict[str, int]] = [{} for _ in most]
        columns = [(rows[f"_k{i}"].tolist(), rows[f"_t{i}"].tolist()) for i in range(len(most))]
        yes = []
        for at in range(len(rows)):
            fits = all(known[at] + taken[i].get(keys[at], 0) < most[i] for i, (keys, known) in enumerate(columns))
            yes.append(fits)
            for i, (keys, _) in enumerate(columns):
                taken[i][keys[at]] = taken[i].get(keys[at], 0) + fits
        return rows[list(order)].assign(_yes=yes)

    return settle


def largest_remainder(df: DataFrame, share: str, total: int, key: str, group: Sequence[str] = ()) -> DataFrame:
    """``quota``: whole numbers that sum to ``total``, floors first and the rest by largest remainder (ties by key)."""
    w = Window.partitionBy(*group)
    exact = F.col(share) / F.sum(share).over(w) * total
    out = df.withColumn("_exact", F.round(exact, 9)).withColumn("_floor", F.floor("_exact"))
    left = F.lit(total) - F.sum("_floor").over(w)
    rn = F.row_number().over(w.orderBy(F.round(F.col("_floor") - F.col("_exact"), 9), key))
    return out.withColumn("_rn", rn).withColumn("quota", (F.col("_floor") + (F.col("_rn") <= left).cast("int")).cast("long")).drop("_exact", "_floor", "_rn")


def allocate(counts: Mapping[str, int], total: int, floor: int = 0, boost: Mapping[str, float] | None = None) -> dict[str, int]:
    """Proportional allocation to strata, never more than a stratum has, at least ``floor`` where it has as many.

    ``boost`` multiplies a stratum's weight. What caps free is dealt again, by largest remainder; ties go by name. Runs on the
    driver, over strata.
    """
    weight = {s: n * (boost or {}).get(s, 1.0) for s, n in counts.items()}
    out = {s: min(floor, n) for s, n in counts.items()}
    while (left := min(total, sum(counts.values())) - sum(out.values())) > 0:
        room = {s: counts[s] - out[s] for s in counts if counts[s] > out[s]}
        whole = sum(weight[s] for s in room) or 1.0
        exact = {s: min(left * weight[s] / whole, room[s]) for s in room}
        step = {s: int(x) for s, x in exact.items()}
        rest = left - sum(step.values())
        for s in sorted(room, key=lambda s: (step[s] - exact[s], s)):
            if rest > 0 and step[s] < room[s]:
                step[s] += 1
                rest -= 1
        for s, n in step.items():
            out[s] += n
    return out


def stratified_sample(df: DataFrame, strata: Sequence[str], per_stratum: int, id_col: str = "id", seed: str = SEED) -> DataFrame:
    """The first rows of each stratum in hash order, with ``weight`` = stratum rows / sampled rows."""
    out = hash_top(df, strata, hash_key(id_col, seed), per_stratum, [id_col])
    return out.withColumn("weight", F.col("_n") / F.least(F.col("_n"), F.lit(per_stratum))).drop("_rn", "_n")


def assign_annotators(df: DataFrame, annotators: Sequence[str], shared_every: int, order: Sequence[str]) -> DataFrame:
    """(…, annotator): every ``shared_every``-th row goes to all, the others in turn. Numbers the rows, so use it on a packet."""
    rn = F.row_number().over(Window.orderBy(*order)) - 1
    names = F.array(*[F.lit(a) for a in annotators])
    out = df.withColumn("_rn", rn).withColumn("shared", F.col("_rn") % shared_every == 0)
    return out.withColumn("annotator", F.explode(F.when(F.col("shared"), names).otherwise(F.array(F.element_at(names, (F.col("_rn") % len(annotators) + 1).cast("int")))))).drop("_rn")


def hash_fraction(df: DataFrame, keys: Sequence[str], fraction: float, seed: str = SEED) -> DataFrame:
    """Rows whose keys' hash is below the fraction; rows with equal keys go together."""
    return df.filter(unit_interval(*keys, seed=seed) < fraction)


def rotate(df: DataFrame, group: Sequence[str], order: Sequence[str], offset: int) -> DataFrame:
    """``turn``: the rows' order in each group, begun at ``offset``; places come from a prefix scan over ranges. ``order`` must tell a group's rows apart."""
    placed = running_sums(df, group, order, {"_at": F.lit(1)}, totals=True)
    return placed.withColumn("turn", F.pmod(F.col("_at") - F.lit(offset), F.col("_at_all")).cast("long")).drop("_at", "_at_all")


def fill_deficits(df: DataFrame, needs: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``used``: whether a candidate fills its group's ``need`` (a column of ``needs``); the rest is surplus. Places come from a prefix scan over ranges."""
    keyed = df.withColumns({f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)})
    placed = running_sums(keyed, group, [f"_o{i}" for i in range(len(order))], {"_at": F.lit(1)})
    out = left_groups(placed, needs, group)
    return out.withColumn("used", F.col("_at") < F.coalesce("need", F.lit(0))).drop("_at", *[f"_o{i}" for i in range(len(order))])


def carve_dev(df: DataFrame, group: Sequence[str], fraction: float, id_col: str = "id", seed: str = SEED) -> DataFrame:
    """``split``: dev for the first bround(n * fraction) rows of each group in hash order, else train."""
    placed = hash_places(df, group, hash_key(id_col, seed), [id_col])
    return placed.withColumn("split", F.when(F.col("_rn") <= F.bround(F.col("_n") * F.lit(fraction)), "dev").otherwise("train")).drop("_rn", "_n")


def tie_at_limit(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """One row (status, k): whether row k + 1 of the order (descending by keys) ties with row k.

    not_applicable if there are at most k rows. One top-(k + 1) pass instead of a second run with a larger limit.
    """
    top = df.orderBy(*[F.col(c).desc_nulls_first() for c in keys]).limit(k + 1)
    ranked = top.withColumn("_at", F.row_number().over(Window.orderBy(*[F.col(c).desc_nulls_first() for c in keys])))
    at = lambda n: F.max(F.when(F.col("_at") == n, F.struct(*keys)))
    out = ranked.agg(F.count(F.lit(1)).alias("n"), at(k).alias("a"), at(k + 1).alias("b"))
    return out.select(F.when(F.col("n") <= k, "not_applicable").when(F.col("a") == F.col("b"), "tie").otherwise("no_tie").alias("status"), F.lit(k).alias("k"))


def truncation(df: DataFrame, limit: int, ordered: bool) -> DataFrame:
    """One row (returned, unordered_limit, limit_reached): counts at most ``limit`` rows."""
    n = df.limit(limit).agg(F.count(F.lit(1)).alias("returned"))
    full = F.col("returned") >= limit
    return n.select("returned", (F.lit(not ordered and limit > 1) & full).alias("unordered_limit"), full.alias("limit_reached"))
