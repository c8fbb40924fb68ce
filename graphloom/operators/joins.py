"""Join-shaped operators over benchmark rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import retrieve
from .selection import SEED, hash_key, unit_interval


def join_predictions(predictions: DataFrame, items: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(joined, unknown): predictions with their items, and predictions of ids that no item has."""
    return predictions.join(items, id_col), predictions.join(items.select(id_col), id_col, "left_anti")


def paired(a: DataFrame, b: DataFrame, metric: str, id_col: str = "id") -> DataFrame:
    """(id, a, b, status): the metric of two models on each item; status is paired, only_a or only_b."""
    left, right = a.select(id_col, F.col(metric).alias("a"), F.lit(1).alias("_in_a")), b.select(id_col, F.col(metric).alias("b"), F.lit(1).alias("_in_b"))
    status = F.when(F.col("_in_a").isNull(), "only_b").when(F.col("_in_b").isNull(), "only_a").otherwise("paired")
    return left.join(right, id_col, "full_outer").select(id_col, "a", "b", status.alias("status"))


def overlapping(df: DataFrame, other: DataFrame, key: Column) -> DataFrame:
    """Rows of ``df`` whose key also occurs in ``other``."""
    return df.withColumn("_k", key).join(other.select(key.alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def flagged(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """``flag``: whether the key occurs in ``other``."""
    marks = other.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def cosine_neighbours(df: DataFrame, tokens: str, k: int, id_col: str = "id", group: str | None = None, leakage: float = 0.995) -> DataFrame:
    """(id, other, similarity, rank): each row's ``k`` most similar rows by bag-of-words cosine, below the leakage cut-off; see ``retrieval.retrieve``."""
    return retrieve(df, df, tokens, k, leakage, group, id_col=id_col)


def few_shot(df: DataFrame, pool: DataFrame, group: str, category: str, k: int, mode: str = "ordered", id_col: str = "id", seed: str = SEED) -> DataFrame:
    """(id, shot, rank): ``k`` examples of the same group for each item, same category first, then by id or (``random``) by a hash of item and example.

    In order, the same examples come first for all items of a cell, so only the k + 1 first of each cell and group are joined. At
    random every example has its own place for each item: a cell's examples are drawn from a hashed ring, k + 1 from the
    item's place on, so again only so many are joined.
    """
    shots = pool.select(F.col(id_col).alias("shot"), F.col(group).alias("_g"), F.col(category).alias("_c"))
    if mode == "ordered":
        place = F.col("shot")
    elif mode == "random":
        place = hash_key("shot", seed)
    else:
        raise ValueError(f"unknown mode {mode}")
    firsts = lambda keys: shots.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(place)))
    items = df.select(id_col, F.col(group).alias("_g"), F.col(category).alias("_own"))
    if mode == "ordered":
        first = firsts(["_g", "_c"]).filter(F.col("_at") <= k + 1).select("_g", "_c", "shot")
        pairs = items.join(first, "_g").filter(F.col(id_col) != F.col("shot"))
        w = Window.partitionBy(id_col).orderBy((F.col("_own") != F.col("_c")).cast("int"), "shot")
        return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(id_col, "shot", "rank")
    ring = firsts(["_g", "_c"])
    sizes = ring.groupBy("_g", "_c").agg(F.count(F.lit(1)).alias("_n"))
    start = F.floor(unit_interval(F.col(id_col), F.col("_c"), seed=seed) * F.col("_n")).cast("int")
    steps = F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n").cast("int") - 1))
    wanted = items.join(sizes, "_g").withColumn("_step", F.explode(steps)).withColumn("_at", ((start + F.col("_step")) % F.col("_n") + 1).cast("int"))
    pairs = wanted.join(ring, ["_g", "_c", "_at"]).filter(F.col(id_col) != F.col("shot"))
    w = Window.partitionBy(id_col).orderBy((F.col("_own") != F.col("_c")).cast("int"), "_step", "_c")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(id_col, "shot", "rank")


def scored_shots(df: DataFrame, pool: DataFrame, group: str, tokens: str, signature: str, k: int, most: float = 0.9, exclude_match: bool = False, id_col: str = "id") -> DataFrame:
    """(id, shot, similarity, signature_match, rank): the ``k`` examples of the same group whose questions are most similar by cosine, below ``most``.

    Examples without a common word (similarity 0) follow by id where fewer are similar. See ``retrieval.retrieve``.
    """
    rows = retrieve(df, pool, tokens, k, most, group, signature, exclude_match, id_col=id_col).withColumnRenamed("other", "shot")
    own, other = df.select(F.col(id_col).alias("id"), F.col(signature).alias("_own")), pool.select(F.col(id_col).alias("shot"), F.col(signature).alias("_other"))
    return rows.join(own, "id").join(other, "shot").select("id", "shot", "similarity", (F.col("_own") == F.col("_other")).alias("signature_match"), "rank")


def judge_pairs(df: DataFrame, judge: str, item: str, decision: str) -> DataFrame:
    """(a, b, items, agree): agreement of each pair of judges on the items that both decided."""
    rows = df.filter(F.col(decision).isNotNull()).select(judge, item, decision)
    left, right = rows.toDF("a", "item", "da"), rows.toDF("b", "item", "db")
    return left.join(right, "item").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("da") == F.col("db")).cast("double")).alias("agree"))


def solve_rates(df: DataFrame, item: str, solved: str, models: int) -> DataFrame:
    """(item, evaluated, solved, rate, complete): over models; complete if all of them have a row."""
    out = df.groupBy(item).agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col(solved)).alias("solved"))
    return out.select(item, "evaluated", "solved", (F.col("solved") / F.col("evaluated")).alias("rate"), (F.col("evaluated") == models).alias("complete"))


def audit_status(items: DataFrame, audits: DataFrame, id_col: str, success: str, rows: str) -> DataFrame:
    """``gold_status``: not_audited, failed, empty or ok."""
    joined = items.join(audits.select(id_col, success, rows), id_col, "left")
    status = F.when(F.col(success).isNull(), "not_audited").when(~F.col(success), "failed").when(F.col(rows) == 0, "empty").otherwise("ok")
    return joined.withColumn("gold_status", status)


def atom_impact(items: DataFrame, changed: DataFrame, id_col: str, atoms: str) -> DataFrame:
    """(id, atom): the changed atoms that each item touches. ``changed`` has one column, atom.

    Atoms are ``kind:body``. label and rel match exactly; prop, relprop and cat match on the property and on owners, where
    ``*`` is any; patterns match on the type, with ``*`` for either end. Equal kind and last name are the join's
    key, the wildcards its condition.
    """

    def parts(atom: Column) -> Column:
        kind, body = F.substring_index(atom, ":", 1), F.expr("substring(_atom, instr(_atom, ':') + 1)")
        owned = kind.isin("prop", "relprop", "cat")
        pattern = r"^\(:([^)]*)\)-\[:([^\]]*)\]->\(:([^)]*)\)$"
        is_pattern = (kind == "pattern") & body.rlike(pattern)
        key = F.when(owned, F.substring_index(body, ".", -1)).when(is_pattern, F.regexp_extract(body, pattern, 2)).otherwise(body)
        left = F.when(owned, F.substring_index(body, ".", 1)).when(is_pattern, F.regexp_extract(body, pattern, 1)).otherwise("")
        right = F.when(is_pattern, F.regexp_extract(body, pattern, 3)).otherwise("")
        return F.struct(kind.alias("kind"), key.alias("key"), left.alias("l"), right.alias("r"))

    ours = items.select(id_col, F.explode(atoms).alias("_atom")).withColumn("i", parts(F.col("_atom"))).drop("_atom")
    theirs = changed.select(F.col("atom"), F.col("atom").alias("_atom")).withColumn("c", parts(F.col("_atom"))).drop("_atom")
    near = lambda a, b: (F.col(a) == F.col(b)) | (F.col(a) == "*") | (F.col(b) == "*")
    on = (F.col("i.kind") == F.col("c.kind")) & (F.col("i.key") == F.col("c.key")) & near("i.l", "c.l") & near("i.r", "c.r")
    return ours.join(theirs, on).select(id_col, "atom").distinct()


def stale_accuracy(stale: DataFrame, fresh: DataFrame, metric: str, id_col: str = "id") -> DataFrame:
    """One row: both, only_stale, only_fresh, neither, and the misestimate of accuracy in points."""
    joined = stale.select(id_col, F.col(metric).alias("s")).join(fresh.select(id_col, F.col(metric).alias("f")), id_col, "left")
    f = F.coalesce("f", F.lit(False))
    return joined.agg(
        F.count_if(F.col("s") & f).alias("both"), F.count_if(F.col("s") & ~f).alias("only_stale"), F.count_if(~F.col("s") & f).alias("only_fresh"), F.count_if(~F.col("s") & ~f).alias("neither"),
        F.round(100 * (F.avg(F.col("s").cast("double")) - F.avg(f.cast("double"))), 6).alias("misestimate_pp"),
    )


def subset_accuracy(df: DataFrame, subsets: Mapping[str, DataFrame], model: str, metric: str, id_col: str = "id") -> DataFrame:
    """(subset, model, n, accuracy) on each subset of ids."""
    out = None
    for name, ids in subsets.items():
        part = df.join(ids.select(id_col), id_col, "left_semi").groupBy(model).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(metric).cast("double")), 9).alias("accuracy")).select(F.lit(name).alias("subset"), model, "n", "accuracy")
        out = part if out is None else out.unionByName(part)
    return out


def corrected(items: DataFrame, corrections: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """The items with ``column`` taken from the corrections where they have it; adds ``was_corrected``."""
    fix = corrections.select(id_col, F.col(column).alias("_fix"))
    return items.join(fix, id_col, "left").withColumn("was_corrected", F.col("_fix").isNotNull()).withColumn(column, F.coalesce("_fix", column)).drop("_fix")


def drift(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """(…, side): keys that only one side has, missing (in b) or extra."""
    left, right = a.select(*key).distinct(), b.select(*key).distinct()
    return left.join(right, list(key), "left_anti").withColumn("side", F.lit("missing")).unionByName(right.join(left, list(key), "left_anti").withColumn("side", F.lit("extra")))


def cluster_keys(df: DataFrame, fallbacks: Sequence[str], id_col: str = "id") -> DataFrame:
    """``cluster`` and ``cluster_source``: the first fallback column that is not null, else the row is its own cluster."""
    pairs = [(F.col(c).isNotNull(), c) for c in fallbacks]
    source = F.lit("singleton")
    for cond, c in reversed(pairs):
        source = F.when(cond, c).otherwise(source)
    return df.withColumn("cluster", F.coalesce(*[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in fallbacks], F.concat(F.lit("id:"), F.col(id_col).cast("string")))).withColumn("cluster_source", source)


def few_shot_leakage(df: DataFrame, id_col: str, similarities: str, signature_matches: str, high: float = 0.9) -> DataFrame:
    """(id, shots, signature_match, high_similarity) from arrays about the chosen shots."""
    return df.select(id_col, F.size(similarities).alias("shots"), F.exists(signature_matches, lambda x: x).alias("signature_match"), F.exists(similarities, lambda x: x >= high).alias("high_similarity"))


def disagreements(df: DataFrame, item: str, decision: str) -> DataFrame:
    """(item, votes, for): items whose judges differ."""
    out = df.filter(F.col(decision).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("votes"), F.count_if(F.col(decision)).alias("for"))
    return out.filter((F.col("for") > 0) & (F.col("for") < F.col("votes")))


def unseen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys no earlier shard has."""
    return df.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def focus_reasons(items: DataFrame, rates: DataFrame, verdicts: DataFrame, id_col: str, passed: str) -> DataFrame:
    """``reasons``: why an item deserves a look: unsolved (no model solved it), disagreement (judges differ), unjudged. ``rates``: (id, solved)."""
    votes = verdicts.groupBy(id_col).agg(F.count_distinct(passed).alias("_ways"))
    joined = items.join(rates.select(id_col, F.col("solved").alias("_solved")), id_col, "left").join(votes, id_col, "left")
    reasons = F.array_compact(F.array(F.when(F.col("_solved") == 0, "unsolved"), F.when(F.col("_ways") > 1, "disagreement"), F.when(F.col("_ways").isNull(), "unjudged")))
    return joined.withColumn("reasons", reasons).drop("_solved", "_ways")


def resolve(df: DataFrame, known: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``value`` from the first of the keys that finds a row in ``known`` (one row a key), and ``resolved_by``; null and none if none does."""
    out, found = df, []
    for i, k in enumerate(keys):
        side = known.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(side, k, "left")
        found.append((f"_v{i}", k))
    by = F.lit("none")
    for v, k in reversed(found):
        by = F.when(F.col(v).isNotNull(), k).otherwise(by)
    return out.withColumn(value, F.coalesce(*[F.col(v) for v, _ in found])).withColumn("resolved_by", by).drop(*[v for v, _ in found])


def shot_metadata(df: DataFrame, id_col: str, shots: str, similarities: str, signatures: str, own: str) -> DataFrame:
    """(id, rank, shot, similarity, signature_match) of arrays of chosen shots."""
    rows = df.select(id_col, F.col(own).alias("_own"), F.posexplode(F.arrays_zip(F.col(shots).alias("shot"), F.col(similarities).alias("similarity"), F.col(signatures).alias("signature"))).alias("rank", "x"))
    return rows.select(id_col, (F.col("rank") + 1).alias("rank"), "x.shot", "x.similarity", (F.col("x.signature") == F.col("_own")).alias("signature_match"))
