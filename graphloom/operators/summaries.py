"""Grouped summaries of benchmark and evaluation rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import left_groups, quantiles

#: First gate that blocks a record, in this order; issue codes by gate (fixed values).
GATE_ORDER = ("read_only", "syntax", "schema", "direction", "value", "validation")
ISSUE_GATES = {
    "not_read_only": "read_only",
    "syntax_shape": "syntax",
    "unbalanced_parentheses": "syntax",
    "unbalanced_brackets": "syntax",
    "reserved_variable": "syntax",
    "antlr_parse": "syntax",
    "unknown_label": "schema",
    "unknown_property": "schema",
    "unknown_relationship": "schema",
    "unknown_relationship_property": "schema",
    "missing_relationship_type": "schema",
    "invalid_categorical_value": "value",
    "unseen_relationship_pattern": "direction",
    "wrong_direction": "direction",
    "undirected_relationship": "direction",
    "bidirectional_relationship": "direction",
}
#: Words in a judge's reason that tell a schema or a meaning problem (fixed values).
SCHEMA_WORDS = ("schema", "label", "relationship", "property", "direction", "cypher")
MEANING_WORDS = ("answer", "intent", "semantic", "mismatch", "fails", "wrong")


def metric_means(df: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Means of the metrics (booleans as 0/1, nulls skipped) and rows, overall and by each key: one pass of grouping sets.

    Returns (dimension, value, n, <metric>...): dimension is ``all`` or a key's name.
    """
    rows = df.select(*[F.col(m).cast("double").alias(m) for m in metrics], *[F.col(k).cast("string").alias(k) for k in keys])
    sets = [[], *[[F.col(k)] for k in keys]]
    out = rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics], *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    pick = lambda one, other: reduce(lambda c, k: c.when(F.col(f"_g_{k}") == 0, one(k)), keys, F.when(F.lit(False), F.lit(None))).otherwise(F.lit(other))
    return out.select(pick(lambda k: F.lit(k), "all").alias("dimension"), pick(F.col, "all").alias("value"), "n", *metrics)


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The most common values; ties by value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def cross_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """(cell, n) with cell ``a::b``."""
    return df.groupBy(F.concat_ws("::", F.col(a).cast("string"), F.col(b).cast("string")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def export_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(dimension, value, n) for each key, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys])).alias("p")
    return df.select(pairs).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """total, unique, entropy_bits, normalized_entropy (1 for one value), effective_count, simpson and top_share of a column."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(*group, key).agg(F.count(F.lit(1)).alias("n"))
    n, total = F.col("n").cast("double"), F.sum("n").cast("double")  # sums of n log n and n n need no total beside each count
    entropy = F.log2(total) - F.sum(n * F.log2(n)) / total
    out = counts.groupBy(*group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique"), F.greatest(entropy, F.lit(0.0)).alias("entropy_bits"), (1 - F.sum(n * n) / (total * total)).alias("simpson"), (F.max("n") / total).alias("top_share"))
    widest = F.log2("unique")
    return out.withColumn("normalized_entropy", F.when(F.col("unique") > 1, F.col("entropy_bits") / widest).otherwise(1.0)).withColumn("effective_count", F.pow(F.lit(2.0), F.col("entropy_bits")))


def coverage(df: DataFrame, used: str, inventory: Sequence[str]) -> DataFrame:
    """(used, known, share) of an inventory that an array column covers."""
    known = F.array(*[F.lit(x) for x in inventory])
    return df.select(F.explode(used).alias("x")).agg(F.size(F.array_intersect(F.collect_set("x"), known)).alias("used")).select("used", F.lit(len(inventory)).alias("known"), (F.col("used") / F.lit(max(len(inventory), 1))).alias("share"))


def latency_summary(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, p95 (linear interpolation), max."""
    v = F.col(value).cast("double")
    plain = df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    return left_groups(plain, quantiles(df, v, {"median": 0.5, "p95": 0.95}, group), group).select(*group, "n", "mean", "median", "p95", "max")


def ordered(pairs: Sequence[tuple[Column, str]], otherwise: str | None) -> Column:
    """The first name whose condition holds."""
    out = F.when(pairs[0][0], pairs[0][1])
    for c, name in pairs[1:]:
        out = out.when(c, name)
    return out.otherwise(otherwise) if otherwise is not None else out


def blocking_gate(issues: Column, read_only: Column, syntax: Column, schema: Column, success: Column, rows: Column, passed: Column, reason: Column, accepted: Column) -> Column:
    """The first gate that keeps a record out: gates of its issue codes first, then failed checks, execution, emptiness, the judge."""
    gates = F.transform(issues, lambda i: F.coalesce(F.create_map(*[x for k, v in ISSUE_GATES.items() for x in (F.lit(k), F.lit(v))])[i], F.lit("validation")))
    judged = F.when(F.lower(reason).contains("duplicate") | F.lower(reason).contains("diversity"), "duplicate_or_diversity").otherwise("judge")
    by_issue = [(F.array_contains(gates, g), g) for g in GATE_ORDER]
    checks = [(~read_only, "read_only"), (~syntax, "syntax"), (~schema, "schema"), (~success, "execution"), (success & (rows == 0), "empty_result")]
    return F.coalesce(ordered([*by_issue, *checks], None), F.when(~passed, judged), F.when(accepted, "accepted"), F.lit("other_reject"))


def failure_reason(reason: Column, issues: Column, error: Column) -> Column:
    """Why a record failed, in words: the judge's reason, else its first issue, else the execution's error, else unknown."""
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(said(reason), F.get(issues, F.lit(0)), said(error), F.lit("unknown"))


def failure_bucket(accepted: Column, reason: Column, read_only: Column, syntax: Column, schema: Column, success: Column, rows: Column, passed: Column) -> Column:
    """The failure taxonomy's bucket of a record."""
    why = F.lower(F.coalesce(reason, F.lit("")))
    diverse = why.contains("duplicate") | why.contains("diversity") | why.contains("entity cap")
    return ordered(
        [
            (accepted, "accepted"), (diverse, "diversity_control"), (~read_only, "read_only_safety"), (~syntax, "syntax_invalid"), (~schema, "schema_invalid"),
            (~success, "execution_error"), (why.contains("execution returned no rows") | (success & (rows == 0)), "empty_result"), (~passed, "judge_reject"),
        ],
        "other_reject",
    )


def reason_bucket(reason: Column) -> Column:
    """A judge's reason by keywords, in this order."""
    why = F.lower(F.coalesce(reason, F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, [why.contains(w) for w in words])
    return ordered(
        [
            (has("duplicate", "diversity"), "diversity_control"), (has("generic node", "generic_node_scan"), "generic_node_scan"), (has("no rows"), "empty_result"), (has("ambiguous", "ambiguity"), "ambiguity"),
            (has(*SCHEMA_WORDS), "schema_mismatch"), (has(*MEANING_WORDS), "semantic_mismatch"),
        ],
        "other",
    )


def downstream_bucket(correct: Column, error: Column, parsed: Column, read_only: Column, schema: Column, success: Column, f1: Column) -> Column:
    """What kind of wrong an evaluated prediction is."""
    return ordered(
        [
            (correct, "correct"), (F.coalesce(error, F.lit("")) != "", "prediction_error"), (~parsed, "parse_invalid"), (~read_only, "unsafe_or_not_read_only"), (~schema, "schema_invalid"),
            (~success, "execution_failed"), (f1 > 0, "partial_answer_mismatch"), (success, "answer_mismatch"),
        ],
        "unknown_incorrect",
    )


def shares(df: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """(…, key, n, share of the group)."""
    counts = df.groupBy(*group, key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def issue_counts(df: DataFrame, issues: str, group: Sequence[str], accepted: str) -> DataFrame:
    """(…, issue, accepted, rejected): how often each issue occurs among both."""
    rows = df.select(*group, F.col(accepted).alias("_a"), F.explode(issues).alias("issue"))
    return rows.groupBy(*group, "issue").agg(F.count_if(F.col("_a")).alias("accepted"), F.count_if(~F.col("_a")).alias("rejected"))


def tag_rates(df: DataFrame, tags: str, category: str) -> DataFrame:
    """(category, tag, n, rate): in how many of a category's rows each tag occurs."""
    totals = df.groupBy(category).agg(F.count(F.lit(1)).alias("_t"))
    rows = df.select(category, F.explode(F.array_distinct(tags)).alias("tag")).groupBy(category, "tag").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(totals, category).select(category, "tag", "n", (F.col("n") / F.col("_t")).alias("rate"))


def spread(df: DataFrame, metric: str, group: Sequence[str]) -> DataFrame:
    """n, mean, sample sd (0 for one row) of runs."""
    return df.groupBy(*group).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("sd"))


def capacity(df: DataFrame, slots: str, category: str, per_template: int) -> DataFrame:
    """(category, templates, capacity): slotted templates give ``per_template`` items, others one."""
    slotted = F.col(slots) > 0
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("templates"), F.sum(F.when(slotted, per_template).otherwise(1)).alias("capacity"))


def transfer(df: DataFrame, model: str, control: str, metric: str) -> DataFrame:
    """(model, best_control, best, delta): a model's best control by mean metric, and what it gains over the worst."""
    means = df.groupBy(model, control).agg(F.round(F.avg(F.col(metric).cast("double")), 9).alias("m"))
    return means.groupBy(model).agg(F.max_by(control, F.struct("m", control)).alias("best_control"), F.max("m").alias("best"), F.round(F.max("m") - F.min("m"), 9).alias("delta"))


def spend(df: DataFrame, cost: str, cached: str, accepted: str, group: Sequence[str]) -> DataFrame:
    """calls, cost, cache-hit share and cost per accepted item of a ledger."""
    out = df.groupBy(*group).agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost"), F.avg(F.col(cached).cast("double")).alias("cached_share"), F.count_if(F.col(accepted)).alias("accepted"))
    return out.withColumn("per_accepted", F.when(F.col("accepted") > 0, F.col("cost") / F.col("accepted")))


def missing_against_targets(df: DataFrame, category: str, targets: Mapping[str, int]) -> DataFrame:
    """(category, target, have, missing) for every target."""
    wanted = F.explode(F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))])).alias("category", "target")
    goals = df.sparkSession.range(1).select(wanted)
    have = df.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("have"))
    return goals.join(have, "category", "left").select("category", "target", F.coalesce("have", F.lit(0)).alias("have"), F.greatest(F.col("target") - F.coalesce("have", F.lit(0)), F.lit(0)).cast("long").alias("missing"))


def thin_cells(df: DataFrame, cell: Sequence[str], tier: str, quotas: Mapping[str, float]) -> DataFrame:
    """Cells whose natural share of a tier is below half its quota."""
    table = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    have = shares(df, tier, cell)
    return have.withColumn("quota", table[F.col(tier)]).filter(F.col("share") < F.col("quota") / 2)


def modal_value(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties by sha256."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), F.sha2(F.col(value).cast("string"), 256))
    return counts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def checks(df: DataFrame, rules: Mapping[str, tuple[Column, str, float]]) -> DataFrame:
    """(check, value, passed): go/no-go over one aggregate row; each rule is (aggregate, '>=' or '<=', bound)."""
    row = df.agg(*[c.cast("double").alias(n) for n, (c, _, _) in rules.items()])
    parts = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("value"), (F.col(n) >= b if op == ">=" else F.col(n) <= b).alias("passed")) for n, (_, op, b) in rules.items()])
    return row.select(F.explode(parts).alias("x")).select("x.*")
