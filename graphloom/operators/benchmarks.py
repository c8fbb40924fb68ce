"""Whole-benchmark reports: external conversion, diversity, models, rank agreement, self-preference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.query_text import read_only
from .ranks import left_groups
from .statistics import cluster_sums
from .summaries import distribution


def convert_external(df: DataFrame, graph: str, question: str, query: str, aliases: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``decision`` for each outside row: other_graph, empty, not_read_only, duplicate (question and query seen before in order) or keep; and whether the question has several queries."""
    key, q = text.question_key(F.coalesce(question, F.lit(""))), text.squeeze(F.coalesce(query, F.lit("")))
    rows = df.withColumn("_k", key).withColumn("_q", q)
    wrong = F.when(~F.col(graph).isin(*aliases), "other_graph").when((F.col("_k") == "") | (F.col("_q") == ""), "empty").when(~read_only(F.col("_q")), "not_read_only")
    rows = rows.withColumn("_w", wrong)
    # Only rows without a reason are ranked, so that neither empty questions nor other graphs' rows are one large group.
    fine = rows.filter(F.col("_w").isNull())
    ranked = fine.withColumn("_rn", F.row_number().over(Window.partitionBy(graph, "_k", "_q").orderBy(*order)))
    ranked = ranked.unionByName(rows.filter(F.col("_w").isNotNull()).withColumn("_rn", F.lit(1)))
    ways = fine.groupBy(graph, "_k").agg(F.count_distinct("_q").alias("_ways"))
    out = left_groups(ranked, ways, [graph, "_k"])
    return out.withColumn("decision", F.coalesce("_w", F.when(F.col("_rn") > 1, "duplicate"), F.lit("keep"))).withColumn("ambiguous", F.coalesce("_ways", F.lit(0)) > 1).drop("_k", "_q", "_w", "_rn", "_ways")


def diversity_report(df: DataFrame, dimensions: Sequence[str], question: str, group: Sequence[str] = ()) -> DataFrame:
    """(…, dimension, total, unique, entropy_bits, normalized_entropy, effective_count, simpson, top_share) for columns and for question tokens."""
    parts = [distribution(df, d, group).withColumn("dimension", F.lit(d)) for d in dimensions]
    words = df.select(*group, F.explode(text.tokenize(F.col(question))).alias("token"))
    parts.append(distribution(words, "token", group).withColumn("dimension", F.lit("token")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_summary(df: DataFrame, model: str, metric: str, cluster: str, least_clusters: int = 30) -> DataFrame:
    """(model, n, micro, macro, clusters, design_effect, effective_n, few_clusters): micro over rows, macro over clusters; design effect by the variance of cluster totals."""
    sums = cluster_sums(df, cluster, metric, [model]).withColumn("mean", F.col("total") / F.col("rows"))
    per = sums.groupBy(model).agg(F.sum("rows").alias("n"), (F.sum("total") / F.sum("rows")).alias("micro"), F.avg("mean").alias("macro"), F.count(F.lit(1)).alias("clusters"))
    spread = sums.join(per, model).groupBy(model).agg(F.sum(F.pow(F.col("total") - F.col("micro") * F.col("rows"), 2)).alias("_v"))
    out = per.join(spread, model)
    variance = F.col("_v") / (F.col("n") * F.col("n")) * F.col("clusters") / F.greatest(F.col("clusters") - 1, F.lit(1))
    simple = F.col("micro") * (1 - F.col("micro")) / F.col("n")
    out = out.withColumn("design_effect", F.when(simple > 0, variance / simple))
    return out.withColumn("effective_n", F.when(F.col("design_effect") > 0, F.col("n") / F.col("design_effect"))).withColumn("few_clusters", F.col("clusters") < least_clusters).drop("_v")


def rank_agreement(df: DataFrame, model: str, metric: str, subset: str) -> DataFrame:
    """(subset, pairs, agree): over pairs of models, whether the subset orders them as all rows do."""
    whole = df.groupBy(model).agg(F.avg(metric).alias("w"))
    part = df.groupBy(subset, model).agg(F.avg(metric).alias("p")).join(whole, model)
    a, b = part.toDF("ma", "s", "pa", "wa"), part.toDF("mb", "s", "pb", "wb")
    pairs = a.join(b, "s").filter("ma < mb")
    same = F.signum(F.round(F.col("pa") - F.col("pb"), 12)) == F.signum(F.round(F.col("wa") - F.col("wb"), 12))
    return pairs.groupBy(F.col("s").alias(subset)).agg(F.count(F.lit(1)).alias("pairs"), F.avg(same.cast("double")).alias("agree"))


def self_preference(df: DataFrame, model: str, generator: str, metric: str) -> DataFrame:
    """(model, own, other, difference, did): a model's mean on items its own kind made and on the rest, against the mean of the other models' differences."""
    own = F.col(model) == F.col(generator)
    per = df.groupBy(model).agg(F.avg(F.when(own, F.col(metric))).alias("own"), F.avg(F.when(~own, F.col(metric))).alias("other"))
    kinds = df.select(generator).distinct().withColumnRenamed(generator, "_g")
    cross = df.join(kinds, F.col(model) != F.col("_g")).groupBy("_g", model).agg(F.avg(F.when(F.col(generator) == F.col("_g"), F.col(metric))).alias("a"), F.avg(F.when(F.col(generator) != F.col("_g"), F.col(metric))).alias("b"))
    placebo = cross.groupBy("_g").agg(F.avg(F.col("a") - F.col("b")).alias("_p"))
    out = per.join(placebo, F.col(model) == F.col("_g"), "left").withColumn("difference", F.col("own") - F.col("other"))
    return out.select(model, "own", "other", "difference", (F.col("difference") - F.col("_p")).alias("did"))


def coverage_gaps(df: DataFrame, cell: Sequence[str], funnel: Sequence[tuple[str, str]]) -> DataFrame:
    """(…, stage counts): how many rows of each cell pass each stage (name, SQL condition), one pass."""
    return df.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in funnel])
