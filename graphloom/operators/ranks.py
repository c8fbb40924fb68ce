"""Ranks, quantiles and hash order of large groups: no group is ever one task.

Values are counted first, with map-side combine, so that a value that many rows have is one row. The counts are dealt by
range; a running sum inside each range and the ranges' totals before it give each value's place in its group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import written


def left_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``join_groups``, but rows without a group's row stay."""
    return join_groups(df, groups, keys, "left")


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of its group's row in ``groups``; null groups are groups."""
    other = groups.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    return df.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def value_places(counts: DataFrame, group: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """``counts`` (group, value, n, …; one row a value) with ``before``: the rows of the group with lesser values, and ``rows``: all of the group."""
    ranged = counts.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranges")  # so that parts stay what they are
    sums = ranged.groupBy(*group, "_part").agg(F.sum(n).alias("_sum"))  # as many rows as parts, and one more for each group
    parts = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(parts), F.lit(0))).withColumn("rows", F.sum("_sum").over(Window.partitionBy(*group))).drop("_sum")
    inside = Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return join_groups(placed, starts, [*group, "_part"]).withColumn("before", F.col("_start") + F.col("_inside")).drop("_part", "_start", "_inside")


def dealt(df: DataFrame, group: Sequence[str], order: Sequence[str], to: str) -> DataFrame:
    """``to``: the range of (group, order) that a row lies in; written. Ranges stay about equal however few groups there are."""
    return written(df.repartitionByRange(*group, *order).withColumn(to, F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column], part: str | None = None, totals: bool = False) -> DataFrame:
    """A segmented prefix scan: for each name the sum over the rows of the group before this one; with ``totals`` also name_all, that of the whole group.

    ``order`` must tell the group's rows apart. Rows are dealt by ranges (or have been, see ``dealt``: ``part`` is the column), each range adds up
    its rows, and the ranges' sums before it are carried into it; so no group is one task.
    """
    ranged = df if part else dealt(df, group, order, "_part")
    key = part or "_part"
    held = ranged.withColumns({f"_v_{n}": c for n, c in sums.items()})
    parts = held.groupBy(*group, key).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])  # as many rows as ranges, and one more for each group
    before = Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*group, key, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_s_{n}").over(Window.partitionBy(*group)).alias(f"{n}_all") for n in sums if totals])
    inside = Window.partitionBy(*group, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = join_groups(held.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}), starts, [*group, key])
    out = out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop(*[f"_b_{n}" for n in sums], *[f"_v_{n}" for n in sums])
    return out if part else out.drop("_part")


def quantiles(df: DataFrame, value: Column, wanted: dict[str, float], group: Sequence[str] = ()) -> DataFrame:
    """(group, one column for each wanted share): exact, with linear interpolation between neighbours; nulls don't count."""
    counts = df.select(*group, value.cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("n"))
    placed = value_places(counts, group, "_v")
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    out = {}
    for name, q in wanted.items():
        at = (F.col("rows") - 1) * F.lit(q)
        low, high = F.max(F.when(holds(F.floor(at)), F.col("_v"))), F.max(F.when(holds(F.ceil(at)), F.col("_v")))
        share = F.max(at - F.floor(at))
        out[name] = (low + (high - low) * share).alias(name)
    return placed.groupBy(*group).agg(*out.values())


def hash_places(df: DataFrame, group: Sequence[str], key: Column, ties: Sequence[Column | str] = (), to: tuple[str, str] = ("_rn", "_n")) -> DataFrame:
    """``to``: a place (from 1, in the order of ``key``, a hash in hex, then ``ties``), and the group's rows.

    The first two digits of the hash keep its order and deal each group over 256 windows; their sizes give where each begins.
    """
    rows = df.withColumn("_h", key).withColumn("_p", F.substring("_h", 1, 2))
    sizes = rows.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_c").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(to[1], F.sum("_c").over(Window.partitionBy(*group))).drop("_c")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_p").orderBy("_h", *ties)))
    return join_groups(ranked, starts, [*group, "_p"]).withColumn(to[0], F.col("_start") + F.col("_r")).drop("_h", "_p", "_r", "_start")


def hash_top(df: DataFrame, group: Sequence[str], key: Column, k: int, ties: Sequence[Column | str] = ()) -> DataFrame:
    """The ``k`` first rows of each group in the order of ``key``, a hash in hex; k of each of its 256 parts first. Adds ``_rn`` and ``_n``."""
    rows = df.withColumn("_h", key).withColumn("_p", F.substring("_h", 1, 2))
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_p").orderBy("_h", *ties))).filter(F.col("_rn") <= k)
    top = first.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy("_h", *ties))).filter(F.col("_rn") <= k)
    return join_groups(top, df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), group).drop("_h", "_p")
