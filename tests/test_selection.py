"""Diverse selection against a plain loop, in one part and in several."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import selection

SCHEMA = "g string, id long, sig string, fam string, sub array<string>, atoms array<string>, vals array<string>, words array<string>, q double, op string"
TERMS = {"signature": "sig", "family": "fam", "substructures": "sub", "schema_atoms": "atoms", "values": "vals", "tokens": "words", "quality": "q", "operators": "op"}


def candidates(seed, n):
    rng = np.random.default_rng(seed)
    some = lambda p, most, k: [f"{p}{int(x)}" for x in rng.integers(0, most, int(rng.integers(0, k)))]
    return [("ab"[i % 5 == 0], i, f"s{int(rng.integers(0, 4))}", f"f{int(rng.integers(0, 3))}", some("u", 9, 4), some("a", 12, 5), some("v", 20, 3) if i % 4 else None, some("w", 15, 6), float(rng.random()), f"o{int(rng.integers(0, 3))}") for i in range(n)]


def greedy(rows, target):
    """The eight terms and two caps by recomputing every row's score for every choice."""
    chosen, left = [], sorted(rows, key=lambda r: r[1])
    novelty = lambda own, at: len(set(own) - {v for c in chosen for v in at(c)}) / len(set(own)) if own else 0.0

    def score(r):
        out = 0.04 * r[8]
        for weight, at in ((0.24, lambda c: [c[2]]), (0.18, lambda c: [c[3]]), (0.22, lambda c: c[4]), (0.14, lambda c: c[5]), (0.08, lambda c: c[6] or []), (0.03, lambda c: [c[9]])):
            out += weight * novelty(at(r), at)
        near = [len(set(r[7]) & set(c[7])) / len(set(r[7]) | set(c[7])) if set(r[7]) | set(c[7]) else 1.0 for c in chosen]
        out += 0.10 * (1 - max(near, default=0.0))
        for at, share in ((2, 0.20), (3, 0.25)):
            if sum(c[at] == r[at] for c in chosen) + 1 > max(2, math.ceil(target * share)):
                out -= 0.35
        return round(out, 12)

    while left and len(chosen) < target:
        best = max(left, key=lambda r: (score(r), -r[1]))
        chosen.append(best)
        left.remove(best)
    return [r[1] for r in chosen]


def order_of(found, g):
    return [r["id"] for r in sorted(found, key=lambda r: r["pick"]) if r["g"] == g]


@pytest.mark.parametrize("seed", range(3))
def test_eight_terms_equal_a_loop(spark, seed):
    rows = candidates(seed, 70)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = selection.example_selection(df, "g", "id", 16, TERMS).collect()
    for g in "ab":
        mine = [r for r in rows if r[0] == g]
        assert order_of(found, g) == greedy(mine, min(16, len(mine)))


def test_large_groups_are_chosen_from_in_two_rounds(spark):
    """Each part picks k, then k of those are picked: the same as two rounds of the plain loop, and no part is large."""
    rows = candidates(9, 160)
    df = spark.createDataFrame(rows, SCHEMA)
    found = selection.example_selection(df, "g", "id", 6, TERMS, part_rows=30).collect()
    for g in "ab":
        mine = [r for r in rows if r[0] == g]
        ids = spark.createDataFrame([(r[1],) for r in mine], "id long")
        while len(mine) > 30:
            parts = -(-len(mine) // 30)
            of = {r["id"]: r["p"] for r in ids.select("id", F.pmod(F.xxhash64("id"), F.lit(parts).cast("long")).alias("p")).collect()}
            kept = {i for p in range(parts) for i in greedy([r for r in mine if of[r[1]] == p], 6)}
            mine = [r for r in mine if r[1] in kept]
        assert order_of(found, g) == greedy(mine, 6)


def test_selection_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert selection.example_selection(none, "g", "id", 4, TERMS).count() == 0
    one = spark.createDataFrame([(None, 1, None, None, None, None, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in selection.example_selection(one, "g", "id", 4, TERMS).collect()] == [(None, 1, 1)]


def test_rows_of_few_kinds_are_chosen_exactly_from_any_number(spark):
    """A group of many times ``part_rows`` rows, but few kinds of them, has the order of the plain loop."""
    kinds = candidates(5, 40)
    rows = [(r[0], i * 40 + r[1], *r[2:]) for i in range(6) for r in kinds]
    found = selection.example_selection(spark.createDataFrame(rows, SCHEMA).repartition(5), "g", "id", 12, TERMS, part_rows=48).collect()
    for g in "ab":
        assert order_of(found, g) == greedy([r for r in rows if r[0] == g], 12)


@pytest.mark.parametrize("pool", [1, 7, 30])
def test_large_groups_have_the_exact_order(spark, pool):
    """A group of many more kinds than one task chooses from has the order of the plain loop, whatever the pool."""
    rows = candidates(9, 160)
    found = selection.example_selection(spark.createDataFrame(rows, SCHEMA).repartition(5), "g", "id", 6, TERMS, pool_rows=pool).collect()
    for g in "ab":
        assert order_of(found, g) == greedy([r for r in rows if r[0] == g], 6)


@pytest.mark.parametrize("seed", [3, 4])
def test_order_does_not_depend_on_the_size(spark, seed):
    """6,400 kinds of rows in a group, more than were once dealt into parts that each chose for themselves."""
    rows = candidates(seed, 8_000)
    found = selection.example_selection(spark.createDataFrame(rows, SCHEMA).repartition(5), "g", "id", 12, TERMS).collect()
    for g in "ab":
        assert order_of(found, g) == greedy([r for r in rows if r[0] == g], 12)
