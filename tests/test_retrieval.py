"""Retrieval by upper bounds against all pairs, and what it reads."""

import math
from collections import Counter

import numpy as np
import pytest

from graphloom.operators import joins, retrieval


def brute(rows, k, cut, group, exclude):
    """(id, other, similarity, rank) by all pairs; rows are (id, group, signature, tokens)."""
    out = []
    bags = {r[0]: Counter(r[3] or []) for r in rows}
    norm = {i: math.sqrt(sum(n * n for n in b.values())) for i, b in bags.items()}
    for i, g, s, _ in rows:
        scored = []
        for j, h, t, _ in rows:
            if i == j or group and g != h or exclude and s == t:
                continue
            dot = sum(n * bags[j][w] for w, n in bags[i].items())
            sim = round(dot / (norm[i] * norm[j]), 9) if dot else 0.0
            if bags[i] == bags[j] and bags[i]:
                sim = 1.0
            if sim < cut:
                scored.append((-sim, j))
        out += [(i, j, -x, r + 1) for r, (x, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(seed, n, hot):
    """Short bags; one word in all rows, copies, rows without words."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{int(x)}" for x in rng.zipf(1.6, int(rng.integers(0, 7))) % 40]
        rows.append((i, f"g{i % 3}", f"s{int(rng.integers(0, 3))}", words + ["what"] * hot if i % 11 else []))
    rows += [(n + i, *rows[5][1:]) for i in range(12)] + [(n + 20, "alone", "s1", ["what", "x"]), (n + 21, None, "s1", ["what"]), (n + 22, None, "s2", None)]
    return rows


SCHEMA = "id long, g string, sig string, t array<string>"


@pytest.mark.parametrize(("seed", "hot", "cut"), [(1, 1, 0.995), (2, 0, 0.9), (3, 2, 0.6)])
def test_neighbours_equal_all_pairs(spark, seed, hot, cut):
    rows = corpus(seed, 90, hot)
    df = spark.createDataFrame(rows, SCHEMA)
    found = joins.cosine_neighbours(df, "t", 3, leakage=cut)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 3, cut, False, False)


@pytest.mark.parametrize("exclude", [False, True])
def test_scored_shots_equal_all_pairs(spark, exclude):
    rows = corpus(4, 80, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    found = joins.scored_shots(df, df, "g", "t", "sig", 4, exclude_match=exclude)
    assert sorted((r["id"], r["shot"], r["similarity"], r["rank"]) for r in found.collect()) == brute(rows, 4, 0.9, True, exclude)
    signature = {r[0]: r[2] for r in rows}
    assert all(r["signature_match"] == (signature[r["id"]] == signature[r["shot"]]) for r in found.collect())


def test_a_word_in_all_rows_is_not_expanded(spark):
    """With topics of 8 rows and one word that all rows have, the scored pairs grow with the rows, not with their square."""

    def pairs(n):
        rows = [(i, None, None, ["what", *[f"t{i // 8}_{j}" for j in range(3)], f"own{i}"]) for i in range(n)]
        df = spark.createDataFrame(rows, SCHEMA)
        _, classes = retrieval.bag_classes(df, "t", "id", None, None)
        bags = retrieval.weighed(classes)
        return retrieval.candidate_scores(bags.withColumnRenamed("cls", "q"), bags, classes, classes, 3, 0.995, False).count()

    small, large = pairs(200), pairs(800)
    assert small <= 200 * 20 and large <= 4.2 * small


def test_retrieval_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert joins.cosine_neighbours(none, "t", 3).count() == 0
    one = spark.createDataFrame([(1, "a", "s", ["x"])], SCHEMA)
    assert joins.cosine_neighbours(one, "t", 3).count() == 0 and joins.scored_shots(one, none, "g", "t", "sig", 2).count() == 0
