"""Prefix scans, ordered acceptance, order comparison and inversion counts against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import ranks, selection, statistics


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][int(rng.integers(0, 3))], int(o), int(rng.integers(0, 9))) for o in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    got = {(r["g"], r["o"]): (r["before"], r["before_all"], r["at"]) for r in ranks.running_sums(df, ["g"], ["o"], {"before": F.col("v"), "at": F.lit(1)}, totals=True).collect()}
    for g in ("a", "b", None):
        mine = sorted((o, v) for h, o, v in rows if h == g)
        total, before = sum(v for _, v in mine), 0
        for n, (o, v) in enumerate(mine):
            assert got[g, o] == (before, total, n)
            before += v


def brute_quota(rows, quotas):
    """rows: (i, key, values...); quotas: (column, most), the key's first."""
    taken, out = [{} for _ in quotas], {}
    for r in sorted(rows):
        full = next((n for n, (name, c, q) in enumerate(quotas) if taken[n].get(r[c], 0) >= q), None)
        out[r[0]] = "accept" if full is None else quotas[full][0]
        if full is None:
            for n, (_, c, _) in enumerate(quotas):
                taken[n][r[c]] = taken[n].get(r[c], 0) + 1
    return out


@pytest.mark.parametrize("at_once", [7, 20_000])
def test_ordered_quota_equals_a_loop(spark, at_once):
    rng = np.random.default_rng(2)
    rows = [(i, f"k{int(rng.integers(0, 60))}" if i % 9 else None, f"c{int(rng.integers(0, 3))}", f"s{int(rng.integers(0, 12))}") for i in range(120)]
    df = spark.createDataFrame(rows, "i long, key string, c string, s string").repartition(5)
    out = selection.ordered_quota(df, ["key"], {"cell": (["c"], 12), "sig": (["s"], 4)}, ["i"], at_once)
    assert out.columns == ["i", "key", "c", "s", "decision"]
    assert {r["i"]: r["decision"] for r in out.collect()} == brute_quota(rows, [("duplicate", 1, 1), ("quota:cell", 2, 12), ("quota:sig", 3, 4)])


def test_a_chain_of_ten_thousand_dependent_rows(spark):
    """Row i shares a value with row i - 1 and another with row i + 1: every second row is accepted, each because the one before it is not."""
    n = 10_000
    rows = [(i, (i + 1) // 2, i // 2) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, x long, y long")
    out = selection.ordered_quota(df, ["x"], {"y": (["y"], 1)}, ["i"])
    assert {r["i"]: r["decision"] == "accept" for r in out.select("i", "decision").collect()} == {i: i % 2 == 0 for i in range(n)}


def test_rotation_and_deficits(spark):
    rows = [(g, int(o)) for g in ("a", "b") for o in np.random.default_rng(3).permutation(50)]
    df = spark.createDataFrame(rows, "g string, o long")
    turn = {(r["g"], r["o"]): r["turn"] for r in selection.rotate(df, ["g"], ["o"], 7).collect()}
    assert turn == {(g, o): (o - 7) % 50 for g, o in rows}
    used = selection.fill_deficits(df, spark.createDataFrame([("a", 3)], "g string, need long"), ["g"], [-F.col("o")])
    assert {(r["g"], r["o"]) for r in used.filter("used").collect()} == {("a", 49), ("a", 48), ("a", 47)}


@pytest.mark.parametrize(("b", "want"), [([1, 2, 3, None], (True, 4)), ([1, 3, 2, None], (False, 1)), ([1, 2, 3], (False, 3)), ([1, 2, 3, None, 5], (False, 4)), ([], (False, 0))])
def test_ordered_equality(spark, b, want):
    """Equal, permuted, truncated, longer and empty answers."""
    frame = lambda values: spark.createDataFrame([(10 * i, v) for i, v in enumerate(values)], "at long, v long")
    assert tuple(statistics.ordered_equal(frame([1, 2, 3, None]), frame(b), ["at"]).first()) == want
    assert tuple(statistics.ordered_equal(frame([]), frame([]), ["at"]).first()) == (True, 0)


def test_inversions_equal_all_pairs():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 300):
        v, w = rng.integers(0, 40, n), rng.integers(1, 5, n)
        assert statistics.inversions(v, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if v[i] > v[j])
    assert statistics.inversions(np.array([2, 1]), np.array([1 << 40, 1 << 40])) == 1 << 80


@pytest.mark.parametrize(("n", "ties"), [(4000, 4000), (5000, 30), (3000, 2)])
def test_kendall_equals_all_pairs(spark, n, ties):
    """With few ties, many, and values that half of the rows have."""
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, ties, n), rng.integers(0, ties, n)
    b = np.where(rng.random(n) < 0.5, a, b)
    rows = [(i, int(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(n, None, 1.0), (n + 1, 1, None)]
    got = statistics.kendall_tau_b(spark.createDataFrame(rows, "i long, a long, b double"), "i", "a", "b").first()
    sa, sb = np.sign(a[:, None] - a[None, :]), np.sign(b[:, None] - b[None, :])
    up, down = int((sa * sb > 0).sum()) // 2, int((sa * sb < 0).sum()) // 2
    assert (got["pairs"], got["concordant"], got["discordant"]) == (n * (n - 1) // 2, up, down)
    assert got["tau_b"] == pytest.approx((up - down) / np.sqrt(float((sa != 0).sum() // 2) * float((sb != 0).sum() // 2)), abs=1e-12)


def test_kendall_of_nothing(spark):
    assert tuple(statistics.kendall_tau_b(spark.createDataFrame([], "i long, a long, b long"), "i", "a", "b").first()) == (0, 0, 0, None)
