"""Text measures, scores, allocation, refresh and sources: hand-computed values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import privacy, text
from graphloom.functions.query_text import Schema
from graphloom.operators import refresh, selection, statistics
from graphloom.sources import files
from graphloom.streaming import ledger


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_meteor(a, b):
    places = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    met = [(i, places[x].pop(0)) for i, x in enumerate(a) if places.get(x)]
    if not a or not b or not met:
        return float(not a and not b)
    chunks = 1 + sum(q[0] != p[0] + 1 or q[1] != p[1] + 1 for p, q in zip(met, met[1:], strict=False))
    p, r = len(met) / len(a), len(met) / len(b)
    return (1 - 0.5 * (chunks / len(met)) ** 3) * 10 * p * r / (r + 9 * p)


def plain_jaro_winkler(a, b):
    if a == b or not a or not b:
        return float(a == b)
    reach, taken = max(max(len(a), len(b)) // 2 - 1, 0), []
    for i, x in enumerate(a):
        taken += [j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == x and j not in taken][:1]
    if not taken:
        return 0.0
    m, swaps = len(taken), sum(b[i] != b[j] for i, j in zip(taken, sorted(taken), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i in range(4) if a[i : i + 1] != b[i : i + 1] or not a[i:]), 4)
    return jaro + 0.1 * prefix * (1 - jaro)


def test_alignments_are_columns_and_agree_with_plain_loops(spark):
    """Texts of 0 to 300 tokens (several words of bits), repeated tokens, nulls, letters beyond the plane."""
    rng = np.random.default_rng(5)
    tokens = [([str(x) for x in rng.integers(0, k, n)], [str(x) for x in rng.integers(0, k, m)]) for n, m, k in [(0, 0, 2), (0, 3, 2), (3, 0, 2), (1, 1, 1), (59, 60, 3), (60, 61, 3), (61, 60, 40), (120, 121, 4), (300, 250, 9), (40, 300, 30), (7, 7, 3)]]
    tokens += [("the cat sat".split(), "the cat ran".split()), ("a b c".split(), "a b c".split()), (["x"], ["y"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(tokens)] + [(-1, None, ["a"])], "id int, a array<string>, b array<string>")
    out = df.select("id", text.longest_common(F.col("a"), F.col("b")).alias("n"), text.rouge_l_f1(F.col("a"), F.col("b")).alias("f"), text.meteor(F.col("a"), F.col("b")).alias("m"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    assert got.pop(-1)["m"] is None
    for i, (a, b) in enumerate(tokens):
        assert got[i]["n"] == longest_common(a, b)
        assert got[i]["m"] == pytest.approx(plain_meteor(a, b))
        assert got[i]["f"] == pytest.approx(2 * longest_common(a, b) / (len(a) + len(b)) if a and b else float(not a and not b))
    names = [("martha", "marhta"), ("", "x"), ("", ""), ("a", "b"), ("ab", "ba"), ("dixon", "dicksonx"), ("\U0001f600ab", "b\U0001f600a"), ("aaaa", "aaaaaa")]
    names += [("".join(rng.choice(list("abcé"), n)), "".join(rng.choice(list("abcé"), m))) for n, m in rng.integers(0, 25, (60, 2))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(names)] + [(-1, None, "a")], "id int, a string, b string")
    got = {r["id"]: r["j"] for r in df.select("id", text.jaro_winkler(F.col("a"), F.col("b")).alias("j")).collect()}
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(names))] == pytest.approx([plain_jaro_winkler(a, b) for a, b in names])
    assert got[0] == pytest.approx(0.9611, abs=1e-4)


def test_integer_weights():
    assert statistics.integer_weights({"hops": 0.5, "arity": 1.04, "order": 0.1, "labels": 0.0}, 4.0) == {"hops": 2, "arity": 4}


def test_self_bleu_and_diversity(spark):
    assert text.self_bleu([["a", "b"], ["a", "b"]]) == pytest.approx(1.0)
    df = spark.createDataFrame([([1.0, 1.0],), ([4.0, 0.25],), ([float("nan"), None, 0.5],), ([],), ([0.0],)], "x array<double>")
    assert [r[0] for r in df.select(text.diversity_index(F.col("x"))).collect()] == pytest.approx([1.0, 0.5, 0.5, 0.0, 1e-6])


def test_empty_texts_in_column_measures(spark):
    df = spark.createDataFrame([([], []), ([], ["a"]), (["a"], ["a"]), (None, ["a"])], "p array<string>, r array<string>")
    row = df.select(text.bleu(F.col("p"), F.col("r")).alias("b"), text.rouge_n(F.col("p"), F.col("r"), 1)["f1"].alias("f"), text.jaccard(F.col("p"), F.col("r")).alias("j")).collect()
    assert [r["b"] for r in row[:3]] == [1.0, 0.0, 1.0]
    assert [r["f"] for r in row[:3]] == [1.0, 0.0, 1.0]
    assert [r["j"] for r in row[:3]] == [1.0, 0.0, 1.0]


def test_projected_scores():
    gold = [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]
    assert statistics.projected_scores([{"x": "a", "y": 1, "z": 0}, {"x": "b", "y": 2, "z": 0}], gold)["exact"]
    assert statistics.projected_scores([{"p": {"id": 1, "name": "a"}}, {"p": {"id": 2, "name": "b"}}], gold)["mapping"] == {"id": "p.id", "name": "p.name"}
    assert statistics.projected_scores([{"n": 1}], gold, ["id"])["f1"] == pytest.approx(2 / 3)
    assert not statistics.projected_scores([{"n": 3.0}], [{"n": 3}])["exact"]  # strict text comparison
    assert statistics.projected_scores([], [])["f1"] == 1.0


def test_exact_tests():
    assert statistics.binomial_two_sided(0, 0) == 1.0
    assert statistics.binomial_two_sided(1, 9) == pytest.approx(2 * 11 / 1024)
    assert statistics.rank_permutation([1, 2, 3], [1, 2, 3]) == pytest.approx(1 / 6)


def test_bootstrap_widens_for_homogeneous_clusters(spark):
    rows = spark.createDataFrame([(i, i // 10, float(i // 10 % 2)) for i in range(200)], "id int, c int, y double")
    wide = statistics.cluster_bootstrap(rows, "c", "y", replicates=300).first()
    narrow = statistics.cluster_bootstrap(rows, "id", "y", replicates=300).first()
    assert wide["mean"] == narrow["mean"] == 0.5
    assert wide["high"] - wide["low"] > 2 * (narrow["high"] - narrow["low"])
    assert statistics.cluster_bootstrap(rows.repartition(7), "c", "y", replicates=300).first() == wide


def test_ridge_and_multiset(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i) for i in range(30)], "a double, b double, y double")
    w = statistics.non_negative_ridge(rows, ["a", "b"], "y", penalty=1e-6)
    assert w["a"] == pytest.approx(2.0, abs=1e-3) and w["b"] == pytest.approx(0.0, abs=1e-2)
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert not statistics.same_multiset(a, b).first()[0] and statistics.same_multiset(a, a.repartition(3)).first()[0]


def test_allocation():
    assert selection.allocate({"a": 100, "b": 50, "c": 3}, 20, floor=2) == {"a": 11, "b": 7, "c": 2}
    assert sum(selection.allocate({"a": 5, "b": 1}, 10).values()) == 6


def test_split_edges(spark):
    one = spark.createDataFrame([("g1", 1), ("g2", 1), ("g2", 2), *[("g3", i) for i in range(5)]], "g string, id int")
    got = {(r["g"], r["split"]): r["count"] for r in selection.random_splits(one, ["g"]).groupBy("g", "split").count().collect()}
    assert got == {("g1", "train"): 1, ("g2", "train"): 1, ("g2", "test"): 1, ("g3", "train"): 3, ("g3", "dev"): 1, ("g3", "test"): 1}


def test_privacy():
    assert privacy.redact_literals("x = 'Ann' OR y = \"Bob\" OR z = 'Ann'") == ("x = '<value_1>' OR y = '<value_2>' OR z = '<value_1>'", {"Ann": "<value_1>", "Bob": "<value_2>"})
    assert privacy.domain_sample(["b", "a"], 2) == ["a", "b"]
    assert privacy.domain_sample(["b", "a", "c"], 2) == []
    assert privacy.domain_sample(["a@b"], 5, omit=("@",)) == []


def test_longest_value_is_redacted_first(spark):
    df = spark.createDataFrame([("Ann Lee met Ann", ["Ann", "Ann Lee", None, ""])], "t string, v array<string>")
    out = df.select(privacy.redact_values(F.col("t"), F.col("v"), "s").alias("r")).first()[0]
    assert "Ann" not in out and "Lee" not in out and out.count("<v_") == 2


def test_renames_and_splits():
    old = Schema({"Person": {"name": "S", "age": "I"}, "City": {"name": "S"}}, {"LIVES": {"since": "I"}}, {("Person", "LIVES", "City"): 10})
    new = Schema({"Human": {"name": "S", "age": "I"}, "City": {"name": "S"}}, {"RESIDES": {"since": "I"}}, {("Human", "RESIDES", "City"): 10})
    moved = Schema({"Person": {"name": "S", "years": "I"}, "City": {"name": "S"}}, old.rels, old.patterns)
    assert refresh.propose_renames(old, new, least=0.5)["label:Person"][0] == "label:Human"
    assert refresh.propose_renames(old, new, least=0.5)["rel:LIVES"][0] == "rel:RESIDES"
    assert refresh.propose_renames(old, moved)["prop:Person.age"][0] == "prop:Person.years"
    split = Schema({"Kid": {"name": "S"}, "Adult": {"age": "I"}, "City": {"name": "S"}}, {}, {("Kid", "LIVES", "City"): 1, ("Adult", "LIVES", "City"): 2})
    assert refresh.propose_splits(old, split)["Person"][0] == ("Adult", "Kid")


def test_migration_checks():
    counts = {"before": 10, "deleted": 4}
    assert refresh.migration_check("== before - deleted", 6, counts)
    assert refresh.migration_check("positive", 1, counts) and not refresh.migration_check("zero", 1, counts)
    with pytest.raises(ValueError):
        refresh.evaluate("__import__('os')", counts)


def test_sources(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id|name|born|tags\n1|Ann|2020-01-02|a;b\n2||x|\n1|Eve|2021-01-01|c\n")
    rows = files.typed(files.read_delimited(spark, str(tmp_path / "n.csv")), {"id": "INTEGER", "born": "DATE", "tags": "STRINGARRAY"})
    got = {r["_id"]: r for r in files.load_nodes(rows, "id", ["born"]).collect()}
    assert got[1]["name"] == "Eve" and got[2]["name"] is None and got[2]["born"] is None and got[1]["tags"] == ["c"]
    nodes = spark.createDataFrame([(1,), (2,)], "_id long")
    edges = spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (1, 9, "y")], "a long, b long, k string")
    loaded = files.load_edges(edges, "a", "b", nodes, nodes).collect()
    assert len(loaded) == 2 and len({r["_eid"] for r in loaded}) == 2
    assert files.read_lines(spark, str(tmp_path / "missing.jsonl"), "a int").count() == 0
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_runs(spark, {"one": str(tmp_path / "r.jsonl")}, "a int").select("a", "_source_run").count() == 2
    df = spark.createDataFrame([(i, f"t{i}", "train" if i < 8 else "test") for i in range(10)], "id int, q string, split string")
    assert files.write_package(df, str(tmp_path / "pkg"))["splits"] == {"test": 2, "train": 8}
    assert files.content_digest(df, "id") == files.content_digest(df.repartition(5), "id") != files.content_digest(df.filter("id > 0"), "id")
    assert files.checksums(spark, str(tmp_path / "n.csv")).count() == 1


def test_schema_json_round_trip():
    s = Schema({"A": {"x": "I"}}, {"R": {}}, {("A", "R", "A"): 2}, {"A.x": ("1",)}, frozenset({"R"}))
    assert files.schema_from_json(files.schema_json(s)) == s
    assert "(:A)-[:R]->(:A)" in files.schema_text(s)


def test_ledger_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ts": f"2024-01-01T0{h}:10:00Z", "cell": "c", "model": "m", "cost_usd": 0.5, "cached": h == 1, "accepted": True} for h in (0, 0, 1)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = ledger.spend_totals(ledger.read_ledger(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r["calls"], r["cost"], r["cached"]) for r in spark.table("totals").collect()) == [(1, 0.5, 1), (2, 1.0, 0)]


def test_joins_with_fallbacks(spark):
    from graphloom.operators import joins

    items = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    rates = spark.createDataFrame([(1, 0), (2, 3)], "id int, solved int")
    votes = spark.createDataFrame([(1, True), (1, False), (2, True)], "id int, passed boolean")
    got = {r["id"]: r["reasons"] for r in joins.focus_reasons(items, rates, votes, "id", "passed").collect()}
    assert got == {1: ["unsolved", "disagreement"], 2: [], 3: ["unjudged"]}
    rows = spark.createDataFrame([(1, "q1", "h1"), (2, "q9", "h2"), (3, "q9", "h9"), (4, None, None)], "n int, q string, h string")
    known = spark.createDataFrame([("q1", None, "a"), ("q2", "h2", "b")], "q string, h string, label string")
    out = {r["n"]: (r["label"], r["resolved_by"]) for r in joins.resolve(rows, known, ["q", "h"], "label").collect()}
    assert out == {1: ("a", "q"), 2: ("b", "h"), 3: (None, "none"), 4: (None, "none")}
    shots = spark.createDataFrame([(1, "s", [7, 8], [0.9, 0.5], ["s", "t"])], "id int, own string, shots array<int>, sims array<double>, sigs array<string>")
    assert [tuple(r) for r in joins.shot_metadata(shots, "id", "shots", "sims", "sigs", "own").collect()] == [(1, 1, 7, 0.9, True), (1, 2, 8, 0.5, False)]


def test_delta_and_threshold(spark):
    a = spark.createDataFrame([(i, i % 10, 0.0) for i in range(50)], "id int, c int, y double")
    b = spark.createDataFrame([(i, 0, 0.5) for i in range(50)], "id int, c int, y double")
    row = statistics.delta_bootstrap(a, b, "id", "c", "y", 50).first()
    assert row["mean"] == row["low"] == row["high"] == 0.5
    v = spark.range(1).select(statistics.threshold_verdict(F.lit(0.1), F.lit(0.9), F.lit(0.8)).alias("p"), statistics.threshold_verdict(F.lit(0.9), F.lit(0.9), F.lit(0.8)).alias("f")).first()
    assert (v["p"], v["f"]) == (True, False)


def test_sign_flip_above_sixteen_clusters(spark):
    """Twenty sums of 1 reach 8 or more in absolute value with a chance of 0.115; clusters without a difference do not count."""
    rows = [(i, 1.0 if i < 14 else -1.0) for i in range(20)]
    out = statistics.sign_flip(spark.createDataFrame(rows, "k int, d double"), "k", "d").collect()
    assert [(r["clusters"], r["observed"]) for r in out] == [(20, 8.0)] and out[0]["p"] == pytest.approx(0.1153, abs=0.02)
    rows = [(i, 1.0 if i < 3 else 0.0) for i in range(30)]
    assert statistics.sign_flip(spark.createDataFrame(rows, "k int, d double"), "k", "d").first()["p"] == 0.25


def test_group_folds_balance(spark):
    """Whole groups in one fold, and folds whose rows differ by no more than the largest group."""
    rows = [(f"g{i}",) for i in range(60) for _ in range(1 + i % 7 * (i % 3))]
    out = statistics.group_folds(spark.createDataFrame(rows, "g string"), "g", 5)
    folds = out.groupBy("g").agg(F.count_distinct("fold").alias("n"), F.min("fold").alias("fold")).collect()
    assert len(folds) == 60 and all(r["n"] == 1 for r in folds)
    load = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(load) == 5 and max(load) - min(load) <= 13 and sum(load) == len(rows)


def test_quantiles_and_ranks_of_hot_values(spark):
    """A value that most rows have, null groups, and quantiles between neighbours, against pandas."""
    import pandas as pd

    from graphloom.operators import ranks

    rows = [(None if i % 5 == 0 else f"g{i % 5}", float(i % 13 if i % 3 else 7)) for i in range(500)] + [("one", 3.0), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    frame = pd.DataFrame(rows, columns=["g", "v"])
    got = {r["g"]: (r["m"], r["q"]) for r in ranks.quantiles(df, F.col("v"), {"m": 0.5, "q": 0.9}, ["g"]).collect()}
    for g, part in frame.dropna(subset=["v"]).groupby("g", dropna=False)["v"]:
        assert got[None if g != g else g] == (pytest.approx(part.quantile(0.5)), pytest.approx(part.quantile(0.9)))
    ranked = statistics.average_ranks(df.filter("v IS NOT NULL"), "v", ["g"]).collect()
    frame = frame.dropna(subset=["v"])
    frame["rank"] = frame.groupby("g", dropna=False)["v"].rank()
    assert sorted((str(r["g"]), r["v"], r["rank"]) for r in ranked) == sorted((str(None if g != g else g), v, k) for g, v, k in frame[["g", "v", "rank"]].itertuples(index=False))
