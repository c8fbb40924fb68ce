"""Periodic runs, SentencePiece and dual-tree clustering against brute force and the library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from graphloom.llm import dual_tree, periodic_runs, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a  b ", "\t\n\x0b\x0c\r", "▁", "▁▁ ▁x", "<s> </s> <unk> <0x0A>", " ⁇ ", "日本語 😀😀", "\x00z", "é" * 300, "no_space" * 2000, " " * 999, "to be or not " * 400, " nbsp em", "﻿bom", "=-" * 500]


def brute_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start >= q and i - start + q >= least:
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, n)
            w = [w[i] if i < a else w[a + (i - a) % min(p, n - a)] for i in range(n)]
        for least in (2, 12):
            assert periodic_runs.runs_of(w, least) == brute_runs(w, least)


def test_extensions_verify_what_hashes_claim(monkeypatch):
    """With hashes that always agree, the direct check still finds the first difference, on both sides."""
    monkeypatch.setattr(periodic_runs.Extensions, "alike", lambda *a: True)
    w = [*range(20), 99, *range(20), 98]
    e = periodic_runs.Extensions(w)
    assert e.right(0, 21, len(w) - 21) == 20 and e.left(20, 41, 20) == 20
    assert periodic_runs.Extensions([*range(30), 5, *range(15), 77, *range(16, 30)]).right(0, 31, 30) == 15


def test_runs_of_repeated_words_take_linear_time():
    assert periodic_runs.runs_of([0] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.runs_of([0, 1, 2] * 30_000) == [(0, 90_000, 3)]


def test_periodic_runs_of_odd_documents(spark):
    texts = ODD + ["x y z " * 5 + "end", "a " * 12, "a " * 11, "p q " * 6 + "r s t " * 6]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, "  "), (3, "  ")]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n_words int, collapsed string")
    mine = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect())
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        runs = brute_runs(w, 12)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        want.append((i is None, i or 0, len(w), runs, b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    assert mine == sorted(want)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(i % 60))) for i in range(300)] + [(None, "a b c d e"), (40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in docs.select("doc_id", "text", periodic_runs.planted().alias("new")).collect():
        w = (r["text"] or "").split()
        h, n = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert r["new"].split() == w


def test_pieces_equal_the_library(spark):
    library, mine = SentencePieceProcessor(model_file=MODEL), pieces.Pieces(MODEL)
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD)] + [(None, "null id", 5), (1, "", 5), (1, "", 5)], "doc_id long, text string, n_tokens int")
    found = pieces.piece_digests(docs, MODEL, ids=True).collect()
    assert len(found) == docs.count()
    of = {r["doc_id"]: r for r in found if r["doc_id"] is not None and r["doc_id"] != 1}
    for i, t in enumerate(ODD):
        if i == 1:
            continue
        ids = library.encode(t or "")
        r = of[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids) == mine.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.piece_digests(docs.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("few", [2, 24])
def test_agendas_equal_the_library(monkeypatch, few):
    """Random texts, by rows of a matrix and by heaps."""
    monkeypatch.setattr(pieces, "FEW", few)
    rng, library, mine = random.Random(3), SentencePieceProcessor(model_file=MODEL), pieces.Encoder(pieces.Pieces(MODEL))
    letters = "ab e\n\t ▁  tthéñ日<>sx0😀1=-_.,́​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for found, text in zip(mine.encode(texts), texts, strict=True):
        ids = library.encode(text)
        assert found == (len(ids), ",".join(map(str, ids)).encode(), library.decode(ids))


def test_the_library_check_sees_differences():
    encoder = pieces.Encoder(pieces.Pieces(MODEL))
    encoder.pieces.ranks = encoder.pieces.ranks[::-1].copy()
    with pytest.raises(ValueError, match="otherwise"):
        encoder.encode(["internationally spoken"])


def test_pieces_forget(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 3)
    encoder = pieces.Encoder(pieces.Pieces(MODEL))
    texts = ["one two three four five", "six seven " + "eight" * 50]
    assert encoder.encode(texts) == encoder.encode(texts) == encoder.encode(texts[:1]) + encoder.encode(texts[1:])


def brute_lloyd(rows, k, rounds, seed, dims, scale=1024):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [best(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), m in zip(kept, of, strict=True) if m == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c[j]
    last = [best(v) for _, v in kept]
    inertia = {j: sum(d for d, m in last if m == j) for j in range(len(c))}
    return [(i, j, d, inertia[j], sum(inertia.values()), c[j]) for (i, _), (d, j) in zip(kept, last, strict=True)]


@pytest.mark.parametrize(("k", "block", "spread"), [(3, 2048, 1.0), (8, 40, 0.02), (5, 7, 30.0)])
def test_dual_tree_equals_brute_force(spark, monkeypatch, k, block, spread):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(4, 5)) * 3
    rows = [(i, (centres[i % 4] + spread * 0.1 * rng.normal(size=5)).tolist()) for i in range(300)]
    rows += [(500 + i, [0.25] * 5) for i in range(90)] + [(7, rows[7][1]), (7, [9.0] * 5), (None, [1.0] * 5), (None, None)]
    rows += [(900, [1.0] * 4), (901, [1.0] * 6), (902, []), (903, [1.0, None, 1.0, 1.0, 1.0]), (904, [float("nan")] * 5), (905, [float("inf")] * 5), (906, [-float("inf"), 1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, inertia int")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    monkeypatch.setattr(dual_tree, "LEAF", 3)
    found = [(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in dual_tree.dual_tree_lloyd(table, k, 4, "3", dims=5, block=block).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute_lloyd(rows, k, 4, "3", 5)))


def test_dual_tree_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert dual_tree.dual_tree_lloyd(spark.createDataFrame([], schema), 8, 2, "3").count() == 0
    one = dual_tree.dual_tree_lloyd(spark.createDataFrame([(1, [1.5] * 64)], schema), 8, 2, "3").collect()
    assert [(r["cluster"], r["distance"], r["inertia"]) for r in one] == [(0, 0, 0)]
    with pytest.raises(Exception, match="beyond exact"):
        dual_tree.dual_tree_lloyd(spark.createDataFrame([(1, [1e30] * 64)], schema), 8, 1, "3").count()


def test_cover_tree_invariants():
    """Every vector lies in its nodes' radius; separated clusters are pruned and assigned as whole nodes."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-20, 20, (200, 6)) + 5000 * np.eye(6, dtype=np.int64)[i] for i in range(6)]).astype(np.int64)
    tree, order = dual_tree.cover_tree(x)
    assert sorted(order.tolist()) == list(range(len(x))) and (x[order] == tree.vectors).all()
    for i in range(len(tree.low)):
        mine = tree.vectors[tree.low[i] : tree.high[i]]
        assert len(mine) and np.sqrt(((mine - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-6
    c = np.array([5000 * np.eye(6, dtype=np.int64)[i] for i in range(6)])
    met = list(dual_tree.walk(tree, dual_tree.centroid_tree(c)))
    assert all(len(m) == 1 for _, _, m in met) and len(met) < 30 and sorted(range(len(x))) == sorted(i for a, b, _ in met for i in range(a, b))
    big = x * (1 << 14)
    assert (dual_tree.squared(big, big[:3]) == ((big[:, None] - big[None, :3]) ** 2).sum(axis=2)).all()
