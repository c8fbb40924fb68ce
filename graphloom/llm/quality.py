"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled web text train a small network on statistics of the
whole text and on its content, hashed words and word pairs. The class prior is estimated from the two samples alone, by the best bin of a
positive-against-unlabelled score; the network then minimises the non-negative unbiased risk: the positive
part is pi times the positives' loss, the negative part is the unlabelled loss less pi times the positives', and where
that falls below zero the step goes the other way.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, id_text, map_rows, materialise, path_of, table, text_or_empty
from .folds import fold, lot
from .language_id import filter_texts

#: The network is fitted on at most so many unlabelled documents and so many positives, each drawn by id among all there are.
SAMPLE, POSITIVES = 12_000, 6_000
THRESHOLD = 0.3
HIDDEN, STEPS, RATE, DECAY = 12, 300, 0.02, 1e-3
#: Words whose hashes a task remembers.
MEMORY = 150_000
#: Buckets of hashed words and word pairs.
CONTENT = 64
GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", "#$%&*@^~+=<>\\/", "|", "-_", "\"'()[]{}:;`", "\n")


def group_table() -> np.ndarray:
    out = np.zeros((256, len(GROUPS)))
    for g, chars in enumerate(GROUPS):
        out[list(chars.encode()), g] = 1.0
    return out


TABLE = group_table()


def statistics(raw: bytes, words: list[bytes], h: np.ndarray) -> list[float]:
    """Shares of character groups, word and line statistics, repetition and compressibility of the whole text; ``h``: the words' hashes."""
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(len(raw), 1)
    groups = counts @ TABLE
    m = max(len(words), 1)
    often = np.unique(h, return_counts=True)[1]
    lines = raw.split(b"\n")
    ascii_letters = groups[0] + groups[1]
    beside = int((h[1:] == h[:-1]).sum())
    squeezed = len(zlib.compress(raw, 1)) / n
    return [
        *(np.log1p(100 * groups / n)), float(counts[128:].sum()) / n, groups[1] / max(ascii_letters, 1.0), float(np.log1p(len(raw))), float(np.log1p(len(words))),
        min(len(raw) / m, 50.0), len(often) / m, int(often.max(initial=0)) / m, beside / m, len(set(lines)) / len(lines), float(np.log1p(m / len(lines))), min(squeezed, 2.0),
    ]


class Words(dict):
    """Word -> 64-bit hash, for the words that a task has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def content(h: np.ndarray) -> np.ndarray:
    """Words and word pairs in hashed buckets, each sign from the hash: log counts, to unit length; ``h``: the words' hashes."""
    with np.errstate(over="ignore"):
        both = np.concatenate([h, (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xBF58476D1CE4E5B9)])
    signs = 1.0 - 2.0 * (both >> np.uint64(63)).astype(np.float64)
    sums = np.bincount((both >> np.uint64(32)).astype(np.int64) % CONTENT, weights=signs, minlength=CONTENT)
    out = np.sign(sums) * np.log1p(np.abs(sums))
    norm = np.sqrt(out @ out)
    return out / norm if norm else out


def features(text: str, hashes: Words) -> list[float]:
    raw = text.encode()
    words = raw.split()
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    return [*statistics(raw, words, h), *content(h)]


WIDTH = len(GROUPS) + 11 + CONTENT


class Network:
    """One hidden layer over standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        random = np.random.default_rng(7)
        self.mean, self.scale = mean, scale
        self.parts = [p.astype(np.float32) for p in (random.normal(0, 0.3, (WIDTH, HIDDEN)), np.zeros(HIDDEN), random.normal(0, 0.3, HIDDEN), np.zeros(1))]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.parts[0] + self.parts[1])
        return hidden, hidden @ self.parts[2] + self.parts[3]

    def gradient(self, x: np.ndarray, hidden: np.ndarray, out: np.ndarray) -> list[np.ndarray]:
        """Of the parameters, given that of the outputs."""
        back = out[:, None] * self.parts[2][None, :] * (1 - hidden**2)
        return [x.T @ back, back.sum(axis=0), hidden.T @ out, np.array([out.sum()])]

    def descend(self, of_outputs, x: np.ndarray) -> None:
        """Adam over the full sample."""
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        for t in range(1, STEPS + 1):
            hidden, f = self.forward(x)
            for i, g in enumerate(self.gradient(x, hidden, of_outputs(f.astype(np.float64)).astype(np.float32))):
                g = g + DECAY * self.parts[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.parts[i] = self.parts[i] - RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(self.standard(x))[1].astype(np.float64))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in the unlabelled scores: the least ratio of the tails above any score, each with its sampling error.

    Such a ratio is too large rather than too small, and a prior that is too large lets a whole kind of junk in, while
    one that is too small costs little; so half of the sampling error is taken off.
    """
    cuts = np.unique(np.quantile(positive, np.linspace(0.0, 0.95, 96)))
    above = lambda s: 1.0 - np.searchsorted(np.sort(s), cuts, side="left") / len(s)
    p, u = above(positive), above(unlabelled)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(((u + slack) / np.maximum(p, 1e-9)).argmin())
    return float(np.clip(u[best] / max(p[best], 1e-9) - slack / 2, 0.05, 0.99))


def separate(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Network:
    """A network that tells positives from unlabelled rows, both weighing half."""
    model = Network(mean, scale)
    n, m = len(positive), len(unlabelled)
    weight = np.concatenate([np.full(n, 0.5 / n), np.full(m, 0.5 / m)])
    target = np.concatenate([np.ones(n), np.zeros(m)])
    model.descend(lambda f: weight * (sigmoid(f) - target), model.standard(np.concatenate([positive, unlabelled])))
    return model


def risk_gradient(f: np.ndarray, n: int, prior: float) -> np.ndarray:
    """Of the non-negative unbiased risk by the outputs, of which the first ``n`` are the positives'."""
    s, m = sigmoid(f), len(f) - n
    negative = np.logaddexp(0, f[n:]).mean() - prior * np.logaddexp(0, f[:n]).mean()
    down = np.concatenate([-prior * s[:n] / n, s[n:] / m])  # gradient of the negative part
    up = np.concatenate([prior * (s[:n] - 1) / n, np.zeros(m)])
    return up + down if negative >= 0 else -down


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Network, float]:
    """The network and the estimated prior. The prior is the mean over two halves, each scored by a network that has seen the other only."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    n = len(positive)
    x = Network(mean, scale).standard(both)
    priors = []
    for half in (0, 1) if min(n, len(unlabelled)) >= 4 else ():
        seen = separate(positive[half::2], unlabelled[half::2], mean, scale)
        priors.append(estimate_prior(seen.score(positive[1 - half :: 2]), seen.score(unlabelled[1 - half :: 2])))
    prior = float(np.mean(priors)) if priors else 0.5
    model = Network(mean, scale)
    model.descend(lambda f: risk_gradient(f, n, prior), x)
    return model, prior


def draw(ids: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` of the ids, the first by a hash of the id; so few are always broadcast."""
    return F.broadcast(ids.withColumn("_lot", lot("id", label)).orderBy("_lot", "id").limit(most).select("id"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, positives: int = POSITIVES) -> Network | None:
    """``docs``: doc_id, text (not null); ``labels``: doc_id, quality. Rows of fold 0 are never used. None if there are no positives.

    Both samples are drawn of ids, before any text is read: the unlabelled one of all documents, the trusted one of all documents that
    are labelled good, so that it does not shrink where labels are rare. Label rows of one document count once,
    positive if any is; rows that repeat an id are drawn together.
    """
    open_ = docs.filter(fold() != 0).select(id_text().alias("id"), "text")
    ids = open_.select("id").distinct()
    good = labels.filter(F.col("quality") == 1).select(id_text().alias("id")).distinct()
    trusted = materialise(draw(ids.join(good, "id", "left_semi"), "trusted", positives).withColumn("good", F.lit(1)), "trusted")
    drawn = materialise(draw(ids, "quality", sample).withColumn("drawn", F.lit(1)), "drawn")
    rows = open_.join(F.broadcast(trusted), "id", "left").join(F.broadcast(drawn), "id", "left").filter("good = 1 OR drawn = 1")

    def make():
        hashes = Words()
        return lambda columns: [columns[0], columns[1], columns[2], [features(t, hashes) for t in columns[3]]]

    # As Arrow, since lists of boxed numbers take the driver several times as much.
    found = map_rows(rows.select("id", "good", "drawn", "text"), make, "id string, good int, drawn int, x array<double>").toArrow()
    forget(docs.sparkSession, {path_of(trusted), path_of(drawn)})
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    order = np.lexsort((x[:, 0], found["id"].to_numpy(zero_copy_only=False).astype(str)))
    good, drawn = (found[c].is_valid().to_numpy(zero_copy_only=False).astype(bool)[order] for c in ("good", "drawn"))
    positive, unlabelled = x[order[good]], x[order[drawn]]
    del found, x
    return fit(positive, unlabelled)[0] if len(positive) else None


def scorer(spark: SparkSession, model: Network | None):
    """A function that makes, in a task, texts -> scores from 0 to 1; without a model every score is 0.5. The model travels as one broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def make():
        model, hashes = shared.value, Words()

        def score(texts: list[str]) -> list[float]:
            if model is None or not texts:
                return [0.5] * len(texts)
            return model.score(np.array([features(t, hashes) for t in texts])).tolist()

        return score

    return make


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every whole text's quality: doc_id, held_out, score, predicted (1 if score >= ``threshold``).

    Null and empty texts are scored like any other (by their empty statistics). Equal texts get equal scores.
    An empty table gives an empty result; without any positive label every score is 0.5. Other columns are ignored.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    scores_of = scorer(docs.sparkSession, train(known, labels))

    def make():
        score = scores_of()

        def step(columns):
            scores = score(columns[2])
            return [columns[0], columns[1], scores, [int(s >= threshold) for s in scores]]

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 0).alias("held_out"), text_or_empty(text_col).alias("text"))
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``.

    Nulls, empty and long texts, ties and repeats are as in ``score_quality``: a null text is scored as an empty one, equal texts
    stay or go together, and without any positive label (scores 0.5) all rows stay or go. An empty table gives
    an empty result; columns pass through unchanged, whatever their names.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    scores_of = scorer(docs.sparkSession, train(known, labels))

    def make():
        score = scores_of()
        return lambda texts: [s >= least for s in score([t or "" for t in texts])]

    return filter_texts(docs, text_col, make)


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_pu_quality": op9_pu_quality}
SQL: dict[str, str] = {}
