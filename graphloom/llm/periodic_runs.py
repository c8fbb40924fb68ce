"""Periodic runs of words, by the longest Lyndon words that start at each position.

A text's words are scanned right to left with a stack: ``following[i]`` is the next position whose suffix is smaller than the one at i,
so the words from i up to it are the longest Lyndon word that starts at i. The scan is done under an order of the
words and under its opposite; every run has a period that one of the two scans finds as such a Lyndon word, with the run going on behind
it. Suffixes are compared, and candidates extended to the left, by the longest common extension of two positions: some words
directly, then a binary search over rolling hashes, whose answer is verified word by word. There is no suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, small_batches, table, text_or_empty, to_arrow

#: A run has at least so many words, and at least two periods.
LEAST_WORDS = 12
#: Words that are compared directly before hashes are asked.
DIRECT = 8
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


class Extensions:
    """Longest common extensions of two positions of a list of words (as numbers)."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.sums: list[int] | None = None

    def prepare(self) -> None:
        """Sums of hash(word at k) * BASE ** k, modulo 2 ** 64, before each position; and the powers."""
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, BASE, np.uint64)]), dtype=np.uint64)
            z = (np.array(self.words, dtype=np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((z ^ (z >> np.uint64(32))) * power[:-1], dtype=np.uint64)])
        self.sums, self.power = sums.tolist(), power.tolist()

    def alike(self, i: int, j: int, length: int) -> bool:
        """Whether the hashes of the ``length`` words from i and from j (i < j) agree."""
        s = self.sums
        return ((s[i + length] - s[i]) * self.power[j - i] - (s[j + length] - s[j])) & MASK == 0

    def right(self, i: int, j: int, most: int) -> int:
        """Words that are equal from i and from j (i < j) on, ``most`` at most."""
        w = self.words
        for k in range(min(DIRECT, most)):
            if w[i + k] != w[j + k]:
                return k
        if most <= DIRECT:
            return most
        if self.sums is None:
            self.prepare()
        low, high = DIRECT, most
        while low < high:
            middle = (low + high + 1) >> 1
            low, high = (middle, high) if self.alike(i, j, middle) else (low, middle - 1)
        if w[i : i + low] != w[j : j + low]:  # equal hashes of unequal words
            return next(k for k in range(low) if w[i + k] != w[j + k])
        return low

    def left(self, i: int, j: int, most: int) -> int:
        """Words that are equal before i and before j (i < j), ``most`` at most."""
        w = self.words
        for k in range(1, min(DIRECT, most) + 1):
            if w[i - k] != w[j - k]:
                return k - 1
        if most <= DIRECT:
            return most
        if self.sums is None:
            self.prepare()
        low, high = DIRECT, most
        while low < high:
            middle = (low + high + 1) >> 1
            low, high = (middle, high) if self.alike(i - middle, j - middle, middle) else (low, middle - 1)
        if w[i - low : i] != w[j - low : j]:
            return next(k - 1 for k in range(1, low + 1) if w[i - k] != w[j - k])
        return low


def lyndon_ends(w: list[int], extensions: Extensions) -> tuple[list[int], list[int]]:
    """(following, shared): the next position with a smaller suffix (or the end), and how many words the two suffixes share.

    The jumps along ``following`` are the stack of the scan. A suffix that is a prefix of another is the smaller one. Where the words up
    to j are those behind it (a repetition), the extension of (i, j) follows from that of (j, following[j]).
    """
    n = len(w)
    following, shared = [n] * n, [0] * n
    right = extensions.right
    for i in range(n - 2, -1, -1):
        a, j = w[i], i + 1
        while j < n:
            b = w[j]
            if a > b:
                break
            if a < b:
                j = following[j]
                continue
            p = j - i
            if following[j] == j + p and w[i:j] == w[j : j + p]:
                length = p + shared[j]
            else:
                length = right(i, j, n - j)
            if j + length == n or w[i + length] > w[j + length]:
                shared[i] = length
                break
            j = following[j]
        following[i] = j
    return following, shared


def runs_of(words: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words, by start, then period."""
    found, extensions = set(), Extensions(words)
    for order in (words, [-x for x in words]):
        following, shared = lyndon_ends(order, extensions)
        for i in np.flatnonzero(np.array(shared, dtype=np.int64)).tolist():
            period = following[i] - i
            length = period + shared[i]
            left = extensions.left(i, i + period, min(i, period)) if i else 0
            # A run's first period has a candidate, too: those of the later ones are left to it.
            if left < period <= left + shared[i] and left + length >= least:
                found.add((i - left, left + length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(gone.cumsum()[:-1] == 0).tolist()
    return b" ".join([words[i] for i in kept])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): the periodic runs of each whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of at least ``least`` words and two of its smallest
    period that no neighbouring word extends; runs come by start, then period. ``collapsed`` has the words that no run has
    after its first period, joined by one space. A null or empty text has no words and no runs; repeated rows repeat, null ids
    stay null; an empty table gives an empty result; other columns are ignored. No shuffle: each text is scanned where it is
    read, in time and memory in proportion to its words (and to log words for each comparison), also where all its words are equal.
    """
    small_batches(docs.sparkSession)
    schema = docs.sparkSession.createDataFrame([], "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").schema
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            for text in batch.column(1):
                words, number = text.as_py().encode().split(), {}
                found = runs_of([number.setdefault(x, len(number)) for x in words], least)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapsed(words, found).decode())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, arrow.field(2).type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, or for ids whose crc32 (h, of the id in decimal; a null id counts as the empty text) is divisible by 10, its words with a period:
    each word i >= a is word a + (i - a) % p, for g = h / 10, a = g % n, p = 1 + (n - a) / (3 + g % 8), all in whole numbers."""
    h = F.crc32(id_text(id_col).cast("binary"))
    text = text_or_empty(text_col)

    def turned(x: Column) -> Column:
        n, g = F.size(x["words"]), x["g"]
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x["words"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(places, " ")).otherwise("")

    # An array of one, so that the words are cut once and not for each place.
    once = F.array(F.struct(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"), F.floor(h / 10).alias("g")))
    return F.when(h % 10 == 0, F.get(F.transform(once, turned), F.lit(0))).otherwise(text)


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    rows = periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("b.length") / -F.col("b.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: Equal words of a document at i and i + q, in stretches of q or more consecutive i: periodic stretches. Of those with one start and end the smallest q is the period.
OP11_SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS steps FROM (
    SELECT b, list_reduce([b::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER], lambda acc, x: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384::UINTEGER) ELSE acc >> 1 END) AS c
    FROM (SELECT unnest(range(256))::UINTEGER AS b))),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::UINTEGER)), lambda acc, x: xor(acc >> 8, steps[(xor(acc, x) & 255) + 1])), 4294967295::UINTEGER)::BIGINT AS h
  FROM documents, crc),
e AS (SELECT k, doc_id, words, len(words) AS n, h, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
p AS MATERIALIZED (
  SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE words END AS words FROM f),
w AS MATERIALIZED (SELECT k, unnest(words) AS word, unnest(range(n)) AS i FROM p),
pairs AS (SELECT x.k, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.k = y.k AND x.word = y.word AND x.i < y.i),
marked AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT k, q, min(i) AS s, count(*) + q AS length FROM marked GROUP BY k, q, island HAVING count(*) >= q AND count(*) + q >= 12),
runs AS MATERIALIZED (SELECT k, s, length, min(q) AS q FROM stretches GROUP BY k, s, length),
dropped AS (SELECT DISTINCT k, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (SELECT w.k, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN dropped x ON w.k = x.k AND w.i = x.i GROUP BY w.k),
r AS (
  SELECT k, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines, first({'s': s, 'l': length, 'q': q} ORDER BY length DESC, s, q) AS b FROM runs GROUP BY k)
SELECT p.doc_id, coalesce(r.n_runs, 0) AS n_runs, r.b.s::BIGINT AS "start", r.b.l::BIGINT AS length, r.b.q::BIGINT AS period, (1000 * r.b.l // r.b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(r.lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM p LEFT JOIN r ON p.k = r.k LEFT JOIN kept ON p.k = kept.k
"""
QUERIES = {"op11_lyndon_runs": op11_lyndon_runs}
SQL = {"op11_lyndon_runs": OP11_SQL}
