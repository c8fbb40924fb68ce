"""Packing by optimal length buckets.

The lengths of all sequences form one global histogram. Dynamic programming over it chooses the bucket
boundaries for which padding every sequence to its bucket's boundary costs least. Inside each bucket,
batches hold as many padded sequences as a token budget allows.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_number, materialise, md5_salt, table, text_or_empty

#: Longest sequence (longer documents become several), buckets, and padded tokens a batch.
MAX_TOKENS, BUCKETS, BUDGET = 2048, 16, 65536
#: Ends of buckets that the dynamic programme settles at a time, which bounds its memory.
COLUMNS = 128
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def optimal_boundaries(histogram: Mapping[int, int], buckets: int) -> list[int]:
    """The upper bounds, at most ``buckets``, that minimise the sum over sequences of bound - length.

    Exact: best[k][j] is the least cost of the first j distinct lengths in k buckets. Each level is a
    vectorised minimum over the last bucket's start, for COLUMNS ends at a time; of equal costs the earliest start is taken.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    rows, tokens = np.concatenate([[0], counts.cumsum()]), np.concatenate([[0], (counts * lengths).cumsum()])
    n, levels = len(lengths), min(buckets, len(lengths))
    # cost[i, j]: lengths i..j-1 in one bucket bounded by lengths[j-1]
    huge = np.iinfo(np.int64).max // 4
    cost, parts = np.empty((n, n), dtype=np.int64), [slice(c, c + COLUMNS) for c in range(0, n, COLUMNS)]
    for c in parts:
        of = lengths[None, c] * (rows[1:][None, c] - rows[:-1, None]) - (tokens[1:][None, c] - tokens[:-1, None])
        cost[:, c] = np.where(np.arange(n)[:, None] <= np.arange(n)[None, c], of, huge)
    best, cut = cost[0].copy(), [np.zeros(n, dtype=np.int64)]
    for _ in range(levels - 1):
        before = np.concatenate([[huge], best[:-1]])[:, None]
        start, better = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for c in parts:
            total = before + cost[:, c]
            start[c], better[c] = total.argmin(axis=0), total.min(axis=0)
        cut.append(start)
        best = np.minimum(better, huge)
    bounds, j = [], n - 1
    for start in reversed(cut):
        bounds.append(int(lengths[j]))
        j = int(start[j]) - 1
        if j < 0:
            break
    return bounds[::-1]


def sequences(docs: DataFrame, tokens: Column, max_tokens: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, chunk, start, n_tokens): a document's tokens in windows of ``max_tokens``; one without tokens has one empty window."""
    lengths = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens.alias("_n"))
    chunks = F.greatest(F.ceil(F.col("_n") / F.lit(max_tokens)), F.lit(1)).cast("int")
    rows = lengths.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    start = F.col("chunk").cast("long") * max_tokens
    return rows.select("doc_id", "chunk", start.alias("start"), F.least(F.lit(max_tokens).cast("long"), F.col("_n") - start).alias("n_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Every document's sequences with bucket, bound and batch.

    Returns doc_id, chunk, start, n_tokens, bucket (from 0, by length), bound, slot (gapless from 0 in the
    bucket), batch (slot // sequences a batch; bound times sequences is at most ``budget``, but one sequence
    is always allowed). ``tokens`` counts a document's tokens (default: its words). Null and empty texts give
    one empty sequence in the first bucket; repeated rows are packed as often as they occur; an empty table
    gives an empty result; other columns are ignored.

    The histogram has at most ``max_tokens`` + 1 rows, whatever the input; only it reaches the driver.
    """
    counted = tokens if tokens is not None else word_count(text_or_empty(text_col))
    rows = materialise(sequences(docs, counted, max_tokens, id_col), "sequences")
    histogram = {int(r[0]): int(r[1]) for r in rows.groupBy("n_tokens").count().collect()}
    bounds = optimal_boundaries(histogram, buckets) or [max_tokens]
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(array, lambda b: b < F.col("n_tokens")))
    rows = rows.withColumn("bucket", bucket).withColumn("_salt", md5_salt(F.col("doc_id"), F.col("chunk"), F.col("n_tokens")))
    rows = gapless_number(rows, "bucket", "_salt", ["doc_id", "chunk", "n_tokens"], "slot")
    bound = F.element_at(array, F.col("bucket") + 1)
    each = F.greatest(F.floor(F.lit(budget) / F.greatest(bound, F.lit(1))), F.lit(1)).cast("long")
    return rows.select("doc_id", "chunk", "start", "n_tokens", "bucket", bound.alias("bound"), "slot", F.floor(F.col("slot") / each).cast("long").alias("batch"))


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _dp_sql(buckets: int) -> str:
    """The dynamic programme as one common table expression a level."""
    levels = ["b1 AS (SELECT j, c AS best, 0::BIGINT AS start FROM cost WHERE i = 0)"]
    for k in range(2, buckets + 1):
        levels.append(f"b{k} AS (SELECT cost.j, min(p.best + cost.c) AS best, arg_min(cost.i, (p.best + cost.c) * 100000 + cost.i) AS start FROM cost JOIN b{k - 1} p ON p.j = cost.i - 1 GROUP BY cost.j)")
    picks = [f"t{buckets} AS (SELECT k, (SELECT max(j) FROM b1) AS j FROM (SELECT least({buckets}, count(*)) AS k FROM h))"]
    # One walk down for each possible number of levels: t_k holds the bound's index at level k, if that level is used.
    walk, names = [], []
    for k in range(buckets, 0, -1):
        source = picks[0].split(" AS ")[0] if k == buckets else f"t{k}"
        walk.append(f"{source} AS (SELECT (SELECT max(j) FROM b1) AS j WHERE (SELECT least({buckets}, count(*)) FROM h) = {k}" + (f" UNION ALL SELECT b.start - 1 FROM t{k + 1} t JOIN b{k + 1} b ON b.j = t.j WHERE b.start > 0" if k < buckets else "") + ")")
        names.append(f"SELECT j FROM t{k}")
    return ",\n".join(levels + walk + [f"bounds AS (SELECT l AS bound, row_number() OVER (ORDER BY l) - 1 AS bucket FROM h WHERE j IN ({' UNION ALL '.join(names)}))"])


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n FROM documents),
s AS (SELECT doc_id, n, unnest(range(0, greatest(ceil(n / {MAX_TOKENS}.0)::BIGINT, 1)))::INT AS chunk FROM d),
q AS (SELECT doc_id, chunk, chunk::BIGINT * {MAX_TOKENS} AS start, least({MAX_TOKENS}, n - chunk::BIGINT * {MAX_TOKENS}) AS n_tokens FROM s),
h0 AS (SELECT n_tokens AS l, count(*) AS c FROM q GROUP BY 1),
h AS (SELECT l, c, row_number() OVER (ORDER BY l) - 1 AS j, sum(c) OVER (ORDER BY l) AS r, sum(c * l) OVER (ORDER BY l) AS t FROM h0),
cost AS (SELECT a.j AS i, b.j AS j, (b.l * (b.r - a.r + a.c) - (b.t - a.t + a.c * a.l))::BIGINT AS c FROM h a JOIN h b ON a.j <= b.j),
{_dp_sql(BUCKETS)},
p AS (SELECT q.*, (SELECT count(*) FROM bounds WHERE bound < q.n_tokens) AS bucket, substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || chunk || '/' || n_tokens), 1, 2) AS salt FROM q),
z AS (SELECT p.*, bounds.bound, row_number() OVER (PARTITION BY p.bucket ORDER BY salt, doc_id, chunk, n_tokens) - 1 AS slot FROM p JOIN bounds USING (bucket))
SELECT doc_id, chunk, start::BIGINT AS start, n_tokens::BIGINT AS n_tokens, bucket::INT AS bucket, bound::BIGINT AS bound, slot::BIGINT AS slot,
  (slot // greatest({BUDGET} // greatest(bound, 1), 1))::BIGINT AS batch
FROM z
"""
QUERIES = {"op3_length_buckets": op3_length_buckets}
SQL = {"op3_length_buckets": OP3_SQL}
