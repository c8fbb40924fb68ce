"""URL filter by link-graph propagation, with DataFrame functions only.

Rules decide the URLs that they fit. The others are judged by their host: trust is a personalised PageRank
from hosts whose pages rules allow, along links; distrust is one from hosts whose pages rules block, against
links (who links to bad hosts is suspect). A host is blocked where its distrust reaches a threshold and
exceeds its trust.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, path_of, table

#: (verdict, host, path); at most MAX_RULES, as they become one expression.
Rules = Sequence[tuple[str, str, str]]
MAX_RULES = 1000
RULES: Rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rounds end when less than TOLERANCE of the seeds' sum is still to come.
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5


def most_rounds(damping: float, tolerance: float) -> int:
    """After so many rounds less than ``tolerance`` is still to come on any graph."""
    return math.ceil(math.log(tolerance * (1 - damping)) / math.log(damping))


ROUNDS = most_rounds(DAMPING, TOLERANCE)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def longest_rule(host: Column, path: Column, rules: Rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equally long ones the first by text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    kind = "struct<rule:string,verdict:string>"
    choose = lambda rest, r: F.when(fits(host, path, r[1], r[2]), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(rest)
    return reduce(choose, reversed(ordered), F.lit(None).cast(kind))


def host_edges(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(src, dst, n): pages of src that link to dst, another host. Relative links stay on their host and are no edges."""
    src, _ = url_parts(F.col(url_col))
    hosts = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    rows = pages.select(src.alias("src"), F.explode(hosts).alias("dst"))
    return rows.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Scores (kind, host, score): score = (1 - d) seed + d * sum over in-links of score(src) * share.

    ``edges``: (kind, src, dst, share), the shares of a source sum to 1; ``seeds``: (kind, host, seed). Scores are PageRank with the
    seeds as they are in place of a distribution over them, that is times their sum. Each round passes on what came in the round before,
    so hosts that nothing reaches drop out, and the rest that is not passed on yet is known: rounds end when it is below ``tolerance``
    of the seeds' sum, which it is after 97 rounds on any graph (``most_rounds``), or after ``rounds``. Both kinds go in one plan. Sums combine map-side, so a host that everything
    links to is no hot task. What flows into hosts without out-links stays there. Each round is written, which cuts the lineage.
    """
    spark = seeds.sparkSession
    flow = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    flows, total = [flow], flow.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
    for _ in range(most_rounds(damping, tolerance) if rounds is None else rounds):
        came = edges.join(flow.withColumnRenamed("host", "src"), ["kind", "src"])
        flow = materialise(came.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share") * damping).alias("score")), "flow")
        # What is still to come is at most this times d / (1 - d).
        left = flow.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        flows.append(flow)
        if left * damping / (1 - damping) <= tolerance * total:
            break
    scores = materialise(reduce(lambda a, b: a.unionByName(b), flows).groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
    forget(spark, [path_of(f) for f in flows[1:]])
    return scores


def judge_urls(pages: DataFrame, rules: Rules = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """Every page's verdict: page_id, host, path, rule, verdict.

    A host's seed of trust is the share of its pages that rules allow, of distrust the share that they block. A
    page without a rule is blocked if its host's distrust is at least ``threshold`` times (1 - damping) and more than
    its trust, else allowed. Null URLs and those without ``://`` have empty host and path and are allowed. Null html
    has no links. Repeated rows repeat; an empty table gives an empty result; other columns are ignored. The
    pages are joined with one row a host, which the planner broadcasts if small and else joins with its skew handling.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("_r", longest_rule(F.col("host"), F.col("path"), rules))
    parts = parts.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("_v"))
    share = lambda v: F.avg(F.when(F.col("_v") == v, 1.0).otherwise(0.0))
    seeds = parts.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")).filter("seed > 0")
    links = materialise(host_edges(pages, html_col, url_col), "links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = materialise(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "edges")
    scores = propagate(edges, materialise(seeds, "seeds"), damping, rounds)
    of = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    blocked = scores.groupBy("host").agg(of("trust").alias("t"), of("distrust").alias("d")).filter((F.col("d") >= threshold * (1 - damping)) & (F.col("d") > F.col("t")))
    joined = parts.join(materialise(blocked.select("host", F.lit("block").alias("_h")), "blocked"), "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_v", "_h", F.lit("allow")).alias("verdict"))


def op8_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _rules_sql() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{what((v, h, p))}'" for v, h, p in ordered) + " END"
    return f"{case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS v"


def _rounds_sql() -> str:
    """The flows of all rounds, by recursion, and their sums."""
    return f"""w(i, kind, host, score) AS (SELECT 0, kind, host, seed * {1 - DAMPING} FROM seeds WHERE seed > 0
  UNION ALL SELECT w.i + 1, e.kind, e.dst, sum(w.score * e.share * {DAMPING}) FROM w JOIN e ON w.kind = e.kind AND w.host = e.src WHERE w.i < {ROUNDS} GROUP BY ALL)"""


OP8_SQL = rf"""
WITH RECURSIVE u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, html FROM pages),
r AS (SELECT *, {_rules_sql()} FROM u),
h AS (SELECT host, avg((coalesce(v, '') = 'allow')::INT) AS t, avg((coalesce(v, '') = 'block')::INT) AS d FROM r WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host, t AS seed FROM h UNION ALL SELECT 'distrust', host, d FROM h),
l0 AS (SELECT page_id, host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", "''")}', 1), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM u),
l AS (SELECT src, dst, count(*) AS n FROM l0 WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
b AS (SELECT 'trust' AS kind, src, dst, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l),
e AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM b),
{_rounds_sql()},
f AS (SELECT host, coalesce(max(score) FILTER (kind = 'trust'), 0) AS t, coalesce(max(score) FILTER (kind = 'distrust'), 0) AS d FROM (SELECT kind, host, sum(score) AS score FROM w GROUP BY ALL) GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN f.d >= {THRESHOLD * (1 - DAMPING)} AND f.d > f.t THEN 'block' END, 'allow') AS verdict
FROM r LEFT JOIN f ON f.host = r.host
"""
QUERIES = {"op8_link_graph": op8_link_graph}
SQL = {"op8_link_graph": OP8_SQL}
