"""Exact top-k retrieval by bag-of-words cosine over an inverted index with upper bounds.

Rows with the same words (and signature) are one class, so copies cost nothing. A word's posting list is read in two ways. First each
query meets the *heads* of its words' lists, the few rows with the greatest weights, and the k-th best of these scores is
a threshold. Then the query's words are ordered from rare to common, and those at the common end whose weights, times the greatest
weight that any row has there, cannot reach the threshold together, are given up: a row that shares no other word is not among
the k best. The remaining words' lists are read only in the tiers of weight from which on a row can still reach
the threshold. So a word that all rows have is read whole only where nothing better is to be had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..steps import written
from .ranks import value_places

#: Rows of a word from which on its postings are dealt over salts, and the most salts.
HOT_ROWS, MOST_SALTS = 10_000, 64
#: More than what rounding changes in a similarity of 9 digits. Tiers of weights are half octaves.
SLACK, LAST_TIER = 1e-8, 60


def bag_classes(df: DataFrame, tokens: str, id_col: str, group: str | None, signature: str | None) -> tuple[DataFrame, DataFrame]:
    """(members: id, cls; classes: cls, g, sig, tokens): rows of the same group, signature and words are a class, named by its least id."""
    value = lambda c: (F.col(c).cast("string") if c else F.lit(None).cast("string"))
    words = F.array_sort(F.coalesce(F.filter(tokens, lambda t: t.isNotNull()), F.array().cast("array<string>")))
    rows = df.select(F.col(id_col).alias("id"), value(group).alias("g"), value(signature).alias("sig"), words.alias("tokens"))
    rows = rows.withColumn("key", F.sha2(F.to_json(F.struct("g", "sig", "tokens")), 256))
    classes = rows.groupBy("key").agg(F.min("id").alias("cls"), *[F.first(c).alias(c) for c in ("g", "sig", "tokens")])
    members = rows.select("id", "key").join(classes.select("key", "cls"), "key").select("id", "cls")
    return written(members, "members"), written(classes.drop("key"), "classes")


def weighed(classes: DataFrame) -> DataFrame:
    """(cls, g, t, n, norm, w): each class's words with their counts and weights."""
    bags = classes.select("cls", "g", F.explode("tokens").alias("t")).groupBy("cls", "g", "t").agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("cls")))
    return written(bags.withColumn("norm", norm).withColumn("w", F.col("n") / F.col("norm")), "bags")


def tier(w):
    return F.least(F.floor(-2 * F.log2(w)), F.lit(LAST_TIER)).cast("int")


def scores(pairs: DataFrame, queries: DataFrame, bags: DataFrame) -> DataFrame:
    """(q, cls, similarity) of the pairs, over all common words."""
    mine = queries.select("q", "t", F.col("n").alias("nq"), F.col("norm").alias("norm_q"))
    theirs = bags.select("cls", "t", F.col("n").alias("nd"), F.col("norm").alias("norm_d"))
    dots = pairs.join(mine, "q").join(theirs, ["cls", "t"]).groupBy("q", "cls").agg(F.sum(F.col("nq") * F.col("nd")).alias("dot"), F.first("norm_q").alias("nq"), F.first("norm_d").alias("nd"))
    return dots.select("q", "cls", F.round(F.col("dot") / (F.col("nq") * F.col("nd")), 9).alias("similarity"))


def retrieve(df: DataFrame, pool: DataFrame, tokens: str, k: int, cut: float, group: str | None = None, signature: str | None = None, exclude_match: bool = False, fill: bool = True, id_col: str = "id") -> DataFrame:
    """(id, other, similarity, rank): the ``k`` rows of ``pool`` (of the same group) most like each row by cosine of word counts, below ``cut``; ties by id.

    ``exclude_match`` leaves out rows of the same signature; a row never gets itself. With ``fill`` rows without a common word (similarity 0)
    follow by id where fewer are similar; a row without words gets only such. Ids must be unique in each table. Null groups are
    one group. Results are exact (to the rounding to 9 digits), whatever the bounds skip.
    """
    if cut > 1:
        raise ValueError("rows with the very same words are told apart by the cut, so it is 1 at most")
    members, classes = bag_classes(pool, tokens, id_col, group, signature)
    asking, questions = bag_classes(df, tokens, id_col, group, signature)
    bags, queries = weighed(classes), weighed(questions).withColumnRenamed("cls", "q")
    found = candidate_scores(queries, bags, classes, questions, k, cut, exclude_match)
    valid = allowed(found, classes, questions, cut, exclude_match)
    best = valid.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "cls"))).filter(F.col("_r") <= k).drop("_r")
    best = written(best.select("q", "cls", "similarity"), "best")
    if fill:
        best = best.unionByName(zeros(best, found, classes, questions, k, exclude_match))
    # A class's first k members suffice; of an equal number of classes the least members come first in any case.
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).filter(F.col("_r") <= k + 1).select("cls", F.col("id").alias("other"))
    out = asking.withColumnRenamed("cls", "q").join(best, "q").join(first, "cls").filter(F.col("id") != F.col("other"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "other", "similarity", "rank")


def allowed(found: DataFrame, classes: DataFrame, questions: DataFrame, cut: float, exclude_match: bool) -> DataFrame:
    out = found.filter(F.col("similarity") < cut)
    if exclude_match:
        out = out.join(questions.select(F.col("cls").alias("q"), F.col("sig").alias("_own")), "q").join(classes.select("cls", "sig"), "cls").filter(F.col("_own") != F.col("sig")).drop("_own", "sig")
    return out


def candidate_scores(queries: DataFrame, bags: DataFrame, classes: DataFrame, questions: DataFrame, k: int, cut: float, exclude_match: bool) -> DataFrame:
    """(q, cls, similarity) of all pairs that may be among the k best, excluded ones included; written."""
    same = lambda c: F.coalesce(c, F.lit("\x00null"))
    bags, queries = bags.withColumn("g", same(F.col("g"))), queries.withColumn("g", same(F.col("g")))
    posted = bags.withColumn("tier", tier(F.col("w")))
    stats = posted.groupBy("g", "t").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("most"), F.collect_set("tier").alias("tiers"))
    stats = written(stats, "words")
    deep = k + 2  # the row's own class, one more, and k
    place = F.row_number().over(Window.partitionBy("g", "t").orderBy(F.desc(F.round("w", 12)), "cls"))  # limited before the shuffle
    heads = posted.withColumn("_r", place).filter(F.col("_r") <= deep).select("g", "t", "cls")
    met = written(queries.select("q", "g", "t").join(heads, ["g", "t"]).select("q", "t", "cls"), "met")
    first = written(scores(met.select("q", "cls").distinct(), queries, bags), "first")
    fine = allowed(first, classes, questions, cut, exclude_match)
    top = fine.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "cls"))).filter(F.col("_r") == k)
    threshold = top.select("q", F.col("similarity").alias("theta"))
    deep_enough = met.join(fine.select("q", "cls"), ["q", "cls"]).groupBy("q", "t").agg(F.count(F.lit(1)).alias("fine"))
    words = queries.select("q", "g", "t", "w").join(stats, ["g", "t"]).join(threshold, "q", "left").join(deep_enough, ["q", "t"], "left")
    of_query = Window.partitionBy("q").orderBy("df", "t")
    rest, before = of_query.rowsBetween(Window.currentRow, Window.unboundedFollowing), of_query.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What the words from this one on can add: by their greatest weights, and by the length of both vectors.
    words = words.withColumn("bound", F.least(F.sum(F.col("w") * F.col("most")).over(rest), F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest)))).withColumn("left", F.count(F.lit(1)).over(rest))
    # Of rows that share the last word only, the head has the best; it suffices if k of them are allowed, or if it is the whole list.
    headed = (F.col("left") == 1) & ((F.coalesce("fine", F.lit(0)) >= k) | (F.col("df") <= deep))
    given_up = (F.coalesce(F.col("bound") < F.col("theta") - SLACK, F.lit(False))) | headed
    words = words.withColumn("read", ~given_up)
    beyond = F.coalesce(F.max(F.when(~F.col("read"), F.col("bound"))).over(Window.partitionBy("q")), F.lit(0.0))
    share = F.sum(F.col("w") * F.col("w")).over(before)
    whole = F.max(F.when(F.col("read"), share)).over(Window.partitionBy("q"))
    # A row that reaches the threshold has one of the words that are read with at least this weight.
    least = F.greatest((F.col("theta") - SLACK - beyond) * F.col("w") / whole - SLACK, F.lit(0.0))
    words = words.withColumn("least", F.coalesce(least, F.lit(0.0))).filter("read")
    deepest = F.when(F.col("least") > 0, tier(F.col("least"))).otherwise(LAST_TIER)
    salts = F.least(F.ceil(F.col("df") / HOT_ROWS), F.lit(MOST_SALTS)).cast("int")
    words = words.select("q", "g", "t", "least", F.explode(F.filter("tiers", lambda x: x <= deepest)).alias("tier"), F.pmod(F.xxhash64("q"), salts).cast("int").alias("salt"))
    lists = posted.join(stats.select("g", "t", salts.alias("salts")), ["g", "t"]).select("g", "t", "tier", "cls", "w", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    more = words.join(lists, ["g", "t", "tier", "salt"]).filter(F.col("w") >= F.col("least")).select("q", "cls").distinct()
    more = written(more.join(first.select("q", "cls"), ["q", "cls"], "left_anti"), "more")
    return written(first.unionByName(scores(more, queries, bags)), "scored")


def zeros(best: DataFrame, found: DataFrame, classes: DataFrame, questions: DataFrame, k: int, exclude_match: bool) -> DataFrame:
    """(q, cls, 0.0): for queries of fewer than ``k`` similar classes the first ones by id that have no common word. What such a query has in common with others was read whole."""
    same = lambda c: F.coalesce(c, F.lit("\x00null"))
    asked = questions.select(F.col("cls").alias("q"), same(F.col("g")).alias("g"), same(F.col("sig")).alias("own"))
    have = best.groupBy("q").agg(F.count(F.lit(1)).alias("have"))
    common = found.groupBy("q").agg(F.count(F.lit(1)).alias("common"))
    short = asked.join(have, "q", "left").filter(F.coalesce("have", F.lit(0)) < k).join(common, "q", "left")
    short = written(short.select("q", "g", "own", (F.lit(k) + F.coalesce("common", F.lit(0))).alias("need")), "short")
    most = short.agg(F.max("need")).first()[0]
    rows = classes.select("cls", same(F.col("g")).alias("g"), same(F.col("sig")).alias("sig"))
    if most is None:
        return best.limit(0)
    rows = rows.join(short.select("g").distinct(), "g", "left_semi")
    if exclude_match:  # of the first 2 * most rows, of which no signature has more than most, at least most are of other signatures
        rows = value_places(rows.withColumn("n", F.lit(1)), ["g", "sig"], "cls").filter(F.col("before") < most).select("cls", "g", "sig", "n")
    else:
        rows = rows.withColumn("n", F.lit(1))
    placed = value_places(rows, ["g"], "cls").filter(F.col("before") < 2 * most)
    pairs = short.join(placed, "g").filter((F.col("before") < 2 * F.col("need")) | F.lit(exclude_match))
    pairs = pairs.filter(F.col("own") != F.col("sig")) if exclude_match else pairs
    pairs = pairs.join(found.select("q", "cls"), ["q", "cls"], "left_anti")
    at = F.row_number().over(Window.partitionBy("q").orderBy("cls"))
    # One more than k, as the row itself may be the least of a class without words.
    return pairs.withColumn("_r", at).filter(F.col("_r") <= k + 1).select("q", "cls", F.lit(0.0).alias("similarity"))
