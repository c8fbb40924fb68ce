"""Exact dedup by Golomb-coded fingerprint exchange.

Rows are dealt to *senders* by a hash of their id and text. Each sender sends, to the *owner* of each hash range, its
distinct fingerprints sorted, as Golomb-Rice coded gaps. An owner merges the lists of all senders and
answers each with a bitmap over that list: 1 where the fingerprint occurs more than once in the corpus. Only
the rows so marked, the suspects, have their texts grouped byte by byte.

What travels before the verification is a few bytes a fingerprint. A fingerprint that a third of all rows
share is one list entry (with a bit that says "repeated here") for each sender, so no owner is hot. In the
verification equal texts collapse in each map task before they are shuffled.

Texts that are no suspects do not move. Where the list of suspects is small it is broadcast; else a Bloom filter of their
fingerprints is, a table of words of bits whose size is bounded, and only what it lets through meets the list by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, table

#: The filter of suspects: words of a block, bits a fingerprint, bits set of these, and the most words (64 MB).
BLOCK_WORDS, FILTER_BITS, HASHES, MOST_WORDS = 256, 16, 4, 1 << 23
#: Rows of an owner at most, about: what one task decodes at once. Fingerprints of a list at least, about, in large tables.
OWNED, LISTED = 500_000, 64
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def golomb_encode(values: np.ndarray) -> tuple[bytes, int]:
    """Sorted distinct unsigned integers as Golomb-Rice coded gaps; returns the code and its parameter.

    The parameter is the bit length of the mean gap. The quotients come first, unary (ones, then a zero), then the remainders.
    """
    values = np.asarray(values, dtype=np.uint64)
    if not len(values):
        return b"", 0
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // len(values)
    k = min(max(mean.bit_length() - 1, 0), 63)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    while quotient.max() > 4096:  # one huge gap must not make a huge unary run
        k += 1
        quotient = (gaps >> np.uint64(k)).astype(np.int64)
    stops = (quotient + 1).cumsum() - 1
    unary = np.ones(int(stops[-1]) + 1, dtype=np.uint8)
    unary[stops] = 0
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(np.concatenate([unary, rest.ravel().astype(np.uint8)])).tobytes(), k


def golomb_decode(code: bytes, k: int, n: int) -> np.ndarray:
    """The ``n`` integers that ``golomb_encode`` wrote."""
    if not n:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    stops = np.flatnonzero(bits == 0)[:n]  # the quotients' zeros come before all remainders
    quotients = np.diff(stops, prepend=-1) - 1
    first = int(stops[-1]) + 1
    rest = np.zeros(n, dtype=np.uint64)
    for column in bits[first : first + n * k].reshape(n, k).T:
        rest = (rest << np.uint64(1)) | column
    with np.errstate(over="ignore"):
        return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) | rest, dtype=np.uint64)


LIST = "owner int, sender int, n int, k int, code binary, again binary"


class Ranges:
    """The owners' ranges of fingerprints of ``bits`` bits (32 to 63): equal ones, by the upper 32 bits."""

    def __init__(self, owners: int, bits: int):
        self.owners, self.low = owners, np.uint64(bits - 32)

    def owner(self, values: np.ndarray) -> np.ndarray:
        return (((values >> self.low) * np.uint64(self.owners)) >> np.uint64(32)).astype(np.int64)

    def floor(self, owner: int) -> np.uint64:
        """A floor of an owner's range, from which its lists count."""
        return np.uint64((owner << 32) // self.owners) << self.low

    def runs(self, values: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(owner, start, end) of each owner's run in sorted values."""
        owner = self.owner(values)
        edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(values)] if len(values) else [0]
        return zip(owner[edges[:-1]].tolist(), edges, edges[1:], strict=False)


def unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def send(ranges: Ranges):
    """A sender's lists, one for each owner that has any of its fingerprints (distinct, with their number of rows)."""

    def lists(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("fp")
        values, again, sender = unsigned(part["fp"]), part["n"].to_numpy() > 1, int(part["sender"].iloc[0])
        out = []
        for o, i, j in ranges.runs(values):
            code, k = golomb_encode(values[i:j] - ranges.floor(o))
            out.append((o, sender, j - i, k, code, np.packbits(again[i:j]).tobytes()))
        return pd.DataFrame(out, columns=["owner", "sender", "n", "k", "code", "again"])

    return lists


def answer(lists: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: for each sender's list, 1 where the fingerprint has more than one row anywhere."""
    decoded = [golomb_decode(r.code, r.k, r.n) for r in lists.itertuples()]  # all count from the same floor
    again = [np.unpackbits(np.frombuffer(r.again, dtype=np.uint8), count=r.n) for r in lists.itertuples()]
    values, where = np.unique(np.concatenate(decoded), return_inverse=True)
    rows = np.bincount(where, weights=np.concatenate(again) + 1.0, minlength=len(values))
    marks = np.split((rows > 1)[where], np.cumsum([len(x) for x in decoded])[:-1])
    return pd.DataFrame({"owner": lists["owner"], "sender": lists["sender"], "bitmap": [np.packbits(m).tobytes() for m in marks]})


def receive(ranges: Ranges):
    """A sender's suspects: the fingerprints that its bitmaps mark."""

    def suspects(key, part: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
        values = unsigned(part["fp"].sort_values())
        of = dict(zip(bitmaps["owner"], bitmaps["bitmap"], strict=True))
        found = [values[i:j][np.unpackbits(np.frombuffer(of[o], dtype=np.uint8), count=j - i) == 1] for o, i, j in ranges.runs(values)]
        fps = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
        return pd.DataFrame({"sender": np.full(len(fps), key[0], dtype=np.int32), "fp": fps.view(np.int64)})

    return suspects


def exchange(fingerprints: DataFrame, owners: int, bits: int) -> DataFrame:
    """(sender, fp) of every fingerprint that more than one row has; ``fingerprints`` has sender int, fp long (of ``bits`` bits).

    A sender's equal fingerprints collapse in the map tasks, so that however many rows share one, it comes once.
    """
    ranges = Ranges(owners, bits)
    own = fingerprints.groupBy("sender", "fp").agg(F.count(F.lit(1)).alias("n"))
    bitmaps = own.groupBy("sender").applyInPandas(send(ranges), LIST).groupBy("owner").applyInPandas(answer, "owner int, sender int, bitmap binary")
    return own.select("sender", "fp").groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(receive(ranges), "sender int, fp long")


def filter_bits(fp: Column, blocks: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """The block of a fingerprint, and its (word, bit) places in it."""
    block = F.pmod(F.xxhash64(fp, F.lit(1)), F.lit(blocks)).cast("int")
    spread = F.xxhash64(fp, F.lit(2))
    at = [F.shiftrightunsigned(spread, 14 * i) for i in range(HASHES)]
    return block, [((F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(BLOCK_WORDS - 1))).cast("int"), x.bitwiseAND(F.lit(63)).cast("int")) for x in at]


def suspects_filter(suspects: DataFrame) -> tuple[DataFrame, int]:
    """A Bloom filter of the suspects' ``fp``: (block, words), one row a block, and the number of blocks.

    FILTER_BITS bits a row of ``suspects`` up to MOST_WORDS words (then about 34 million rows); beyond, the filter stays as large
    and lets more through: with 4 bits a fingerprint a sixth of the others, with one nearly all. It never loses a suspect.
    """
    words = min(max(suspects.count() * FILTER_BITS // 64, 1), MOST_WORDS)
    blocks = -(-words // BLOCK_WORDS)
    block, places = filter_bits(F.col("fp"), blocks)
    each = suspects.select(block.alias("block"), F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in places])).alias("x"))
    bits = each.select("block", "x.word", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.bit")).alias("bits"))
    none = suspects.sparkSession.range(blocks * BLOCK_WORDS).select((F.col("id") / BLOCK_WORDS).cast("int").alias("block"), (F.col("id") % BLOCK_WORDS).cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    full = bits.unionByName(none).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    return full.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")), blocks


def only_suspects(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    """The ``rows`` whose (sender, fp) is in ``suspects`` (materialised). Rows that are not there do not move (see ``suspects_filter``)."""
    listed = broadcast_if_small(suspects)
    if listed is suspects:  # too many for a broadcast
        rows = let_through(rows, suspects)
    return rows.join(listed, ["sender", "fp"], "left_semi")


def let_through(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    """The ``rows`` that the filter of ``suspects`` lets through; the filter is broadcast, so no row moves."""
    found, blocks = suspects_filter(suspects)
    found = materialise(found.withColumnRenamed("block", "__gl_block"), "filter")
    block, places = filter_bits(F.col("fp"), blocks)
    held = rows.join(F.broadcast(found), block == F.col("__gl_block"))  # bounded: MOST_WORDS
    for word, bit in places:
        held = held.filter(F.call_function("shiftrightunsigned", F.element_at("words", word + 1), bit).bitwiseAND(F.lit(1).cast("long")) == 1)
    return held.drop("__gl_block", "words")


def layout(rows: int, parts: int) -> tuple[int, int, int]:
    """(owners, senders, bits) for a number of rows.

    An owner has about OWNED rows. Senders are four times as many, but so few that a list has LISTED fingerprints in the mean, so
    that the lists grow with the rows and not with their square: at 20 billion rows 40,000 owners and 7,812 senders
    of 2.6 million rows. The bits make one in 4,000 fingerprints a false suspect at most; the bytes decide in the end.
    """
    owners = max(parts, -(-rows // OWNED))
    senders = max(parts, min(4 * owners, OWNED // LISTED))
    return owners, senders, min(max(rows.bit_length() + 12, 32), 63)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row for each document: which row of its class of equal texts stays.

    Texts are equal when they are so after deleting every character of ``[\\x20\\x09-\\x0D]``; null counts as
    empty. Of a class the row with the most code points stays, then the smallest id (a null id counts as the
    largest). Returns doc_id, keep_id, group_size, kept, text_sha256. Repeated rows count as rows; of equal
    rows with the same id every one says kept. An empty table gives an empty result; other columns are ignored; very long texts are read whole.
    ``parts``: the least number of owners and senders (default: the session's shuffle partitions); see ``layout``.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.translate(text, WHITE, "").alias("norm"), F.char_length(text).cast("long").alias("n_chars"))
    rows = rows.withColumn("fp", F.xxhash64("norm"))
    light = materialise(rows.select("doc_id", "n_chars", "fp", F.sha2("norm", 256).alias("sha")), "fingerprints")
    owners, senders, bits = layout(light.count(), parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    sender = F.pmod(F.xxhash64("doc_id", "n_chars", "fp"), F.lit(senders)).cast("int")
    short = F.shiftrightunsigned("fp", 64 - bits)
    rows, light = (d.withColumn("sender", sender).withColumn("fp", short) for d in (rows, light))
    suspects = materialise(exchange(light.select("sender", "fp"), owners, bits), "suspects")
    texts = only_suspects(rows, suspects)
    best = F.max(F.struct(F.col("n_chars").alias("n"), (-F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).alias("neg"), F.col("doc_id").alias("id"))).alias("best")
    classes = texts.groupBy("fp", "norm").agg(best, F.count(F.lit(1)).alias("size"))
    classes = classes.filter("size > 1").select("fp", F.sha2("norm", 256).alias("sha"), F.col("best.id").alias("keep"), "size")
    of_sender = suspects.join(classes, "fp")
    joined = light.alias("l").join(of_sender.alias("c"), ["sender", "fp", "sha"], "left")
    alone = F.col("size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
g AS (
  SELECT norm, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
QUERIES = {"op6_exact_dedup": op6_exact_dedup}
SQL = {"op6_exact_dedup": OP6_SQL}
