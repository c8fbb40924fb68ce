"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its token count, then its leading tokens; tokens with digits are variable fields
from the start. A leaf that fewer than ``MIN_TEXTS`` different texts reach is pruned. In the other leaves each
line stands under its own template and under generalised ones: the tokens after the leading ones are cut into
stretches, and one stretch (of three; lines of GENERAL_FROM tokens) or two (of five; lines of DOUBLE_FROM) become
variable fields. Lines whose differences lie in as many stretches meet under one of these templates.

A template recurs if enough *independent* texts hold it: texts of which a share of at least ``OWN_SHARE`` is their
own, that is, 5-word shingles that fewer than MIN_TEXTS holders of candidate templates have (two texts with such shares
have a similarity of at most 0.74). Near copies are not independent, so the body of a copied document is no
boilerplate, however many copies it has; exact copies are one text. All lines of recurring templates are dropped,
from every document that has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, forget, map_rows, materialise, path_of, small_batches, steps, table, to_arrow
from .simhash import mix

#: Leading tokens of a path; token counts from which one stretch of THIRDS, or two of FIFTHS, are generalised.
LEAD, GENERAL_FROM, DOUBLE_FROM = 2, 8, 12
THIRDS, FIFTHS = 3, 5
#: Lines of fewer tokens have a template only from so many bytes on (text without spaces), shorter ones stay.
MIN_TOKENS, MIN_BYTES = 3, 60
#: A template recurs in at least so many independent texts, and at least this share of the texts that hold it.
MIN_TEXTS, MIN_SHARE = 4, 0.05
#: Share of its own in a text that is no near copy of others; words of a shingle.
OWN_SHARE, SHINGLE = 0.15, 5
FIELD = b"<*>"
DIGIT = re.compile(rb"[0-9]")
#: Words whose hashes a task remembers; shingles that it holds before it deals them out.
MEMORY, HELD = 150_000, 1_000_000
#: Shingles of a range of hashes, on average; the least number of ranges, as a power of two.
RANGE, LEAST_BITS = 1 << 18, 10
ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word -> 64-bit hash; words with digits are all the variable field."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(FIELD if DIGIT.search(word) else word)
        return h


def stretch_sums(total: np.ndarray, starts: np.ndarray, counts: np.ndarray, parts: int) -> np.ndarray:
    """The sums of each line's stretches after the leading tokens; ``total`` are sums before each token of the text."""
    edges = starts[:, None] + LEAD + (counts[:, None] - LEAD) * np.arange(parts + 1) // parts
    at = total[np.minimum(edges, len(total) - 1)]  # of shorter lines nothing is used
    return at[:, 1:] - at[:, :-1]


def parse(texts: list[str], words: Words) -> list[tuple[list[int], list[int], list[np.ndarray], int]]:
    """Of each text: (line numbers, leaves, template keys of each line) of the lines that have templates, and its number of words."""
    lines = [text.encode().split(b"\n") for text in texts]
    tokens = [line.split() for ls in lines for line in ls]
    counts = np.array([len(t) for t in tokens], dtype=np.int64)
    h = np.fromiter(map(words.__getitem__, chain.from_iterable(tokens)), dtype=np.uint64, count=int(counts.sum()))
    size = np.array([len(x) for ls in lines for x in ls], dtype=np.int64)
    height = np.array([len(ls) for ls in lines], dtype=np.int64)
    ends = height.cumsum()
    has = np.flatnonzero((counts >= MIN_TOKENS) | (size >= MIN_BYTES) & (counts > 0))
    first = counts.cumsum() - counts
    if not len(has):
        return [([], [], [], 0)] * len(texts)
    place = np.arange(len(h)) - np.repeat(first, counts)
    with np.errstate(over="ignore"):
        weighed = h * (mix(place.astype(np.uint64), 1) | np.uint64(1))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), weighed.cumsum(dtype=np.uint64)])
        starts, n = first[has], counts[has]
        path = mix(n.astype(np.uint64), 2)
        for i in range(LEAD):  # a line may be shorter than its path
            path = mix(path ^ np.where(n > i, h[np.minimum(starts + i, len(h) - 1)], np.uint64(i)), 3)
        whole = total[starts + n] - total[starts]
        own = mix(path ^ whole, 4)
        thirds = whole[:, None] - stretch_sums(total, starts, np.maximum(n, LEAD), THIRDS)
        fifths = stretch_sums(total, starts, np.maximum(n, LEAD), FIFTHS)
        fifths = np.stack([whole - fifths[:, i] - fifths[:, j] for i, j in combinations(range(FIFTHS), 2)], axis=1)
        thirds = mix(mix(path[:, None] ^ thirds, 5) + np.arange(THIRDS, dtype=np.uint64), 6)
        fifths = mix(mix(path[:, None] ^ fifths, 7) + np.arange(fifths.shape[1], dtype=np.uint64), 8)
    single, double = np.column_stack([own, thirds]).view(np.int64), np.column_stack([own, fifths]).view(np.int64)
    keys = [double[i] if c >= DOUBLE_FROM else single[i] if c >= GENERAL_FROM else single[i, :1] for i, c in enumerate(n.tolist())]
    owner = np.searchsorted(ends, has, side="right")
    number, leaf = (has - (ends - height)[owner]).tolist(), path.view(np.int64).tolist()
    edges = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    so_far = np.concatenate([[0], counts.cumsum()])[np.concatenate([[0], ends])].tolist()
    return [(number[i:j], leaf[i:j], keys[i:j], q - p) for i, j, p, q in zip(edges, edges[1:], so_far, so_far[1:], strict=False)]


def shingle_sets(texts: list[str], words: Words) -> list[np.ndarray]:
    """Of each text: the hashes of its distinct shingles (of fewer words: of all together; of none: nothing)."""
    tokens = [text.encode().split() for text in texts]
    h = np.fromiter(map(words.__getitem__, chain.from_iterable(tokens)), dtype=np.uint64, count=sum(map(len, tokens)))
    ahead, found = [h], h
    with np.errstate(over="ignore"):
        for i in range(1, SHINGLE):
            found = mix(found[:-1] * ODD + h[i:], 0) if len(found) else found
            ahead.append(found)  # hashes of i + 1 words
    out, start = [], 0
    for t in tokens:
        end, k = start + len(t), min(SHINGLE, len(t))
        out.append(np.unique(ahead[k - 1][start : end - k + 1] if k else h[:0]).view(np.int64))
        start = end
    return out


def in_portions(texts: list[str], size: int = 200_000) -> Iterator[list[str]]:
    """The texts in runs of about ``size`` characters (or one longer text)."""
    portion, held = [], 0
    for text in texts:
        portion.append(text)
        held += len(text)
        if held >= size:
            yield portion
            portion, held = [], 0
    if portion:
        yield portion


PARSED = "id long, th long, line array<int>, leaf array<long>, keys array<array<long>>, words int"
#: Of a range of hashes, from one portion of a task: hashes and texts that have them; hashes that enough of its texts have;
#: texts and how many of those they have; texts (by their own hash) and how many shingles they have.
DEALT = "part int, h binary, th binary, often binary, had binary, had_n binary, all binary, all_n binary"


def deal(hashes: list[np.ndarray], ths: list[int], bits: int, min_texts: int) -> list[tuple]:
    """The rows of DEALT of one portion of texts: distinct shingle hashes of each, and their text hashes.

    What ``min_texts`` texts of the portion have is common for certain. It is sent as one hash, so a shingle of
    many texts costs each portion less than ``min_texts`` pairs. All that concerns a range is in its row alone, so a
    row is right by itself, however the texts were put into portions when a task ran again.
    """
    th, sizes = np.array(ths, dtype=np.int64), np.array([len(h) for h in hashes], dtype=np.int64)
    h = np.concatenate(hashes).view(np.uint64)
    order = np.argsort(h)
    h, owner = h[order], np.repeat(th, sizes)[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    often = np.diff(np.append(first, len(h))) >= min_texts
    common = np.repeat(often, np.diff(np.append(first, len(h))))
    of_text = th.view(np.uint64) >> np.uint64(64 - bits)
    by_text = np.argsort(of_text, kind="stable")
    parts = np.arange((1 << bits) + 1)
    edges = np.searchsorted(h >> np.uint64(64 - bits), parts).tolist()
    runs = np.searchsorted(h[first] >> np.uint64(64 - bits), parts).tolist()
    texts = np.searchsorted(of_text[by_text], parts).tolist()
    out = []
    for part in range(1 << bits):
        i, j, k, m = edges[part], edges[part + 1], texts[part], texts[part + 1]
        if i == j and k == m:
            continue
        few, at = ~common[i:j], first[runs[part] : runs[part + 1]]
        had, n = np.unique(owner[i:j][common[i:j]], return_counts=True)
        mine = by_text[k:m]
        columns = (h[i:j][few], owner[i:j][few], h[at[often[runs[part] : runs[part + 1]]]], had, n, th[mine], sizes[mine])
        out.append((part, *(c.tobytes() for c in columns)))
    return out


def settle(rows: list[list[np.ndarray]], min_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, numbers of common shingles) of one range, from all rows of it; a text may come more than once."""
    h, th, often, had, n = (np.concatenate(c) for c in list(zip(*rows, strict=True))[:5])
    order = np.argsort(h.view(np.uint64))
    h, th = h[order], th[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(first, len(h)))
    common = np.repeat((times >= min_texts) | np.isin(h[first], often), times)
    return np.concatenate([th[common], had]), np.concatenate([np.ones(int(common.sum()), dtype=np.int64), n])


def shares(owned: DataFrame, words: int, min_texts: int) -> DataFrame:
    """(th, n, c): each text's number of distinct shingles, and of those that ``min_texts`` texts have; ``owned`` (th, text)
    has each text once and about ``words`` words.

    Each task sorts portions of hashes and sends every range of hashes one packed row; an owner counts its ranges one
    after the other. One exchange of 16 bytes a shingle; a hash that many texts have costs a portion a few pairs.
    """
    small_batches(owned.sparkSession)
    bits = max(LEAST_BITS, (words // RANGE).bit_length())
    dealt = to_arrow(owned.sparkSession.createDataFrame([], DEALT).schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, hashes, ths, held = Words(), [], [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*deal(hashes, ths, bits, min_texts), strict=True), dealt, strict=True)], schema=dealt)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for th, found in zip(ids, chain.from_iterable(shingle_sets(some, memory) for some in in_portions(texts)), strict=True):
                hashes.append(found)
                ths.append(th)
                held += len(found)
                if held >= HELD:
                    yield packed()
                    hashes, ths, held = [], [], 0
        if ths:
            yield packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(th: np.ndarray, n: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(th), pa.array(n), pa.array(c)], names=["th", "n", "c"])

        def counted(rows: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if rows:
                texts, which = np.unique((found := settle(rows, min_texts))[0], return_inverse=True)
                c = np.bincount(which, weights=found[1], minlength=len(texts)).astype(np.int64)
                yield answer(texts, np.zeros(len(texts), dtype=np.int64), c)

        now, rows = None, []
        for batch in batches:
            for part, *values in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if part != now:
                    yield from counted(rows)
                    now, rows = part, []
                arrays = [np.frombuffer(v, dtype=np.int64) for v in values]
                rows.append(arrays[:5])
                yield answer(arrays[5], arrays[6], np.zeros(len(arrays[5]), dtype=np.int64))
        yield from counted(rows)

    by_range = owned.select("th", "text").mapInArrow(send, DEALT).repartition("part").sortWithinPartitions("part")
    return by_range.mapInArrow(count, "th long, n long, c long").groupBy("th").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def independent_texts(rows: DataFrame, lines: DataFrame, holders: DataFrame, min_texts: int, own_share: float) -> DataFrame:
    """(th) of the ``holders`` (th, owner: one id that has the text, words) of which at least ``own_share`` is their own. All their shingles are
    counted, made anew from one row of each text, so that other texts' shingles never exist. ``lines`` has the rows' (id, th)."""
    small = broadcast_if_small(holders.select(F.col("th").alias("own_th"), "owner"))

    def owned(df: DataFrame) -> DataFrame:
        return df.join(small, (F.col("th") == F.col("own_th")) & F.col("id").eqNullSafe(F.col("owner")), "left_semi")

    texts = owned(rows).select("th", "text")
    twice = materialise(owned(lines).groupBy("th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("th"), "repeated")
    if not twice.isEmpty():  # rows alike in id and text count once
        twice = broadcast_if_small(twice)
        texts = texts.join(twice, "th", "left_anti").unionByName(texts.join(twice, "th", "left_semi").dropDuplicates(["th"]))
    share = shares(texts, holders.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0], min_texts)
    return share.filter(F.col("n") - F.col("c") >= own_share * F.col("n")).select("th")


def recurring_lines(docs: DataFrame, id_col: str, text_col: str, min_texts: int = MIN_TEXTS, min_share: float = MIN_SHARE, own_share: float = OWN_SHARE) -> DataFrame:
    """(id, th, dropped array<int>): the lines to drop of each document that has any; th is the text's hash.

    All counts are grouped over (leaf or template, text) first, with map-side combine, so a line in every document is
    no hot task and a text counts once, however many copies it has. Only lines in leaves of enough texts are unfolded into templates.
    """
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def make():
        words = Words()

        def step(columns):
            parsed = [p for texts in in_portions(columns[2]) for p in parse(texts, words)]
            return [columns[0], columns[1], *([p[i] for p in parsed] for i in range(4))]

        return step

    def often(df: DataFrame, by: str) -> DataFrame:
        pairs = df.groupBy(by, "th").agg(F.lit(1)).groupBy(by).agg(F.count(F.lit(1)).alias("texts"))
        return materialise(pairs.filter(F.col("texts") >= min_texts), f"often-{by}")

    lines = materialise(map_rows(rows, make, PARSED), "lines")
    leaves = often(lines.select("th", F.explode("leaf").alias("leaf")), "leaf")
    kept = lines.select("id", "th", F.explode(F.arrays_zip("line", "leaf", "keys")).alias("x")).select("id", "th", "x.line", "x.leaf", "x.keys")
    kept = materialise(kept.join(broadcast_if_small(leaves.select("leaf")), "leaf", "left_semi").select("id", "th", "line", "keys"), "kept")
    each = kept.select("id", "th", "line", F.explode("keys").alias("key"))
    candidates = often(each, "key")
    held = materialise(each.join(broadcast_if_small(candidates.select("key")), "key", "left_semi").groupBy("key", "th").agg(F.lit(1)).select("key", "th"), "held")
    holders = lines.join(broadcast_if_small(materialise(held.select("th").distinct(), "held-texts")), "th", "left_semi").groupBy("th").agg(F.min("id").alias("owner"), F.max("words").alias("words"))
    alone = materialise(independent_texts(rows, lines, materialise(holders, "holders"), min_texts, own_share), "independent")
    counted = held.join(broadcast_if_small(alone), "th", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("alone"))
    counted = counted.join(candidates, "key").filter((F.col("alone") >= min_texts) & (F.col("alone") >= min_share * F.col("texts")))
    recurring = materialise(counted.select("key"), "templates")
    found = each.join(broadcast_if_small(recurring), "key", "left_semi")
    return found.groupBy("id", "th").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str | None = None, **limits) -> DataFrame:
    """The documents, all rows and columns, without the lines of recurring templates.

    Null texts stay null; a text all of whose lines go is empty; very long texts are parsed whole. Blank and short lines stay. A column n_chars
    is set to the new length where lines went. ``dropped_col`` adds the numbers (from 0) of the dropped lines. Repeated
    rows are treated alike. An empty table gives an empty result. Other columns pass through, whatever their names.
    """
    before = steps()
    flags = materialise(recurring_lines(docs, id_col, text_col, **limits).select(F.col("id").alias("__gl_id"), F.col("th").alias("__gl_th"), F.col("dropped").alias("__gl_dropped")), "flags")
    forget(docs.sparkSession, steps() - before - {path_of(flags)})  # the result reads only these
    numbers = flags.agg(F.coalesce(F.avg(F.size("__gl_dropped")), F.lit(0.0))).first()[0]
    flags = broadcast_if_small(flags, row_bytes=64 + 4 * numbers)
    text = F.col(text_col)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__gl_id")) & (F.xxhash64(text) == F.col("__gl_th"))
    joined = docs.join(flags, same, "left")
    gone = F.col("__gl_dropped")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    clean = F.when(gone.isNull(), text).otherwise(left)
    columns = [clean.alias(c) if c == text_col else F.when(gone.isNull(), F.col(c)).otherwise(F.char_length(left)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    extra = [F.coalesce(gone, F.array().cast("array<int>")).alias(dropped_col)] if dropped_col else []
    return joined.select(*columns, *extra)


def op10_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = drop_lines(docs, dropped_col="dropped")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return rows.select("doc_id", (lines).alias("n_lines_kept"), F.size("dropped").alias("n_dropped"), "dropped", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"op10_template_tree": op10_template_tree}
SQL: dict[str, str] = {}
