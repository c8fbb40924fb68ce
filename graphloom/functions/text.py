"""Text measures as column expressions, dynamic programmes and alignments among them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
#: A quoted literal of either kind, with escapes.
QUOTED = r"""'(?:\\'|[^'])*'|"(?:\\"|[^"])*\""""


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_answer(text: Column) -> Column:
    """Lower case, punctuation to spaces, articles dropped, single spaces."""
    words = F.split(squeeze(F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION))), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*ARTICLES) & (w != "")), " ")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams in order; none for shorter lists."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def count_of(grams: Column, gram: Column) -> Column:
    return F.size(F.filter(grams, lambda g: g == gram))


def clipped_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, g: s + F.least(count_of(a, g), count_of(b, g)))


def edge_cases(a: Column, b: Column, value: Column) -> Column:
    """Two empty lists score 1, one empty list 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(value)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def rouge_n(predicted: Column, reference: Column, n: int) -> Column:
    """struct(precision, recall, f1) over n-gram multisets."""
    a, b = ngrams(predicted, n), ngrams(reference, n)
    overlap = clipped_overlap(a, b).cast("double")
    p, r = overlap / F.size(a), overlap / F.size(b)
    return F.struct(edge_cases(a, b, p).alias("precision"), edge_cases(a, b, r).alias("recall"), edge_cases(a, b, f1(p, r)).alias("f1"))


def bleu(predicted: Column, reference: Column, order: int = 4) -> Column:
    """Sentence BLEU: +1 smoothed precisions up to the effective order, brevity penalty; 0 without a shared word."""
    logs = []
    for n in range(1, order + 1):
        a, b = ngrams(predicted, n), ngrams(reference, n)
        logs.append(F.when(F.size(predicted) >= n, F.log((clipped_overlap(a, b) + 1) / (F.size(a) + 1))))
    used = F.least(F.lit(order), F.size(predicted))
    total = reduce(lambda x, y: x + y, [F.coalesce(x, F.lit(0.0)) for x in logs])
    brevity = F.when(F.size(predicted) < F.size(reference), F.exp(1 - F.size(reference) / F.size(predicted))).otherwise(1.0)
    shared = F.size(F.array_intersect(predicted, reference)) > 0
    return edge_cases(predicted, reference, F.when(shared, brevity * F.exp(total / used)).otherwise(0.0))


def gleu(predicted: Column, reference: Column, order: int = 4) -> Column:
    """The lesser of n-gram precision and recall, over all orders together."""
    pairs = [(ngrams(predicted, n), ngrams(reference, n)) for n in range(1, order + 1)]
    matches = reduce(lambda x, y: x + y, [clipped_overlap(a, b) for a, b in pairs])
    ta, tb = (reduce(lambda x, y: x + y, [F.size(p[i]) for p in pairs]) for i in (0, 1))
    return F.when((ta == 0) | (tb == 0), 0.0).otherwise(F.least(matches / ta, matches / tb))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of token counts."""
    norm = lambda x: F.sqrt(F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, t: s + count_of(x, t) * count_of(x, t)))
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, t: s + count_of(a, t) * count_of(b, t))
    return edge_cases(a, b, dot / (norm(a) * norm(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def query_signature(text: Column) -> Column:
    """Literals and numbers masked, node variables and property owners too, lower case, single spaces."""
    masked = F.regexp_replace(text, QUOTED, "<str>")
    masked = F.regexp_replace(masked, r"\b\d+(?:\.\d+)?\b", "<num>")
    masked = F.regexp_replace(masked, r"\(([A-Za-z_][A-Za-z0-9_]*)\s*:", "(<var>:")
    masked = F.regexp_replace(masked, r"\b[A-Za-z_][A-Za-z0-9_]*(?=\.)", "<var>")
    return squeeze(F.lower(masked))


def template_family(kind: Column, template: Column, cypher: Column) -> Column:
    """``schema:kind``, else the masked template, else the query's signature."""
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(template), r"\{[^}]+\}", "{slot}"), r"'[^']*'", "'<value>'"), r"\b\d+(?:\.\d+)?\b", "<number>")
    surface = F.array_join(tokenize(masked), " ")
    return F.coalesce(F.concat(F.lit("schema:"), F.nullif(kind, F.lit(""))), F.concat(F.lit("template:"), F.when(template != "", surface)), F.concat(F.lit("query:"), query_signature(cypher)))


def bucket(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "0").when(n >= 3, "3+").otherwise(n.cast("int").cast("string"))


def question_key(text: Column) -> Column:
    """A question for duplicate tests: lower case, single spaces, no closing marks."""
    return F.regexp_replace(squeeze(F.lower(text)), r"[?.!\s]+$", "")


def json_text(value: Column) -> Column:
    """A text as a JSON string in ASCII, other characters as lower-case escapes (surrogate pairs beyond the plane); null is the empty text."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    escape = lambda code: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code.cast("long")), 4, "0")))

    def letter(c: Column) -> Column:
        code = F.ascii(c)
        wide = code - 0x10000
        short = F.when(c == '"', F.lit('\\"')).when(c == "\\", F.lit("\\\\"))
        for raw, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
            short = short.when(c == raw, F.lit("\\" + name))
        pair = F.concat(escape(F.lit(0xD800) + F.shiftright(wide, 10)), escape(F.lit(0xDC00) + wide.bitwiseAND(0x3FF)))
        return short.when(code > 0xFFFF, pair).when((code > 126) | (code < 32), escape(code)).otherwise(c)

    letters = F.filter(F.split(value, ""), lambda c: c != "")
    return F.concat(F.lit('"'), F.when(value.rlike(r"^[ !#-\[\]-~]*$"), value).otherwise(F.array_join(F.transform(letters, letter), "")), F.lit('"'))


#: Fixed value: what ids of exported items begin with.
ID_PREFIX = "pc_"


def content_id(fields: Mapping[str, Column], prefix: str = ID_PREFIX) -> Column:
    """The prefix and 16 digits of the sha256 of the fields as JSON with sorted keys."""
    parts = [F.concat(F.lit(f'"{k}": '), json_text(v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 16))


def clean_query(text: Column) -> Column:
    """A model's answer to plain query text: no end markers, fences or prefixes, up to the first semicolon, single spaces."""
    out = F.regexp_replace(text, r"(?s)<\|.*?\|>|</s>", "")
    fenced = F.regexp_extract(out, r"(?s)```(?:[A-Za-z]*\s*\n)?(.*?)```", 1)
    out = F.when(fenced != "", fenced).otherwise(F.regexp_replace(out, "```", ""))
    out = F.regexp_replace(out, r"(?is)^\s*(?:cypher\s*(?:query)?\s*:|query\s*:|answer\s*:)", "")
    return squeeze(F.split(out, ";", 2)[0])


#: Tokens to a word of bits: sums of two words and a carry fit into a long.
BITS = 60


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, a row of the table at a time.

    A row is a list of words of bits, one bit a place of ``b``: 0 where the row's value grows there. A token x turns row v into
    (v + u) | (v & ~u), where u is v at the places of x; carries go from word to word. The zeros at the end are the length.
    """
    full = F.lit((1 << BITS) - 1)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(b) - 1) / BITS).cast("int"), F.lit(0))), lambda k: F.slice(b, k * BITS + 1, BITS))

    def places(chunk: Column, x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(chunk)), F.lit(0).cast("long"), lambda bits, j: F.when(F.element_at(chunk, j) == x, bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j - 1))).otherwise(bits))

    def add(state: Column, e: Column) -> Column:
        total = e["v"] + e["u"] + state["carry"]
        return F.struct(F.call_function("shiftright", total, F.lit(BITS)).alias("carry"), F.concat(state["words"], F.array(total.bitwiseAND(full).bitwiseOR(e["v"].bitwiseAND(F.bitwise_not(e["u"]))))).alias("words"))

    def row(v: Column, x: Column) -> Column:
        used = F.zip_with(v, F.transform(chunks, lambda c: places(c, x)), lambda w, m: F.struct(w.alias("v"), w.bitwiseAND(m).alias("u")))
        start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("words"))
        return F.aggregate(used, start, add, lambda state: state["words"])

    last = F.aggregate(a, F.transform(chunks, lambda _: full), row)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.aggregate(last, F.lit(0), lambda n, w: n + (BITS - F.bit_count(w))))


def rouge_l_f1(a: Column, b: Column) -> Column:
    return edge_cases(a, b, 2 * longest_common(a, b) / (F.size(a) + F.size(b)))


def meteor(a: Column, b: Column) -> Column:
    """Greedy exact alignment (the k-th use of a word meets its k-th use), Fmean 10PR / (R + 9P), penalty 0.5 (chunks / matches)^3."""

    def partner(x: Column, i: Column) -> Column:
        """The place in ``b`` of the use that the i-th token (from 0) meets, or -1."""
        places = F.filter(F.sequence(F.lit(1), F.size(b)), lambda j: F.element_at(b, j) == x)
        return F.coalesce(F.get(places, F.size(F.filter(F.slice(a, F.lit(1), i), lambda y: y == x))), F.lit(-1))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("chunks"), F.lit(0).alias("m"))
    step = lambda s, j: F.when(j < 0, F.struct(j.alias("last"), s["chunks"].alias("chunks"), s["m"].alias("m"))).otherwise(F.struct(j.alias("last"), (s["chunks"] + F.when((s["last"] > 0) & (j == s["last"] + 1), 0).otherwise(1)).alias("chunks"), (s["m"] + 1).alias("m")))

    def score(s: Column) -> Column:
        p, r = s["m"] / F.size(a), s["m"] / F.size(b)
        return F.when(s["m"] == 0, 0.0).otherwise((1 - 0.5 * F.pow(s["chunks"] / s["m"], 3)) * 10 * p * r / (r + 9 * p))

    return edge_cases(a, b, F.aggregate(F.transform(a, partner), start, step, score))


def jaro_winkler(a: Column, b: Column, scale: float = 0.1) -> Column:
    """Jaro similarity and the prefix bonus at any similarity (no 0.7 threshold)."""
    la, lb = F.char_length(a), F.char_length(b)
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))

    def match(taken: Column, i: Column) -> Column:
        """Adds (place in b, letter) of the first place in reach that has the letter and is free."""
        low, high, x = F.greatest(i - reach, F.lit(1)), F.least(i + reach, lb), a.substr(i, F.lit(1))
        places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        free = F.filter(places, lambda j: (b.substr(j, F.lit(1)) == x) & ~F.exists(taken, lambda t: t["j"] == j))
        return F.concat(taken, F.transform(F.slice(free, 1, 1), lambda j: F.struct(j.alias("j"), x.alias("x"))))

    def score(pairs: Column) -> Column:
        m = F.size(pairs)
        swaps = F.size(F.filter(F.zip_with(pairs, F.array_sort(pairs), lambda p, q: p["x"] != q["x"]), lambda differs: differs)) / 2
        jaro = (m / la + m / lb + (m - swaps) / m) / 3
        prefix = reduce(lambda n, k: n + F.when((la >= k) & (lb >= k) & (a.substr(1, k) == b.substr(1, k)), 1).otherwise(0), range(1, 5), F.lit(0))
        return F.when(m == 0, 0.0).otherwise(jaro + prefix * scale * (1 - jaro))

    found = F.aggregate(F.sequence(F.lit(1), la), F.array().cast("array<struct<j:int,x:string>>"), match, score)
    return F.when(a == b, 1.0).when((la == 0) | (lb == 0), 0.0).when(a.isNotNull() & b.isNotNull(), found)


def expected_distinct(distinct: Column, total: Column, vocabulary: Column) -> Column:
    """Distinct tokens over those expected of as many uniform draws."""
    return distinct / (vocabulary * (1 - F.pow((vocabulary - 1) / vocabulary, total)))


def self_bleu(texts: list[list[str]], order: int = 2, most: int = 200) -> float:
    """Mean BLEU of each text against all others, over the first ``most`` texts in order of their words."""
    texts = sorted((t for t in texts if t), key=" ".join)[:most]
    if len(texts) < 2:
        return 0.0
    counts = [[Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for n in range(1, order + 1)] for t in texts]
    scores = []
    for i, text in enumerate(texts):
        logs = []
        for n in range(min(order, len(text))):
            most: Counter = Counter()
            for j, other in enumerate(counts):
                if j != i:
                    most |= other[n]
            mine = counts[i][n]
            overlap, total = sum(min(c, most[g]) for g, c in mine.items()), sum(mine.values())
            if n == 0 and not overlap:
                logs = []
                break
            logs.append(math.log((overlap + 1) / (total + 1)))
        closest = min((abs(len(o) - len(text)), len(o)) for j, o in enumerate(texts) if j != i)[1]
        penalty = 1.0 if len(text) >= closest else math.exp(1 - closest / max(len(text), 1))
        scores.append(penalty * math.exp(sum(logs) / len(logs)) if logs else 0.0)
    return sum(scores) / len(scores)


def diversity_index(components: Column) -> Column:
    """Geometric mean of an array's components clamped to [0, 1] (1e-6 at least); NaN and null don't count, of none it is 0."""
    clean = F.transform(F.filter(components, lambda c: c.isNotNull() & ~F.isnan(c)), lambda c: F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-6), c))))
    return F.when(F.size(clean) == 0, 0.0).otherwise(F.exp(F.aggregate(clean, F.lit(0.0), lambda s, x: s + x) / F.size(clean)))
