"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Hashed character n-grams of the whole text (lengths 1 to 3), weighted 1 + log tf times an idf counted over
all training documents, to unit length. The weights are trained with follow-the-regularised-leader (proximal)
under an elastic net, which leaves most of them zero; a temperature fitted on a fold of its own calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, id_text, map_rows, materialise, path_of, small_batches, table, text_or_empty
from .folds import fold, lot

#: Hash buckets of the n-grams.
DIM = 1 << 14
#: Documents of each language from which the weights are fitted, about (drawn by id), and the most values of all their vectors
#: (12 bytes each); the order of drawing decides which stay. Counts of n-grams cover all documents.
PER_LANGUAGE, MOST_VALUES = 500, 20_000_000
#: At most so many languages are learned; more are an error, not cut off.
MAX_LANGUAGES = 1000
CALIBRATION_FOLD = 1
UNKNOWN = "und"
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.01
#: A text is of no learned language if its best language leads the next by less than this share of the lead (in logits) that
#: all but the least LOW_LEADS of the rightly told texts of the calibration fold have. No language leads by 0.
LEAD_SHARE, LOW_LEADS = 0.5, 0.01


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the lower-cased text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mix = np.uint32(0x9E3779B1)
    one = c * mix
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * mix
    three = (two[:-1] ^ (c[2:] * np.uint32(0xC2B2AE3D))) * mix
    shift = np.uint32(32 - DIM.bit_length() + 1)
    return np.bincount(np.concatenate([one, two, three]) >> shift, minlength=DIM)


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the TF-IDF vector of unit length."""
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm else values


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of the texts each bucket occurs; the last number counts the texts. Sums of DIM + 1 buckets reach the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[:DIM] += gram_counts(text) > 0
                total[DIM] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(DIM + 1)
    for bucket, n in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


class Softmax:
    """Multinomial logistic regression by FTRL-proximal; the last row of the weights is the bias."""

    def __init__(self, classes: list[str]):
        self.classes = classes
        self.z = np.zeros((DIM + 1, len(classes)))
        self.n = np.zeros((DIM + 1, len(classes)))
        self.temperature = 1.0
        self.least_lead = 0.0

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        rows, x = np.append(at, DIM), np.append(values, 1.0)
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        squared = g * g
        sigma = (np.sqrt(self.n[rows] + squared) - np.sqrt(self.n[rows])) / ALPHA
        self.z[rows] += g - sigma * w
        self.n[rows] += squared

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """The temperature of least log loss, by golden section over its logarithm."""
        if not len(labels):
            return
        loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
        low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))
        told = lead(logits)[logits.argmax(axis=1) == labels]
        self.least_lead = LEAD_SHARE * float(np.quantile(told, LOW_LEADS)) if len(self.classes) > 1 and len(told) else 0.0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def lead(logits: np.ndarray) -> np.ndarray:
    """By how much the best class is ahead of the next; infinite if there is only one."""
    if logits.shape[-1] < 2:
        return np.full(logits.shape[:-1], np.inf)
    top = np.sort(logits, axis=-1)
    return top[..., -1] - top[..., -2]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[Softmax, np.ndarray]:
    """The model and the idf. ``docs``: doc_id, text (not null), lang; only rows outside fold 0 with a lang are used."""
    known = docs.filter(F.col("lang").isNotNull() & (fold() != 0))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    frequencies = document_frequencies(known)
    idf = np.log((1.0 + frequencies[DIM]) / (1.0 + frequencies[:DIM])) + 1.0
    model = Softmax(sorted(counts))
    if not counts:
        return model, idf
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    sample = known.filter(lot("doc_id", "language") < F.element_at(share, F.col("lang")))

    def make():
        def step(columns):
            vectors = [weigh(gram_counts(t), idf) for t in columns[2]]
            return [columns[0], columns[1], [v[0].astype(np.int32) for v in vectors], [v[1].astype(np.float32) for v in vectors], columns[3]]

        return step

    drawn = sample.select(F.xxhash64(id_text(), "text").alias("o"), "lang", fold().alias("fold"), "text")
    vectors = materialise(map_rows(drawn.select("lang", "fold", "text", "o"), make, "lang string, fold int, at array<int>, val array<float>, o long"), "vectors")
    written = path_of(vectors)
    # The driver orders the sample itself, so that equal texts or ids are no hot range of a sort.
    sizes = vectors.select("o", F.size("at").alias("n")).toArrow()
    order = np.argsort(sizes["o"].to_numpy(), kind="stable")
    fits = sizes["n"].to_numpy()[order].cumsum() <= MOST_VALUES
    if not fits.all():
        vectors = vectors.filter(F.col("o") < int(sizes["o"].to_numpy()[order][fits.argmin()]))
    rows = vectors.toArrow()
    forget(docs.sparkSession, {written})
    rows = rows.take(np.lexsort((rows["lang"].to_numpy(zero_copy_only=False).astype(str), rows["o"].to_numpy())))
    at, val = (rows[c].combine_chunks() for c in ("at", "val"))
    starts, buckets, values = at.offsets.to_numpy(), at.values.to_numpy(), val.values.to_numpy()
    vectors = [(buckets[i:j], values[i:j]) for i, j in zip(starts, starts[1:], strict=False)]
    labels = np.array([model.classes.index(x) for x in rows["lang"].to_pylist()], dtype=np.int64)
    held = rows["fold"].to_numpy() == CALIBRATION_FOLD
    for _ in range(EPOCHS):
        for i in np.flatnonzero(~held):
            model.learn(vectors[i][0], vectors[i][1].astype(np.float64), labels[i])
    w = model.weights()
    logits = np.array([v.astype(np.float64) @ w[a] + w[DIM] for a, v in (vectors[i] for i in np.flatnonzero(held))])
    model.calibrate(logits, labels[held])
    return model, idf


def predictor(spark: SparkSession, model: Softmax, idf: np.ndarray):
    """A function that makes, in a task, text (or None) -> (language, score, lead). The weights travel as one broadcast (16,385 x languages)."""
    shared = spark.sparkContext.broadcast((model.classes, model.temperature, idf, model.weights().astype(np.float32)))

    def make():
        classes, t, idf, w = shared.value

        def predict(text: str | None) -> tuple[str, float, float]:
            if not classes or not has_letter(text):
                return UNKNOWN, 0.0, -1.0
            at, values = weigh(gram_counts(text), idf)
            logits = values @ w[at] + w[DIM]
            p = softmax(logits / t)
            best = int(p.argmax())
            return classes[best], float(p[best]), float(lead(logits))

        return predict

    return make


def identify(docs: DataFrame, target: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on ``docs`` and predict the language of every whole text of ``target`` (default: ``docs``).

    Returns doc_id, held_out, lang_pred, score. A null text or one without a letter is ``und`` with score 0, and so
    is every text if nothing could be learned (an empty table, or no labels). Equal texts get equal
    predictions, of equally likely languages the first by name. Other columns are ignored.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.col(lang_col).alias("lang"))
    predictions = predictor(docs.sparkSession, *train(known))

    def make():
        predict = predictions()

        def step(columns):
            out = [predict(t) for t in columns[2]]
            return [columns[0], columns[1], [p[0] for p in out], [p[1] for p in out]]

        return step

    rows = (docs if target is None else target).select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language: with a score of at least ``least``, or without it, one that leads (``LEAD_SHARE``).

    A null or empty text and one without a letter go, and so does every row if no language could be learned (an empty table, or
    no labels). Equal texts stay or go together, repeated rows repeat, texts of any length are read whole, and
    columns pass through unchanged, whatever their names.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model, idf = train(known)
    predictions, least_lead = predictor(docs.sparkSession, model, idf), model.least_lead

    def make():
        predict = predictions()

        def keep(texts: list[str | None]) -> list[bool]:
            found = [predict(t) for t in texts]
            return [p[0] != UNKNOWN and (p[2] >= least_lead if least is None else p[1] >= least) for p in found]

        return keep

    return filter_texts(docs, text_col, make)


def filter_texts(docs: DataFrame, text_col: str, make) -> DataFrame:
    """The rows that a filter accepts, in one Arrow pass over the columns as they are; ``make()`` gives, in a task, texts -> booleans."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            yield batch.filter(pa.array([bool(k) for k in keep(batch.column(place).to_pylist())], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ftrl_language": op7_ftrl_language}
SQL: dict[str, str] = {}
