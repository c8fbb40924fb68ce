"""The README's figures on held-out rows: ``python -m graphloom.llm.held_out FOLDER`` prints them for a folder of tables.

Languages and quality labels of fold 0, the junk that the quality stage keeps at several thresholds, the prior's
estimate, and how many planted pairs of a given similarity the near-copy stage finds in corpora of three sizes.
"""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality, simhash
from .common import table

THRESHOLDS = (0.1, 0.2, 0.3, 0.5)
#: Half the words of a planted pair: similarities 0.8, 0.85 and 0.9.
HALVES = (19, 28, 44)
SIZES = (5_000, 20_000, 80_000)
PAIRS = 500


def language_accuracy(docs: DataFrame) -> dict:
    rows = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL")
    n, right = rows.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    return {"documents": n, "right": right}


def quality_at_thresholds(docs: DataFrame, labels: DataFrame) -> dict:
    scored = quality.score_quality(docs, labels).filter("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    counts = [F.count_if(F.col("quality") == q).alias(f"all_{q}") for q in (0, 1)]
    counts += [F.count_if((F.col("quality") == q) & (F.col("score") >= t)).alias(f"kept_{q}_at_{t}") for t in THRESHOLDS for q in (0, 1)]
    row = scored.agg(*counts).first()
    return {"bad": row["all_0"], "good": row["all_1"]} | {f"at {t}": {"bad kept": row[f"kept_0_at_{t}"], "good lost": row["all_1"] - row[f"kept_1_at_{t}"]} for t in THRESHOLDS}


def planted_pairs(spark: SparkSession, size: int, half: int) -> DataFrame:
    """``size`` documents of random words; 2 x PAIRS of them are pairs that differ in one word in the middle."""
    random = np.random.default_rng(size + half)
    rows = []
    for p in range(PAIRS):
        words = [f"p{p}w{i}" for i in range(2 * half + 11)]
        other = [w if i != half + 5 else "changed" for i, w in enumerate(words)]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
    words = np.array([f"w{i}" for i in range(3000)])
    rows += [(i, " ".join(words[random.integers(0, 3000, 60)])) for i in range(2 * PAIRS, size)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def recall(spark: SparkSession) -> dict:
    """Of planted pairs the share found, by similarity and corpus size."""
    out: dict = {}
    for half in HALVES:
        n = 2 * half + 7  # shingles of each of the two texts, five of which differ
        similarity = round((n - 5) / (n + 5), 3)
        for size in SIZES:
            found = simhash.similar_components(planted_pairs(spark, size, half)).filter(f"doc_id < {2 * PAIRS} AND doc_id % 2 = 1 AND component_id = doc_id - 1").count()
            out.setdefault(str(similarity), {})[str(size)] = found / PAIRS
    return out


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    print(json.dumps({"language": language_accuracy(docs), "quality": quality_at_thresholds(docs, labels), "recall": recall(spark)}, indent=1))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
