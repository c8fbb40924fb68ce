"""A corpus pipeline of five stages: language ID, quality, line dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet
in the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import language_id, line_dedup, packing, quality, simhash
from graphloom.llm.common import forget, materialise, path_of, steps, table

#: A document goes if its quality is scored below this, as in op9.
LEAST_QUALITY = quality.THRESHOLD


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("line_dedup", drop_recurring_lines),
    ("simhash", drop_near_copies),
    ("packing", pack_sequences),
]
#: Learned models and 64-bit hashes have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way, and its input, is deleted once its rows are written."""
    rows, before = table(spark, sf_dir, "documents"), steps()
    for name, stage in STAGES:
        rows = materialise(stage(spark, rows, sf_dir), f"stage-{name}")
        forget(spark, steps() - before - {path_of(rows)})
    return rows
