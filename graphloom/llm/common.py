"""Helpers that the training-data operators share: reading, materialising, Arrow limits, gapless numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python. Texts may be long, so few rows travel at once.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: The most bytes of a table that is marked for broadcast.
BROADCAST_BYTES = 32 << 20
#: Written steps of this session, by path.
STEPS: dict[str, DataFrame] = {}
#: Salts of ``gapless_number``: two hex digits of an MD5, alike in every SQL dialect.
SALTS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, as whole texts pass through them; the same bounds for every operator."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage (a lost executor never recomputes what lies before), computes Python steps
    once, and gives the planner the true size, by which it chooses between broadcast and shuffle. What is
    returned lazily reads these tables; ``forget`` deletes them when they are no longer needed.
    """
    path = f"{shared_dir(df.sparkSession)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    STEPS[path] = found
    return found


def steps() -> set[str]:
    """The written steps that are not deleted yet."""
    return set(STEPS)


def forget(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete written steps that nothing reads any more."""
    for path in list(paths):
        if STEPS.pop(path, None) is not None:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def path_of(df: DataFrame) -> str:
    """Where ``materialise`` wrote ``df``."""
    return next(p for p, d in STEPS.items() if d is df)


def broadcast_if_small(df: DataFrame, row_bytes: float | None = None) -> DataFrame:
    """``df`` (materialised) marked for broadcast if its rows take at most BROADCAST_BYTES; else the planner joins by shuffle.

    ``row_bytes``: what a row takes, by default 24 and 8 for each column (of numbers).
    """
    width = row_bytes or 24 + 8 * len(df.columns)
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_text(name: str = "doc_id") -> Column:
    """A document's id as text; null becomes the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def md5_salt(*parts: Column) -> Column:
    """A salt of a row, from enough of its columns that equal ids alone do not meet."""
    return F.substring(F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 2)


def gapless_number(df: DataFrame, group: str, salt: str, order: Sequence[Column | str], to: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, with no group in one task.

    Rows are ordered by (salt, *order). A window ranks each (group, salt) part; the parts' sizes, at most
    groups x SALTS rows, give each part's first number. ``df`` must be cheap to read twice.
    """
    sizes = df.groupBy(group, salt).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(group, salt, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group, salt).orderBy(*order)))
    joined = ranked.join(F.broadcast(first), [group, salt])  # bounded: groups x SALTS rows
    return joined.withColumn(to, (F.col("_first") + F.col("_rank") - 1).cast("long")).drop("_first", "_rank")


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: str) -> DataFrame:
    """Arrow map over whole rows: ``make()`` runs once a task and returns a function from columns to columns.

    Each result must have one value for each row it returns; results may have more or fewer rows.
    """
    small_batches(df.sparkSession)
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step([column.to_pylist() for column in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def to_arrow(spark_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)
