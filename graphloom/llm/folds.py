"""The folds that learned operators share: a document's fold is the crc32 of its id as text, modulo 5; fold 0 is held out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import id_text

FOLDS = 5


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(id_text(id_col).cast("binary")), F.lit(FOLDS)).cast("int")


def lot(id_col: str, label: str) -> Column:
    """A number in [0, 1) by the id, for samples that depend on nothing else."""
    return F.crc32(F.concat(F.lit(label), id_text(id_col)).cast("binary")) / F.lit(float(1 << 32))
