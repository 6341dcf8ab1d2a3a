"""Bounded samples of labelled rows, and folds by crc32 of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)).cast("int")


def dealt(id_col: str, seed: int) -> Column:
    """An order that has nothing to do with the id's size; ties by the id."""
    return F.struct(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.col(id_col))


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One 0/1 label per id; repeated ids take the larger label, null ids and labels are left out."""
    return labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))


def first_rows(ids: DataFrame, seed: int, most: int) -> DataFrame:
    """At most ``most`` rows of ``(id, ...)`` in dealt order: the documented bound of a training sample."""
    return ids.orderBy(dealt("id", seed)).limit(most)
