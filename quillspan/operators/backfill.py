"""Filling in an attribute from a key's other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def representative(df: DataFrame, key: str, value: str, order: list[str], unknown: str = "unknown") -> DataFrame:
    """The known value of each key that comes first in ``order``; blanks, ``-`` and the unknown word are not known."""
    known = df.where(~F.trim(F.coalesce(F.col(value), F.lit(""))).isin("", "-", unknown) & (F.coalesce(F.col(key).cast("string"), F.lit("")) != ""))
    return known.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("_known"))


def backfill(df: DataFrame, key: str, value: str, order: list[str], unknown: str = "unknown", source: DataFrame | None = None) -> DataFrame:
    """The representative value on all rows of its key, from ``source`` or the table itself; the rest blank values unknown.

    Rows with a blank key stay out of the join, so they cannot pile up in one task.
    """
    found = representative(source if source is not None else df, key, value, order, unknown)
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    own = F.when(F.trim(F.coalesce(F.col(value), F.lit(""))).isin("", "-"), unknown).otherwise(F.col(value))
    filled = df.where(~blank).join(found, key, "left").withColumn(value, F.coalesce(F.col("_known"), own)).select(*df.columns)
    return filled.unionByName(df.where(blank).withColumn(value, own))
