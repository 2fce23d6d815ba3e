"""What several corpus operators share: the folder all executors see, and byte-wise text access."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources.scratch import drop_written, new_place, release_shuffles, written, written_so_far

__all__ = ["drop_written", "new_place", "release_shuffles", "written", "written_so_far"]

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 256


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded in rows and bytes where they are at Spark's defaults: texts may be long."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower() in ("67108864b", "67108864", "64m", "64mb"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return df


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows; for tables of a few numbers a row that are cheap to count. Larger ones are shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed_bits(*cols: Column, seed: int = 0) -> Column:
    """A seeded 64-bit hash of some columns; nulls keep their place."""
    return F.xxhash64(F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("\0")) for c in cols))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts as UTF-8 bytes; a null text is empty."""
    for at in range(0, batch.num_rows, SLICE):
        part = batch.slice(at, SLICE)
        col = part.column(column)
        if pa.types.is_string(col.type):
            col = col.cast(pa.binary())
        elif pa.types.is_large_string(col.type):
            col = col.cast(pa.large_binary())
        yield part, [x or b"" for x in col.to_pylist()]


#: Runs of anything but the six ASCII white-space characters; ``bytes.split()`` cuts at the same six.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
