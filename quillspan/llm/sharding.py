"""Sharding by proportional stratified interleaving, in DataFrame operations only.

The rows of each stratum are put in a seeded random order and get the fractional rank
``(rank - u) / n``, where ``n`` is the stratum's row count and ``u`` in (0, 1) is drawn from the
stratum's name. All rows are then sorted by that fraction and the sorted line is cut into equal runs,
so a shard takes the same share of every stratum, to within a row.

Ranks are exact at any size and no stratum meets in one task: a stratum is dealt out by the high bits of
the shuffle hash, the buckets' counts are summed up to offsets, and ``row_number`` runs inside a bucket.
The same two levels give the global position from the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.shared import mixed_bits, written


def _bucket_bits(df: DataFrame) -> int:
    """Eight buckets for each shuffle partition, 256 at least."""
    return max(8, (8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def interleave(docs: DataFrame, shards: int = 8, strata: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bits: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, stratum, position, shard, slot``.

    ``position`` numbers all rows from 0; shard ``k`` holds the positions from ``ceil(k * n / shards)``,
    so row counts differ by one at most and ``slot`` has no gaps. The size is the text's UTF-8 bytes
    plus 1. Null texts count as empty, a null stratum is a stratum of its own, rows without an id are
    hashed by their text. Rows that repeat in full are separate rows and take neighbouring places. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    bits = bits or _bucket_bits(docs)
    no_id = F.when(F.col(id_col).isNull(), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    h = mixed_bits(F.col(id_col), F.col(strata), no_id, seed=seed)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(strata).alias("stratum"),
        F.coalesce(F.concat(F.lit("="), F.col(strata).cast("string")), F.lit("")).alias("_s"),
        h.alias("_h"),
        F.shiftrightunsigned(h, 64 - bits).alias("_b"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    counts = keyed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_s",
        "_b",
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_s")).alias("_of"),
    )
    inside = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "text_crc32", "size"))
    u = (F.pmod(mixed_bits(F.col("_s"), seed=seed + 1), F.lit(1 << 20)) + F.lit(0.5)) / F.lit(float(1 << 20))
    ranked = keyed.withColumn("_r", inside).join(offsets, ["_s", "_b"])
    ranked = ranked.select("doc_id", "stratum", "size", "text_crc32", "_h", ((F.col("_before") + F.col("_r") - u) / F.col("_of")).alias("_f"))
    line = written(ranked.withColumn("_p", F.floor(F.col("_f") * (1 << bits))), "interleave")

    runs = line.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # 2**bits rows at most
    starts = runs.select(
        "_p",
        F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    at = F.row_number().over(Window.partitionBy("_p").orderBy("_f", "_h", "doc_id", "text_crc32", "size"))
    placed = line.withColumn("_at", at).join(starts, "_p").withColumn("position", F.col("_start") + F.col("_at") - 1)
    shard = F.expr(f"cast(position * {shards} div _all as int)")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "stratum", "position", "shard", (F.col("position") - first).alias("slot"))
