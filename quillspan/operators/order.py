"""Order-dependent steps: occurrence numbers, repeated listing pages, report order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrence_index(df: DataFrame, keys: list[str], order: list[str], out: str = "occurrence") -> DataFrame:
    """How often the same keys were seen before, from 0; ``order`` should be total."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def cut_repeated_pages(listing: DataFrame, walk: list[str], page: str, keys: list[str]) -> DataFrame:
    """Without the pages, of each walk, from the first on whose set of keys equals the page's before it."""
    sets = listing.groupBy(*walk, page).agg(F.array_sort(F.collect_set(F.struct(*keys))).alias("_set"))
    line = Window.partitionBy(*walk).orderBy(page)
    again = F.coalesce((F.col("_set") == F.lag("_set").over(line)).cast("int"), F.lit(0))
    cut = sets.withColumn("_again", again).withColumn("_cut", F.max("_again").over(line)).where("_cut = 0").select(*walk, page)
    return listing.join(cut, [*walk, page], "left_semi")


def report_order(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted by the keys and then by all other sortable columns, so ties have an order."""
    rest = [c for c, kind in df.dtypes if c not in keys and not kind.startswith("map")]
    return df.orderBy(*keys, *rest)
