"""Groups of rows that are linked, directly or over others: connected components of an edge table.

By alternating large and small stars. Every round is two aggregations and two joins over the edges; no group of
neighbours is gathered, and each round's edges are written to the shared folder. The smallest neighbours are
written as well, so the join with a hub's many edges has a plain shuffle on both sides and Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.sources.scratch import drop_written, written, written_so_far


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, root`` for each end of an edge ``a, b``: the root is the smallest node that can be reached.

    Loops and repeated edges don't matter, edges with a null end are ignored; no edges give no rows.
    """
    mark = written_so_far()
    ends = edges.where("a is not null and b is not null and a <> b")
    now = written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("a"), F.col("b"), "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop_written(edges.sparkSession, mark, keep=(now,))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def group_sizes(nodes: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """``nodes`` (``node`` and a ``weight`` each) with ``root`` and ``size``: the group's smallest node and the sum of its weights.

    A node without edges is a group by itself. Sizes are summed before they are joined back, so a large group
    is never gathered.
    """
    own = nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = written(own, "rooted")
    sizes = written(own.groupBy("root").agg(F.sum(weight).cast("long").alias("size")), "sizes")
    return own.join(sizes, "root").select(*nodes.columns, "root", "size")
