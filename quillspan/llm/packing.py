"""Packing of token sequences by cutting-stock column generation.

A text longer than a sequence is cut at multiples of the capacity; every other text stays whole. Piece
lengths are counted in classes of ``grain`` tokens, so the histogram has ``capacity / grain`` rows at any
input size. On it a linear program asks for the fewest sequences: its columns are patterns (how many
pieces of each class one sequence holds), and a knapsack dynamic program over the current prices finds
the pattern that pays best until none does. The solution is rounded down, what is left over is packed
first-fit by decreasing class, and the pieces, ranked within their class, are dealt to the patterns'
places. Only the histogram and the patterns are on the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.shared import small_batches, texts, written
from quillspan.llm.tokens import word_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every text and the checksum of each piece's ids; a null text is empty and still has its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = word_ids(tokenizer).ids, np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for part, found in texts(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), found, strict=True):
                    ids = encode(text) + end
                    rows += [(doc_id, at // 4, len(x) // 4, zlib.crc32(x), len(ids) // 4) for at in range(0, len(ids), width) for x in (ids[at : at + width],)]
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, PIECES)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: counts of each class that fit into ``room`` at the highest total price."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes)
    w, y = sizes[order], prices[order]
    fits = np.searchsorted(w, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - w[:k]] + y[:k]
            if gain[i := int(gain.argmax())] > best[c] + 1e-12:
                best[c], took[c] = gain[i], i
    counts, c = np.zeros(len(sizes), int), room
    while c > 0:
        if (i := took[c]) < 0:
            c -= 1
        else:
            counts[order[i]] += 1
            c -= w[i]
    return float(best[room]), counts


def cutting_patterns(demand: dict[int, int], room: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, covering ``demand`` (pieces by class size) exactly.

    Any number of rounds gives a valid packing; the linear program's optimum ends them earlier.
    """
    sizes = np.asarray(sorted(demand), int)
    if not len(sizes):
        return []
    d = np.asarray([demand[int(s)] for s in sizes], float)
    shaken = d + 1e-6 * np.random.default_rng(5).random(len(d))  # against cycling on ties
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(prices, sizes, room)
        if worth <= 1 + 1e-7:
            break
        step, now = inverse @ pattern, inverse @ shaken
        ratio = np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = pattern
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    used = np.maximum(0, np.floor(np.linalg.solve(columns, d) + 1e-6)).astype(int)
    left = d.astype(int) - columns.astype(int) @ used
    while (left < 0).any():  # rounding noise made too many of a class: give up a pattern that holds it
        p = int(np.flatnonzero((columns[int(np.flatnonzero(left < 0)[0])] > 0) & (used > 0))[0])
        used[p] -= 1
        left += columns[:, p].astype(int)
    out = Counter({tuple((int(s), int(n)) for s, n in zip(sizes, columns[:, p].astype(int), strict=True) if n): int(u) for p, u in enumerate(used) if u})
    while left.any():  # first fit by decreasing class, a sequence at a time
        free, taken = room, np.zeros(len(sizes), int)
        for i in range(len(sizes) - 1, -1, -1):
            taken[i] = min(left[i], free // sizes[i])
            free -= taken[i] * sizes[i]
        times = int(min(left[i] // taken[i] for i in np.flatnonzero(taken)))
        left -= times * taken
        out[tuple((int(s), int(n)) for s, n in zip(sizes, taken, strict=True) if n)] += times
    return [(dict(k), n) for k, n in out.items()]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, grain: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, a row for each piece.

    Every id of every text, and the end id after it, is in exactly one piece; a sequence holds at most
    ``capacity`` ids and its pieces lie end to end from 0. Sequences are numbered from 0 without gaps.
    Null and empty texts are a piece of one id. Repeated rows are packed each for itself. Null ids stay
    null. Other columns are ignored; an empty table gives no rows.
    """
    if capacity % grain:
        raise ValueError("grain must divide capacity")
    spark = docs.sparkSession
    pieces = written(tokenized_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    size = F.ceil(F.col("length") / grain).cast("int")
    demand = {r[0]: r[1] for r in pieces.groupBy(size.alias("size")).count().collect()}  # capacity / grain rows at most

    places, base, so_far = [], 0, Counter()
    for pattern, times in cutting_patterns(demand, capacity // grain):
        for s, n in pattern.items():
            places.append((s, so_far[s], so_far[s] + n * times, n, base))
            so_far[s] += n * times
        base += times
    places = spark.createDataFrame(places, "size int, lo long, hi long, per int, base long")

    # A class is ranked in parts of about equal size, so that no class meets in one task.
    share = max(64, sum(demand.values()) // (16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.array(*(F.lit(-(-demand.get(s, 1) // share)) for s in range(capacity // grain + 1)))
    keyed = pieces.withColumn("size", size)
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), parts[F.col("size")]))
    upto = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("size", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("size", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = keyed.withColumn("inside", inside).join(before, ["size", "part"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    dealt = ranked.join(F.broadcast(places), (ranked["size"] == places["size"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    dealt = dealt.drop(places["size"]).withColumn("sequence_id", F.expr("base + (rank - lo) div per"))
    line = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(line), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
