"""Ranked lexical search by MaxScore with pair bounds.

A document's score for an item sums, over the item's terms, an integer impact of term frequency and length. The
index holds, for blocks of documents, the postings of every term that an item asks for, and for pairs of an item's
terms the intersection list: the documents that hold both, with their joint impact and its maximum. It is written
to the shared folder before any query runs, and gives two things at query time:

* A floor for each item: a document scores at least its joint impact in any list, so the 50th best joint impact of
  a list, over all blocks, can't be beaten by the item's 50th best score from below.
* A tighter ceiling: what a document can still get from two terms is at most the largest of their joint maximum and
  the two maxima of the terms alone, instead of the sum of the two. Terms are added up from the weakest; those
  whose combined bound stays under the floor are not essential, and only documents on the lists of the others are
  scored. While the weaker terms are added, documents drop out as soon as the combined bound of the rest can't
  lift them over the floor.

All comparisons are on exact integers and a document is dropped only strictly under the floor, so ties, and with
them the whole ranking, are those of scoring every document. Items are a stated query set: they are handed to the
tasks in groups of at most ``group_terms`` terms, each group searching all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.shared import small_batches, texts, written

#: Every ASCII byte that is no letter or digit parts terms; capitals become small; all other bytes stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: The same as a pattern for Spark's functions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a block.
BLOCK = 4096


def terms_of(text: bytes) -> list[bytes]:
    """The terms of UTF-8 bytes in order, with repeats."""
    return text.translate(_TERM_BYTES).split()


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, total: int, all_terms: int) -> np.ndarray:
    """Integer impacts of postings, elementwise."""
    m = 50 + 50 * length * total // max(1, all_terms)
    return weights * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, length, terms, tfs`` of every document that has a term at all: how often it holds each asked one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in texts(batch, "text"):
                ids, length, terms, tfs = part.column("doc_id").to_pylist(), [], [], []
                for text in found:
                    own = terms_of(text)
                    t, n = np.unique(np.asarray([vocabulary[w] for w in own if w in vocabulary], np.int32), return_counts=True)
                    length.append(len(own))
                    terms.append(t)
                    tfs.append(n.astype(np.int32))
                kept = [i for i, n in enumerate(length) if n]
                lists = [pa.array([x[i] for i in kept], pa.list_(pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in kept], pa.int64()), pa.array([length[i] for i in kept], pa.int64()), *lists], ["doc_id", "length", "terms", "tfs"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(own).mapInArrow(run, "doc_id long, length long, terms array<int>, tfs array<int>")


def chosen_pairs(terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of an item's terms in the order in which bounds are added up: neighbours by weight, from the heaviest."""
    own = terms[np.lexsort((terms, -weights[terms]))]
    return [(min(a, b), max(a, b)) for a, b in zip(own[::2].tolist(), own[1::2].tolist(), strict=False)]


class Block:
    """The postings and intersection lists of some documents, as read from the index."""

    def __init__(self, ids: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray]], joint: dict[tuple[int, int], int]):
        self.ids, self.postings, self.joint = ids, postings, joint
        self.most = {t: int(v.max()) for t, (_, v) in postings.items()}

    def bound(self, pair: tuple[int, ...]) -> int:
        """What a document of the block can get from one or two terms at most."""
        alone = [self.most.get(t, 0) for t in pair]
        return max(*alone, self.joint.get(pair, 0)) if len(pair) == 2 else alone[0]

    def best(self, units: list[tuple[int, ...]], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (positions) and scores of this block that are among the ``k`` best of it and score ``floor`` or more, above 0."""
        floor = max(floor, 1)
        units = sorted(((self.bound(u), u) for u in units if any(t in self.postings for t in u)), key=lambda x: x[0])
        rest = np.cumsum([b for b, _ in units])  # what the first units can give together
        if not len(rest) or rest[-1] < floor:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = int(np.searchsorted(rest, floor))  # the units before can't reach the floor by themselves
        score, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        for _, unit in units[first:]:
            for t in unit:
                if t in self.postings:
                    at, value = self.postings[t]
                    score[at] += value
                    seen[at] = True
        some = np.flatnonzero(seen)
        for i in range(first - 1, -1, -1):
            some = some[score[some] + rest[i] >= floor]
            if not len(some):
                return some, some
            for t in units[i][1]:
                if t in self.postings:
                    at, value = self.postings[t]
                    place = np.minimum(np.searchsorted(at, some), len(at) - 1)
                    hit = at[place] == some
                    score[some[hit]] += value[place[hit]]
        some = some[score[some] >= floor]
        if len(some) > k:
            least = np.partition(score[some], len(some) - k)[len(some) - k]
            some = some[score[some] >= least]  # ties with the last are kept; the ranking settles them
        return some, score[some]


def _block_rows(vectors: DataFrame, weights: np.ndarray, pairs: list[tuple[int, int]], total: int, all_terms: int, k: int, block: int) -> DataFrame:
    """The index: a row for each block with its documents, postings by term, and intersection lists by pair cut to their ``k`` best joint impacts and maximum."""

    def rows(ids: list, length: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(ids)), sizes)
        value = impacts(weights[terms], tfs.astype(np.int64), np.repeat(length, sizes), total, all_terms)
        order = np.lexsort((doc, terms))
        terms, doc, value = terms[order], doc[order].astype(np.int32), value[order]
        known, start = np.unique(terms, return_index=True)
        ends = np.append(start, len(terms))[1:]
        lists = {int(t): (doc[a:b], value[a:b]) for t, a, b in zip(known, start, ends, strict=True)}
        met, joint = [], []
        for n, (a, b) in enumerate(pairs):
            if a in lists and b in lists:
                (da, va), (db, vb) = sorted((lists[a], lists[b]), key=lambda x: len(x[0]))
                place = np.minimum(np.searchsorted(db, da), len(db) - 1)
                hit = db[place] == da
                if hit.any():
                    met.append(n)
                    joint.append(np.sort(va[hit] + vb[place[hit]])[::-1][:k])
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        cols = [
            one(ids, pa.int64()), one(known, pa.int32()), one(ends, pa.int64()), one(doc, pa.int32()), one(value, pa.int64()),
            one(met, pa.int32()), pa.array([joint], pa.list_(pa.list_(pa.int64()))),
        ]
        return pa.RecordBatch.from_arrays(cols, ["ids", "terms", "ends", "docs", "impacts", "pairs", "joint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            ids, length, terms, tfs = (c.chunk(0) for c in pa.Table.from_batches(held).combine_chunks().columns)
            return rows(ids.to_pylist(), length.to_numpy(), terms.flatten().to_numpy(), tfs.flatten().to_numpy(), terms.value_lengths().to_numpy())

        for batch in batches:
            while batch.num_rows:
                room = block - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == block:
                    yield out()
                    held = []
        if held:
            yield out()

    kind = "ids array<long>, terms array<int>, ends array<long>, docs array<int>, impacts array<long>, pairs array<int>, joint array<array<long>>"
    return small_batches(vectors).mapInArrow(run, kind)


def _ranked(df: DataFrame, key: str, *order: Column, k: int) -> DataFrame:
    """The first ``k`` rows of each key with their rank; first within 64 parts, so that no task gets more than ``k`` rows of a part for a key."""
    parts = df.withColumn("part", F.spark_partition_id() % 64)
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def _floors(index: DataFrame, items: list[list[tuple[int, ...]]], pairs: list[tuple[int, int]], k: int) -> list[int]:
    """For each item the largest ``k``-th joint impact of one of its pairs; 0 where no pair has as many documents."""
    joint = index.select(F.explode(F.arrays_zip("pairs", "joint")).alias("x")).select(F.col("x.pairs").alias("pair"), F.explode("x.joint").alias("v"))
    best = _ranked(joint, "pair", F.desc("v"), k=k).where(F.col("rank") == k)
    floor = {pairs[r["pair"]]: r["v"] for r in best.select("pair", "v").collect()}  # a number for each pair of the group
    return [max((floor.get(u, 0) for u in units if len(u) == 2), default=0) for units in items]


def _search(index: DataFrame, items: list[list[tuple[int, ...]]], pairs: list[tuple[int, int]], floors: list[int], k: int) -> DataFrame:
    """``item, doc_id, score``: each task's best ``k`` of each item, ties with the last included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, object), np.empty(0, np.int64))] * len(items)
        floor = list(floors)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, terms, ends, docs, values, met, joint = (batch.column(c)[i] for c in ("ids", "terms", "ends", "docs", "impacts", "pairs", "joint"))
                docs, values, ends = docs.values.to_numpy(), values.values.to_numpy(), ends.as_py()
                lists = {t: (docs[a:b], values[a:b]) for t, a, b in zip(terms.as_py(), [0, *ends][:-1], ends, strict=True)}
                block = Block(np.asarray(ids.as_py(), object), lists, {pairs[p]: j[0] for p, j in zip(met.as_py(), joint.as_py(), strict=True)})
                for n, units in enumerate(items):
                    some, score = block.best(units, floor[n], k)
                    if len(some):
                        ids, score = np.concatenate([best[n][0], block.ids[some]]), np.concatenate([best[n][1], score])
                        if len(score) > k:
                            floor[n] = max(floor[n], int(np.partition(score, len(score) - k)[len(score) - k]))
                            ids, score = _first(ids, score, k)
                        best[n] = ids, score
        for n, (ids, score) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(ids), pa.int32()), pa.array(ids.tolist(), pa.int64()), pa.array(score)], ["item", "doc_id", "score"])

    return small_batches(index).mapInArrow(run, "item int, doc_id long, score long")


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, equal ones by ascending id, rows without an id last."""
    known = np.asarray([i is not None for i in ids])
    order = np.lexsort((np.where(known, ids, 0).astype(np.int64), ~known, -score))[:k]
    return ids[order], score[order]


def _groups(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list]:
    """The different items that have a term, as rows of ``item_id, item_text``, in groups of about ``most`` terms.

    An item's terms are at most half its bytes, so its bytes say how many groups there are before one is read.
    """
    own = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("item_text")).distinct()
    size = own.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    groups = max(1, -(-size // (2 * most)))
    for g in range(groups):
        yield own.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(groups)) == g).collect()


def search(docs: DataFrame, items: DataFrame, k: int = 50, group_terms: int = 200_000, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents that score above 0, equal scores by ascending id.

    Every document row is a document: rows that repeat are ranked each, rows without an id after all others of
    their score. Item rows that repeat whole are one item; rows of one id and different texts are different
    items, each with its ranks. Null and empty texts have no terms, count for no statistic and are never found;
    items without a term give no rows, and so do empty tables. Texts are whole; other columns are ignored.
    """
    out = [_searched(docs, group, k, block, id_col, text_col, items.select(item_col).schema[0].dataType.simpleString()) for group in _groups(items, item_col, item_text, group_terms)]
    return reduce(DataFrame.unionByName, out)


def _searched(docs: DataFrame, group: list, k: int, block: int, id_col: str, text_col: str, id_type: str) -> DataFrame:
    spark = docs.sparkSession
    sets = [sorted(set(terms_of(r["item_text"].encode()))) for r in group]
    vocabulary = {w: n for n, w in enumerate(sorted({w for s in sets for w in s}))}
    vectors = written(term_vectors(docs, vocabulary, id_col, text_col), "vectors")
    total, all_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # a number for each term of the group
    weights = np.full(len(vocabulary), weight(total, 0), np.int64)
    for r in counted:
        weights[r["t"]] = weight(total, r["df"])
    held = {r["t"] for r in counted}
    own = [np.asarray([t for w in s if (t := vocabulary[w]) in held], np.int64) for s in sets]
    units = []
    for terms in own:
        two = chosen_pairs(terms, weights)
        rest = set(terms.tolist()) - {t for p in two for t in p}
        units.append([*two, *((t,) for t in rest)])
    pairs = sorted({u for us in units for u in us if len(u) == 2})
    index = written(_block_rows(vectors.select("doc_id", "length", "terms", "tfs"), weights, pairs, total, all_terms, k, block), "index")
    found = _search(index, units, pairs, _floors(index, units, pairs, k), k)
    found = _ranked(found, "item", F.desc("score"), F.col("doc_id").isNull(), F.col("doc_id"), k=k)
    names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(group)], f"item int, item_id {id_type}")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def term_column(text: Column) -> Column:
    """The terms of a text as an array, for use in expressions."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(f"({TERM})"))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
n as (select doc_id, len(w)::bigint as n from d where len(w) > 0),
a as (select count(*)::bigint as total, sum(n)::bigint as terms from n),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
p as (select doc_id, t, count(*)::bigint as tf from (select doc_id, unnest(w) as t from d) where t in (select t from q) group by all),
w as (select t, floor(1000 * ln((2 * total + 2)::double / (2 * count(*) + 1)))::bigint as w from p, a group by t, total),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * total) // terms))))::bigint as score
  from q join p using (t) join w using (t) join n using (doc_id), a group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 50
"""
