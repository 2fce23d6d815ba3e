"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

A test item is the set of its shingles of five words (letters and digits, lower case); a document holds
it if it has at least ``threshold`` of the set. An item of ``n`` shingles that is held lacks at most
``n - ceil(threshold * n)`` of them, so one of its ``n - ceil(threshold * n) + 1`` smallest hashes - its
bottom-k MinHash sketch - is always in the document: the search has no false negatives. Documents are
partitioned by their number of shingles, in powers of four, and a partition is searched only for items whose
required shingles can fit into it. What the sketches find is verified on the shingles' texts.

The search passes on numbers only: a hash of the text, its size class and its shingles' hashes meet the sketches'
hashes, and what meets is made distinct, however many hashes of an item a text holds. Only texts that meet an item
are read again to be verified. Up to ``most_probes`` sketch hashes are broadcast, and items and their rows where
their measured size is small; all else is joined by a shuffle. No hash becomes part of a plan or is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import bound, broadcast_if_small, written

WORDS = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _hashes(words: Column, n: int) -> Column:
    """The hashes of all shingles in order; shorter texts are one shingle, texts without words none."""

    def shingles(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(h[i + k] for k in range(n))))
        return F.when(F.size(h) >= n, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def _texts(words: Column, n: int) -> Column:
    """The distinct shingles as texts."""

    def shingles(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) >= n, runs).when(F.size(w) > 0, F.array(F.concat_ws(" ", w))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(bound(words, shingles))


def item_sketches(items: DataFrame, threshold: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """``item_id, shingles, need, sketch`` of the items that have words."""
    own = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w"))
    own = own.select("item_id", _texts(F.col("w"), words).alias("shingles"), F.array_sort(F.array_distinct(_hashes(F.col("w"), words))).alias("h")).where("size(shingles) > 0")
    need = F.greatest(F.lit(1), F.ceil(F.size("shingles") * F.lit(threshold) - 1e-9).cast("int"))
    return own.withColumn("need", need).select("item_id", "shingles", "need", F.slice("h", 1, F.size("shingles") - F.col("need") + 1).alias("sketch"))


def _size_class(n: Column) -> Column:
    """Powers of four: 0 for one to three shingles, 1 for up to 15, and so on."""
    out = F.lit(0)
    for p in range(1, 16):
        out = out + F.when(n >= 4**p, 1).otherwise(0)
    return out


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, words: int = 5, most_probes: int = 200_000, most_bytes: int = 64 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment``: a row for each document row and item row that it holds.

    Texts with fewer than five words are one shingle, which equals only that of a text with the same
    words. Null texts and texts without words hold nothing and are held by nothing. Repeated rows of
    either table give repeated rows; null ids stay null. Columns named in ``keep`` are handed on, all
    others ignored. No documents or no items give no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    # Items of equal shingles are searched for once.
    sketches = item_sketches(items, threshold, words, item_col, item_text)
    sketches = written(sketches.withColumn("key", F.xxhash64(F.array_sort("shingles"))), "items")
    distinct = sketches.groupBy("key").agg(F.first(F.struct("need", "sketch", "shingles")).alias("i")).select("key", "i.*")
    index = distinct.select(_size_class(F.col("need")).alias("class"), "key", F.explode("sketch").alias("h"))
    rows = sketches.count()
    probes, bytes_ = distinct.agg(F.coalesce(F.sum(F.size("sketch").cast("long")), F.lit(0)), F.coalesce(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)), F.lit(0))).first()
    sent = lambda df, fits: F.broadcast(df) if fits else df
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    # Where Spark can't rule out a null it tests for one first, and computes all hashes twice.
    hashed = F.array_distinct(F.coalesce(_hashes(words_of(F.col("text")), words), F.array().cast("array<bigint>")))
    shingles = own.select(F.xxhash64("text").alias("_t"), hashed.alias("_hs"))
    shingles = shingles.select("_t", _size_class(F.size("_hs")).alias("_class"), F.explode_outer("_hs").alias("_h")).where("_h is not null")
    met = shingles.join(sent(index, probes <= most_probes), (F.col("_h") == F.col("h")) & (F.col("class") <= F.col("_class")))
    pairs = written(met.select("_t", "key").distinct(), "met")
    met = own.withColumn("_t", F.xxhash64("text")).join(broadcast_if_small(pairs), "_t")
    met = met.join(sent(distinct.select("key", "shingles", "need"), bytes_ <= most_bytes), "key")
    met = met.withColumn("n_found", F.size(F.array_intersect("shingles", _texts(words_of(F.col("text")), words)))).where("n_found >= need")
    met = met.select("key", "doc_id", F.size("shingles").alias("n_shingles"), "n_found", *keep)
    out = met.join(sent(sketches.select("key", "item_id"), rows <= most_probes), "key")
    return out.select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"), *keep)


ORACLE = r"""
with w as (
  select 'd' as kind, doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents
  union all select 'b', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') from benchmark),
s as (
  select kind, id, unnest(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end)) as s
  from w where len(w) > 0),
n as (select id as item_id, count(*) as n from s where kind = 'b' group by 1),
f as (select d.id as doc_id, b.id as item_id, count(*) as f from s d join s b using (s) where d.kind = 'd' and b.kind = 'b' group by 1, 2)
select doc_id, item_id, n::int as n_shingles, f::int as n_found, f / n as containment
from f join n using (item_id) where f >= ceil(0.8 * n - 1e-9)
"""
