"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is that of its word shingles, as 64-bit hashes; documents with the same set are one node. All
sets are sorted in one order, rare shingles first: two sets as similar as asked share a shingle among the first
``n - ceil(similarity * n) + 1`` of each, their prefixes. Nodes that meet in a prefix shingle must pass

* the length filter: the smaller set has at least ``similarity`` of the larger one's size;
* the positional filter: what stands behind the shingle in both sets can still make up the shared part needed;
* the suffix filter: the shingles before it, which the two don't share if they first meet here, and a lower bound
  of the difference of what stands behind it, from 256 bits of parity, are within the difference allowed; and so is
  the like bound for the two whole sets, from 512 bits.

Pairs that pass in any shingle are made distinct, and each is verified once on the two whole sets.

The order. Counting all shingles would shuffle more than the texts. Any order common to all sets is right, so
those shingles come first whose hash is in the lower five sixteenths, by how many documents hold them; they
are counted in full. A set with too few of them for its prefix gives all its shingles to be counted, and the
others follow in the same way. A shingle that one node alone gives can't bring two together, so all joins are on the
shared ones only; the others stand before the shared ones of their half and count as places. Each given shingle is
shuffled once: the window that counts it also tells whether it is shared.

Groups of copies. A shingle that thousands of near copies share isn't turned into all pairs: its members meet some
of them, its leaders, and links make components. In the next round only members of other components than the
leader's meet it. What is in different components after some rounds meets in full, members of the commonest
component on one side only. Shingles with the same members count once, the first in the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.components import components
from quillspan.llm.shared import broadcast_if_small, drop_written, release_shuffles, small_batches, texts, written, written_so_far
from quillspan.llm.simhash import set_hash, shingle_hashes, shingle_sets

#: Hashes under this, as unsigned numbers, come first in the order.
FIRST = 5 << 60
#: Longs of parity for what stands behind a shingle, and for a whole set.
WORDS, WHOLE = 4, 8
#: Leaders of a shingle in a round, for its commonest root and for all others, and rounds before all that is left meets.
LEADERS, ROUNDS = 4, 4
#: Parts of the shingles, by hash, that are counted one after the other, so that one part's shuffle is on disk at a time.
PARTS = 2


def prefix_size(n, num: int, den: int):
    """Of ``n`` shingles, how many of the first include one of any ``ceil(n * num / den)``."""
    return n - (n * num + den - 1) // den + 1


def document_sets(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, node, n, n_first, g, whole`` for every row: the set's hash, its size, how many of it come first in the order, the shingles to be counted, and the set's parity.

    ``g`` and ``whole`` are null where the task gave it for the same set shortly before. Rows without words have ``n`` 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, found in texts(batch, "text"):
                node, size, first, given, whole = [], [], [], [], []
                for text in found:
                    own = np.unique(shingle_hashes(text, words))
                    ahead = int(np.searchsorted(own, np.uint64(FIRST)))
                    node.append(set_hash(own))
                    size.append(len(own))
                    first.append(ahead)
                    given.append(None if node[-1] in seen else own[:ahead] if ahead >= prefix_size(len(own), num, den) else own)
                    whole.append(None if node[-1] in seen else parity(own))
                    seen.add(node[-1])
                    if len(seen) > 100_000:
                        seen.clear()
                cols = [part.column("doc_id"), part.column("text_key"), pa.array(np.asarray(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(first, pa.int32())]
                g = pa.array([None if x is None else x.view(np.int64) for x in given], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*cols, g, pa.array(whole, pa.list_(pa.int64()))], ["doc_id", "text_key", "node", "n", "n_first", "g", "whole"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return small_batches(own).mapInArrow(run, "doc_id long, text_key long, node long, n int, n_first int, g array<long>, whole array<long>")


def parity(own: np.ndarray) -> np.ndarray:
    """Bits that a set's hashes turn over: two sets differ in at least as many shingles as their parities in bits."""
    turned = np.bincount((own >> np.uint64(9)).astype(np.int64) % (64 * WHOLE), minlength=64 * WHOLE).astype(np.uint8) & 1
    return np.packbits(turned, bitorder="little").view(np.int64)


def shared_rows(sets: DataFrame) -> DataFrame:
    """``node, n, n_first, g, c`` for each given shingle that two nodes or more give: ``c`` counts the rows that give it."""
    given = sets.where("g is not null").select("node", "n", "n_first", F.explode("g").alias("g"))
    of = Window.partitionBy("g")
    tables = []
    for part in range(PARTS):
        some = given.where(F.pmod("g", F.lit(PARTS)) == part).select("*", F.count(F.lit(1)).over(of).alias("c"), F.min("node").over(of).alias("x"), F.max("node").over(of).alias("y"))
        tables.append(written(some.where("x <> y").drop("x", "y"), "shared"))
        release_shuffles(sets.sparkSession)
    return reduce(DataFrame.unionByName, tables)


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``rare, node, n, i, s0, s1, s2, s3``: a row for each shared shingle in a node's prefix, with its place and the parity of the shared ones behind it.

    ``rare`` is the shingle as a struct that sorts in the common order: whether it comes later, its count, its hash.
    """
    rows = shared_rows(sets).groupBy("node", "n", "n_first").agg(F.collect_set(F.struct("c", "g")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(8)]
            for node, n, first, x in zip(*(batch.column(c) for c in ("node", "n", "n_first", "x")), strict=True):
                n, first, (c, g) = n.as_py(), first.as_py(), (a.to_numpy() for a in x.values.flatten())
                late = g.view(np.uint64) >= np.uint64(FIRST)
                order = np.lexsort((g, c, late))
                c, g, late = c[order], g[order], late[order]
                ahead = int((~late).sum())
                rank = np.arange(len(g))
                # Shingles that no other node gave stand before the shared ones of their half.
                place = np.where(late, n - len(g) + rank, first - ahead + rank)
                bits = np.zeros((len(g) + 1, 4), np.int64)
                bits[rank, (g >> 6) & 3] = np.int64(1) << (g & 63)
                behind = np.bitwise_xor.accumulate(bits[::-1], axis=0)[::-1]
                behind[:ahead] ^= behind[ahead]  # each half has a suffix of its own
                own = np.flatnonzero(place < prefix_size(n, num, den))
                for k, v in enumerate((late[own], c[own], g[own], np.full(len(own), node.as_py()), np.full(len(own), n), place[own])):
                    out[k].append(v)
                out[6].append(behind[own + 1] ^ np.where((own + 1 == ahead)[:, None], behind[ahead], 0) if ahead < len(g) else behind[own + 1])
            if out[0]:
                late, c, g, node, n, place, behind = map(np.concatenate, out[:7])
                rare = pa.StructArray.from_arrays([pa.array(late), pa.array(c, pa.int64()), pa.array(g, pa.int64())], ["late", "c", "g"])
                parity = [pa.array(np.ascontiguousarray(behind[:, w])) for w in range(WORDS)]
                yield pa.RecordBatch.from_arrays([rare, pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(place, pa.int32()), *parity], ["rare", "node", "n", "i", *(f"s{w}" for w in range(WORDS))])

    kind = "rare struct<late:boolean,c:long,g:long>, node long, n int, i int, " + ", ".join(f"s{w} long" for w in range(WORDS))
    return small_batches(rows).mapInArrow(run, kind)


def meeting_rows(rows: DataFrame) -> DataFrame:
    """The rows of shingles in the prefixes of two nodes or more; of shingles with the same members, the first in the order."""
    members = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in range(2)]
    sizes = rows.groupBy("rare").agg(F.count(F.lit(1)).alias("m"), *members).where("m > 1")
    first = sizes.groupBy("m", "x0", "x1").agg(F.min("rare").alias("rare")).select("rare")
    return rows.join(first, "rare").select(F.xxhash64("rare.g").alias("k"), *rows.columns)


def may_hold(x: str, y: str, num: int, den: int) -> Column:
    """The three filters, for two rows of one shingle. ``num / den`` is the similarity."""
    c = lambda side, name: F.col(f"{side}.{name}").cast("long")
    nx, ny, i, j = c(x, "n"), c(y, "n"), c(x, "i"), c(y, "i")
    need = F.ceil((nx + ny) * num / F.lit(num + den) - 1e-9)  # shared shingles
    length = den * F.least(nx, ny) >= num * F.greatest(nx, ny)
    place = 1 + F.least(nx - i, ny - j) - 1 >= need
    apart = i + j
    for w in range(WORDS):
        apart = apart + F.bit_count(c(x, f"s{w}").bitwiseXOR(c(y, f"s{w}")))
    differ = sum((F.bit_count(c(x, f"w{w}").bitwiseXOR(c(y, f"w{w}"))) for w in range(WHOLE)), F.lit(0))
    return length & place & (apart <= nx + ny - 2 * need) & (differ <= nx + ny - 2 * need)


def pairs_of(found: DataFrame) -> DataFrame:
    return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def mixed_rows(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """The rows of shingles whose members have several roots under ``links``, with ``root`` and ``big``, the commonest root of the shingle; without links every node is its own root."""
    if links is None:
        own = rows.withColumn("root", F.col("node"))
    else:
        own = rows.join(broadcast_if_small(written(components(links), "roots")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = written(own, "rooted")
    big = own.groupBy("k", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("k").agg(F.max(F.struct("m", "root")).alias("b"), F.count(F.lit(1)).alias("roots"))
    big = written(big.where("roots > 1").select("k", F.col("b.root").alias("big")), "big")
    return written(own.join(broadcast_if_small(big), "k"), "mixed")


def leader_pairs(rows: DataFrame, nth: int, num: int, den: int) -> DataFrame:
    """``a, b``: each member of a shingle with its leaders of other roots, where the filters let them.

    A shingle has up to ``LEADERS`` leaders of its commonest root and as many of all others, drawn by a hash that
    changes with ``nth``, so shingles with nearly the same members have the same leaders.
    """
    own = [c for c in rows.columns if c not in ("k", "rare", "big")]
    slot = F.struct((F.col("root") == F.col("big")).alias("of"), F.pmod(F.xxhash64(F.lit(2 * nth), "node"), F.lit(LEADERS)).alias("slot"))
    leaders = rows.groupBy("k", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64(F.lit(2 * nth + 1), "node").alias("h"), *own)).alias("l")).select("k", "l.*")
    return pairs_of(rows.alias("x").join(leaders.alias("y"), "k").where((F.col("x.root") != F.col("y.root")) & may_hold("x", "y", num, den)))


def rest_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: members of a shingle with different roots, where the filters let them."""
    few = rows.where("root <> big")
    met = few.alias("x").join(rows.alias("y"), "k").where((F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.big")) | (F.col("x.node") < F.col("y.node"))) & may_hold("x", "y", num, den))
    return pairs_of(met)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets have this exact similarity or more; ``sets`` has ``node, shingles``."""
    # Of the sets only those in a pair are shuffled.
    some = {k: written(pairs.select(k).distinct(), "ends") for k in ("a", "b")}
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")).join(broadcast_if_small(some[k]), k, "left_semi")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("both", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
    return both.where(den * F.col("both") >= num * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")


def linked_documents(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the smallest id that links of Jaccard ``num / den`` or more reach.

    Exact but for chance: sets are of 64-bit hashes of lower-cased (A-Z) shingles. A text with fewer words is one
    shingle; null texts and texts without words have no shingles, link with nothing and are their own component.
    Rows that repeat are returned each, with the component of their set. A null id is never the smallest; a
    component of null ids only has a null ``component_id``. Texts are whole; other columns are ignored; an empty
    table gives no rows.
    """
    mark = written_so_far()
    own = written(document_sets(docs, words, num, den, id_col, text_col), "sets")
    some = own.where("n > 0")
    rows = written(prefixes(some, num, den), "prefixes")
    release_shuffles(docs.sparkSession)
    rows = written(meeting_rows(rows), "members")
    nodes = written(rows.select("node").distinct(), "nodes")
    whole = some.where("whole is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.any_value("whole").alias("w"))
    rows = written(rows.join(whole, "node").select(*rows.columns, *(F.col("w")[w].alias(f"w{w}") for w in range(WHOLE))), "meeting")

    # Shingles are no longer needed, and they are most of what was written.
    own = written(own.select("doc_id", "text_key", "node", "n"), "nodes")
    some = own.where("n > 0")
    drop_written(docs.sparkSession, mark, keep=(own, rows, nodes))
    release_shuffles(docs.sparkSession)

    # One document of each node that meets another is read again for its whole set.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    keys = some.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(row).alias("r"))
    keys = broadcast_if_small(written(keys.select(F.col("r.doc_id").alias("key_id"), F.col("r.text_key").alias("key_text")), "keys"))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    text = text.join(keys, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_key") == F.col("key_text")), "left_semi")
    sets = written(shingle_sets(text, words).dropDuplicates(["node"]), "wholes")

    links = tried = None
    for nth in range(ROUNDS + 1):
        mark = written_so_far()
        mixed = mixed_rows(rows, links)
        if mixed.isEmpty():
            break
        pairs = leader_pairs(mixed, nth, num, den) if nth < ROUNDS else rest_pairs(mixed, num, den)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = written(verified(pairs, sets, num, den), "links")
        drop_written(docs.sparkSession, mark, keep=(pairs, found))
        release_shuffles(docs.sparkSession)
        links, tried = (found, pairs) if links is None else (links.unionByName(found), tried.unionByName(pairs))

    least = some.groupBy("node").agg(F.min("doc_id").alias("least"))
    if links is None:
        least = least.withColumn("root", F.col("node"))
    else:
        least = least.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = written(least, "roots")
    ids = written(least.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = written(least.join(ids, "root").select("node", "component_id"), "named")
    out = own.select("doc_id", "n", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end)) as s from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
h as (select doc_id, hash(s) as s from s where s in (select s from s group by 1 having count(*) > 1)),
p as (select x.doc_id as a, y.doc_id as b, count(*) as m from h x join h y using (s) where x.doc_id < y.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * m >= 80 * (x.n + y.n - m)),
e as (select a, b from l union all select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on r.doc_id = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, d.component_id from (select doc_id, min(c) as component_id from r group by 1) d left join n using (doc_id)
"""
