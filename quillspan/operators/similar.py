"""Texts by the same author that look copied from each other."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import nfkc_without_blanks
from quillspan.operators.groups import group_sizes
from quillspan.sources.scratch import written


def char_ngrams(text: Column, n: int = 2) -> Column:
    """The set of n-grams in code points; a text shorter than ``n`` is its own only one."""

    def grams(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: F.concat(*(F.get(c, i + k) for k in range(n)))))

    return F.when(F.length(text) < n, F.array(text)).otherwise(F.transform(F.array(F.split(text, "")), grams)[0])


def jaccard(a: Column, b: Column) -> Column:
    """The shared part of two sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def _texts(df: DataFrame, author: str, text: str) -> DataFrame:
    """Different texts of each author with their copies; authors without blanks in upper case, texts of three characters on."""
    own = df.select(F.upper(nfkc_without_blanks(F.col(author))).alias("author"), nfkc_without_blanks(F.col(text)).alias("t"))
    return own.where("author <> '' and length(t) >= 3").groupBy("author", "t").agg(F.count(F.lit(1)).alias("copies"))


#: Texts, and grams of all their sets, that meet others as one block; texts that are compared at a time.
BLOCK, GRAMS, STEP = 16_384, 1 << 22, 1024


def _packed(own: np.ndarray) -> bytes:
    """Sorted numbers as bytes: their steps, highest bytes first, compressed."""
    return zlib.compress(np.diff(own, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(own: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(own), np.uint8).reshape(8, -1).T).view(np.uint64).ravel().cumsum(dtype=np.uint64)


def gram_sets(text: Column, n: int = 2) -> Column:
    """``struct<n, set>``: how many n-grams the text has, and their sorted numbers as packed bytes.

    A gram's number is its code points in base 2**21 for up to two of them, else a 64-bit hash; a text shorter than ``n`` has none.
    """

    def grams(own: str) -> np.ndarray:
        points = np.frombuffer(own.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        out = np.zeros(max(0, len(points) - n + 1), np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15 if n > 2 else 1 << 21) + points[k : k + len(out)]
        return np.unique(out)

    @F.arrow_udf("struct<n:int,set:binary>")
    def run(texts: pa.Array) -> pa.Array:
        sets = [grams(x.as_py() or "") for x in texts]
        return pa.StructArray.from_arrays([pa.array([len(x) for x in sets], pa.int32()), pa.array(map(_packed, sets), pa.binary())], ["n", "set"])

    return run.asNondeterministic()(text)  # else every use of a field would make the set again


class _Side:
    """Sets of a tile by size; their grams are numbered within the tile."""

    def __init__(self, rows: np.ndarray, n: np.ndarray, starts: np.ndarray, grams: np.ndarray):
        self.rows, self.n, self.starts, self.grams = rows, n, starts, grams

    def part(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``STEP`` sets from the ``i``-th on: rows, sizes, and for each gram its set's place and its number."""
        rows = self.rows[i : i + STEP]
        n = self.n[rows]
        place = np.repeat(np.arange(len(rows)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[rows], n)
        return rows, n, place, self.grams[at]


def _shared(x: tuple, y: tuple, known: int) -> np.ndarray:
    """How many grams each set of ``x`` has in common with each of ``y``: common grams by a matrix product, rare ones counted."""
    (xr, _, xp, xg), (yr, _, yp, yg) = x, y
    met = np.bincount(xg, minlength=known) * np.bincount(yg, minlength=known)
    out = np.zeros((len(xr), len(yr)), np.float32)
    often = np.flatnonzero(met > 1500)
    for k in range(0, len(often), 4096):
        column = np.full(known, -1)
        column[often[k : k + 4096]] = np.arange(len(often[k : k + 4096]))
        sides = []
        for p, g, m in ((xp, xg, len(xr)), (yp, yg, len(yr))):
            has = (c := column[g]) >= 0
            sides.append(np.zeros((m, min(4096, len(often) - k)), np.float32))
            sides[-1][p[has], c[has]] = 1
        out += sides[0] @ sides[1].T
    rare = (met > 0) & (met <= 1500)
    xk, yk = np.flatnonzero(rare[xg]), np.flatnonzero(rare[yg])
    yk = yk[np.argsort(yg[yk], kind="stable")]
    times = np.bincount(yg[yk], minlength=known)
    first = np.cumsum(times) - times
    for part in np.array_split(xk, len(xk) // 8192 + 1):
        n = times[xg[part]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[xg[part]], n)
        if len(at):
            out += np.bincount(np.repeat(xp[part], n) * len(yr) + yp[yk[at]], minlength=out.size).reshape(out.shape)
    return out


def _tile(n: np.ndarray, sets: list[bytes], right: np.ndarray, one: bool, linked: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the left and of the right sets of a tile that are similar, and how; of ``one`` block every pair once.

    If ``linked``, only as many pairs as tell which rows are linked over any number of pairs within the tile.
    """
    own = [_unpacked(x) for x in sets]
    n = n.astype(np.int64)
    known, grams = np.unique(np.concatenate(own), return_inverse=True)
    starts = np.cumsum(n) - n
    order = np.argsort(n, kind="stable")
    y = _Side(order[right[order]], n, starts, grams)
    x = y if one else _Side(order[~right[order]], n, starts, grams)
    root = np.arange(len(n))
    for i in range(0, len(x.rows), STEP):
        a = x.part(i)
        for j in range(i if one else 0, len(y.rows), STEP):
            rows = y.rows[j : j + STEP]
            if 5 * n[rows[-1]] < 4 * a[1][0] or 5 * a[1][-1] < 4 * n[rows[0]] or (linked and (root[a[0]] == root[a[0][0]]).all() and (root[rows] == root[a[0][0]]).all()):
                continue
            b = y.part(j)
            m = _shared(a, b, len(known))
            least = -(-4 * (a[1][:, None] + b[1][None, :]) // 9)  # 5 m >= 4 (x + y - m)
            hit = m >= least
            k, l = np.nonzero(np.triu(hit, 1) if one and i == j else hit)
            shared = m[k, l].astype(np.int64)
            k, l = a[0][k], b[0][l]
            if linked:
                ends = root[k] * len(n) + root[l]
                _, at = np.unique(ends[root[k] != root[l]], return_index=True)
                at = np.flatnonzero(root[k] != root[l])[at]
                at = at[_joined(root, k[at], l[at])]
                k, l, shared = k[at], l[at], shared[at]
            if len(k):
                yield k, l, shared / (n[k] + n[l] - shared)


def _joined(root: np.ndarray, k: np.ndarray, l: np.ndarray) -> list[int]:
    """Joins the groups of each two rows in ``root``, in place; which of the pairs joined two."""
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while v in up:
            up[v] = v = up.get(up[v], up[v])
        return v

    out = []
    for i, (v, w) in enumerate(zip(root[k].tolist(), root[l].tolist(), strict=True)):
        v, w = top(v), top(w)
        if v != w:
            up[max(v, w)] = min(v, w)
            out.append(i)
    if up:
        to = np.arange(len(root))
        for v in up:
            to[v] = top(v)
        root[:] = to[root]
    return out


def similar_sets(sets: DataFrame, most_pairs: int = 10**13, linked: bool = False) -> DataFrame:
    """``id_a, id_b, jaccard`` with id_a < id_b: sets of one author that share four fifths or more of what they hold together.

    Exact. Similar sets are in the same band of sizes, each a quarter larger than the one before, or in
    neighbouring ones, so an author's sets meet within two bands only, as tiles of two blocks of up to ``BLOCK`` sets
    and ``GRAMS`` grams: a common author or band is many tiles. A tile counts what its sets share by products of
    matrices, a few sets at a time, so sets don't come together pair by pair. ``sets`` has ``author, id, n, set``, see
    ``gram_sets``; with ``shown`` as well, ``author, a, b`` come out too, of the smaller and the larger id. If ``linked``,
    a pair may be left out where others of its tile link its ends. Where more than ``most_pairs`` pairs would meet,
    nothing is begun and an error raised.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9)
    own = sets.where("n > 0").withColumn("band", band)
    sizes = own.groupBy("author", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("g"))
    sizes = written(sizes.select("author", "band", "m", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("g") / GRAMS)).cast("long").alias("blocks")), "bands")
    below = sizes.select("author", (F.col("band") + 1).alias("band"), F.col("m").alias("w"), F.col("blocks").alias("below"))
    above = sizes.select("author", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    sizes = sizes.join(below, ["author", "band"], "left").join(above, ["author", "band"], "left").fillna(0, ["w", "below", "above"])
    total = sizes.agg(F.sum(F.col("m").cast("double") * (F.col("m") + F.col("w")))).first()[0] or 0
    if total > most_pairs:
        raise ValueError(f"{total:.3g} pairs of texts would meet; the limit is {most_pairs:.3g}")
    tile = "struct<band:bigint,low:boolean,x:bigint,y:bigint,right:boolean>"

    def tiles(first: Column, end: Column, of: Callable[[Column], tuple]) -> Column:
        names = ("band", "low", "x", "y", "right")
        found = F.transform(F.sequence(first, F.greatest(end - 1, first)), lambda i: F.struct(*(c.alias(k) for k, c in zip(names, of(i), strict=True))))
        return F.when(end > first, found).otherwise(F.array().cast(f"array<{tile}>"))

    zero, k, at = F.lit(0).cast("long"), F.col("k"), F.col("band")
    # A block meets itself and those before it on the right, those behind it and the ones of the next band on the left.
    met = F.concat(
        tiles(zero, k + 1, lambda i: (at, F.lit(False), i, k, F.lit(True))), tiles(k + 1, F.col("blocks"), lambda i: (at, F.lit(False), k, i, F.lit(False))),
        tiles(zero, F.col("above"), lambda i: (at + 1, F.lit(True), k, i, F.lit(False))), tiles(zero, F.col("below"), lambda i: (at, F.lit(True), i, k, F.lit(True))),
    )
    keep = ["author", "id", "n", "set", *(["shown"] if "shown" in sets.columns else [])]
    own = own.join(sizes.drop("m", "w"), ["author", "band"]).withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")))
    own = own.select(*keep, F.explode(met).alias("_t")).select(*keep, "_t.*")
    out = f"author {dict(sets.dtypes)['author']}, id_a long, id_b long, jaccard double" + (f", a {(kind := dict(sets.dtypes)['shown'])}, b {kind}" if "shown" in keep else "")

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        author, _, low, x, y = (v.as_py() for v in key)
        whole = pa.Table.from_batches(list(batches))
        ids, shown = whole["id"].to_numpy(), whole["shown"].combine_chunks() if "shown" in keep else None
        for k, l, jaccard in _tile(whole["n"].to_numpy(), whole["set"].to_pylist(), whole["right"].to_numpy(), not low and x == y, linked):
            a, b = np.where(ids[k] < ids[l], k, l), np.where(ids[k] < ids[l], l, k)
            columns = {"author": pa.array([author], whole.schema.field("author").type).take(pa.array(np.zeros(len(a), np.int64))), "id_a": ids[a], "id_b": ids[b], "jaccard": jaccard}
            yield pa.RecordBatch.from_pydict(columns | ({"a": shown.take(pa.array(a)), "b": shown.take(pa.array(b))} if shown is not None else {}))

    return own.groupBy("author", "band", "low", "x", "y").applyInArrow(compare, out)


def _long_sets(texts: DataFrame, short: int, n: int, *more: Column) -> DataFrame:
    """The sets of texts that are not short; ``texts`` has ``author, id, t``."""
    long = texts.where(F.length("t") >= max(short, n))
    return written(long.select("author", "id", gram_sets(F.col("t"), n).alias("x"), *more).select("author", "id", "x.*", *(["shown"] if more else [])), "sets")


def similar_pairs(texts: DataFrame, short: int = 15, n: int = 2, most_pairs: int = 10**13, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """``author, a, b, jaccard`` with a < b: different long texts of one author whose n-gram sets share four fifths or more.

    Exact, see ``similar_sets``. Texts are numbered in their order and come back only for the pairs that hold; where
    ``shown``, such as a digest, is to stand for them, it takes part in the comparison and nothing is joined. ``texts``
    has ``author, t``.
    """
    own = written(texts.select("author", "t").orderBy("t", "author").withColumn("id", F.monotonically_increasing_id()), "texts")
    both = similar_sets(_long_sets(own, short, n, *([shown(F.col("t")).alias("shown")] if shown else [])), most_pairs)
    if shown:
        return both.select("author", "a", "b", "jaccard")
    both = written(both, "pairs")
    one = both.join(own.select(F.col("id").alias("id_a"), F.col("t").alias("a")), "id_a")
    return one.join(own.select(F.col("id").alias("id_b"), F.col("t").alias("b")), "id_b").select("author", "a", "b", "jaccard")


def flag_similar(df: DataFrame, author: str = "author", text: str = "text", short: int = 15, warning: str = "looks_copied", fix: str = "rewrite in own words", exclude: Column | None = None, least: int = 3) -> DataFrame:
    """Adds ``copied`` (in a group of ``least`` records or more), ``copy_group`` and ``copy_size``.

    Where there are findings' columns, copied ones get the warning and its fix item once; PASS becomes WARNING.
    Rows that ``exclude`` holds for, rows without an author and texts under three characters are compared with
    nothing: their group is null. Short texts are similar only if equal.
    """
    a = F.upper(nfkc_without_blanks(F.col(author)))
    own = df.withColumns({"_a": a if exclude is None else F.when(~exclude, a), "_t": nfkc_without_blanks(F.col(text))})
    compared = (F.col("_a") != "") & (F.length("_t") >= 3)
    # From here on 128 bits stand for a text and its author, so texts are neither sorted nor shuffled.
    own = own.withColumns({"_k": F.when(compared, F.xxhash64("_a", "_t")), "_l": F.when(compared, F.xxhash64(F.lit(1), "_a", "_t"))})
    sets = own.where("_k is not null").select(F.col("_a").alias("author"), F.col("_k").alias("id"), "_l", gram_sets(F.when(F.length("_t") >= max(short, 2), F.col("_t"))).alias("x"))
    texts = written(sets.groupBy("author", "id", "_l").agg(F.count(F.lit(1)).alias("copies"), F.first("x.n").alias("n"), F.first("x.set").alias("set")), "texts")
    edges = similar_sets(texts.select("author", "id", "n", "set"), linked=True).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    found = group_sizes(texts.select(F.col("id").alias("node"), "_l", "copies"), edges, "copies").select(F.col("node").alias("_k"), "_l", F.col("root").alias("copy_group"), F.col("size").alias("copy_size"))
    own = own.select(*df.columns, "_k", "_l").join(found, ["_k", "_l"], "left").withColumn("copied", F.coalesce(F.col("copy_size") >= least, F.lit(False)))
    out = own.select(*df.columns, "copied", "copy_group", "copy_size")
    if {"warnings", "fix_items", "severity"} <= set(df.columns):
        add = lambda c, v: F.when(F.col("copied"), F.array_union(c, F.array(F.lit(v)))).otherwise(F.col(c))
        out = out.withColumns({"warnings": add("warnings", warning), "fix_items": add("fix_items", fix), "severity": F.when(F.col("copied") & (F.col("severity") == "PASS"), "WARNING").otherwise(F.col("severity"))})
    return out


def copied_by_count(df: DataFrame, author: str, text: str, least: int = 3) -> DataFrame:
    """Equal texts of an author that occur often."""
    return _texts(df, author, text).where(F.col("copies") >= least)


