"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. The binary Golay code of length 23
is perfect: every word lies within three bits of exactly one codeword. A segment, filled up with zeros,
is decoded as it stands and with each of its bits turned over; that gives one to six codeword indices,
among them the own index of every segment that differs in one bit. Of at most three differing bits,
either some segment has none and another one has one at most, or each has one. So the keys are, for every
two segments, the one in full with an index of the other (34 bits), and an index of the first with an
unchanged half of the second and of the third (33 bits): every pair of linked fingerprints shares a key
that is made of the own index of one of them. Keys that no fingerprint has as its own are dropped, the
members of all others are compared, so every link found is exact and none is missed.

Only distinct fingerprints are compared. A key of two is compared in the aggregation itself; a larger
one is compared inside a task, which emits a spanning forest instead of all pairs. A key with more than
``cap`` fingerprints is never gathered: its members are dealt out anew by exact blocks of bits (of six
blocks, three at least are equal), up to three times, after which at most 512 can be left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations, permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import components
from quillspan.llm.shared import broadcast_if_small, small_batches, texts, written

SEGMENTS = (22, 21, 21)
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code of length 23.
GENERATOR = 0xAE3


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of all shingles of UTF-8 bytes in order; shorter texts are one shingle, texts without words none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.asarray([digest(b" ".join(w), 42)], np.uint64)
    return np.fromiter((digest(b" ".join(x), 42) for x in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of UTF-8 bytes, zero for a text without words."""
    return majority(shingle_hashes(text, words))


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of hashes."""
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For similar documents: samples of shingles, shingles in a sample.
SAMPLES, SAMPLE = 20, 4


def sketches(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, fp, node, samples``: a hash of the text, its fingerprint, a hash of its set of shingles, and the SimHashes of small samples of the set.

    A sample is the ``SAMPLE`` smallest of a seeded rehash, so two texts draw the same one with the chance
    of their similarity to that power.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in texts(batch, "text"):
                fp, node, samples = [], [], []
                for text in found:
                    h = shingle_hashes(text, words)
                    own = np.unique(h)
                    fp.append(majority(h))
                    node.append(set_hash(own))
                    draws = []
                    for s in range(SAMPLES if len(own) else 0):
                        x = _mixed(own, 1000 + s)
                        least = np.sort(np.partition(x, SAMPLE - 1)[:SAMPLE] if len(x) > SAMPLE else x)
                        draws.append(majority(least) ^ int(np.bitwise_xor.reduce(_mixed(least, s))))
                    samples.append(draws)
                signed = lambda x: np.asarray(x, np.uint64).view(np.int64)
                drawn = pa.array([signed(x) for x in samples], pa.list_(pa.int64()))
                cols = [part.column("doc_id"), part.column("text_key"), pa.array(signed(fp)), pa.array(signed(node)), drawn]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "fp", "node", "samples"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return small_batches(own).mapInArrow(run, "doc_id long, text_key long, fp long, node long, samples array<long>")


def set_hash(own: np.ndarray) -> int:
    """A 64-bit hash of a sorted set of shingle hashes."""
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), 7)


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """``node, shingles`` of every row's ``text``: the sorted set of its shingle hashes and the hash of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in texts(batch, "text"):
                own = [np.unique(shingle_hashes(x, words)) for x in found]
                nodes = np.asarray([set_hash(x) for x in own], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["node", "shingles"])

    return small_batches(docs.select("text")).mapInArrow(run, "node long, shingles array<long>")


def shared_samples(nodes: DataFrame) -> DataFrame:
    """``s, node``: the distinct ``node`` that share a sample with another one; samples with the same members count once.

    ``nodes`` has ``node, samples``.
    """
    drawn = written(nodes.select("node", F.posexplode("samples").alias("nth", "sample")).select(F.xxhash64("nth", "sample").alias("s"), "node"), "samples")
    same = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in range(2)]
    sizes = drawn.groupBy("s").agg(F.count(F.lit(1)).alias("n"), *same).where("n > 1")
    return written(drawn.join(sizes.groupBy("n", "x0", "x1").agg(F.min("s").alias("s")).select("s"), "s"), "shared")


def _parts(counts: DataFrame, cap: int) -> DataFrame:
    return counts.withColumn("parts", F.ceil(F.col("n") / cap))


def part_groups(shared: DataFrame, cap: int = 512) -> DataFrame:
    """``g, node, root``: the members of a sample, dealt by hash into parts of about ``cap``; each is its own root."""
    counts = written(_parts(shared.groupBy("s").agg(F.count(F.lit(1)).alias("n")), cap), "parts")
    dealt = shared.join(counts, "s").withColumn("p", F.pmod(F.xxhash64("s", "node"), F.col("parts")))
    return dealt.select(F.xxhash64("s", "p").alias("g"), "node", F.col("node").alias("root"))


def rest_groups(shared: DataFrame, roots: DataFrame, cap: int = 512) -> DataFrame:
    """``g, node, root``: groups in which every two members of a sample that are in different parts and have different roots meet.

    Of samples over ``cap`` whose members have several roots in ``roots`` (``node, root``; a node without one
    is its own) the members of the commonest root are dealt into parts, and so are all others; each part of
    the others meets each part of both. So the work grows with the members that nothing has linked yet, not
    with the square of the sample.
    """
    large = shared.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select("s")
    own = shared.join(written(large, "large"), "s").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = written(own.select("s", "node", "root"), "members")
    big = own.groupBy("s", "root").agg(F.count(F.lit(1)).alias("n"))
    big = big.groupBy("s").agg(F.max(F.struct("n", "root")).alias("b"), F.sum("n").alias("all")).where("all > b.n")
    big = written(big.select("s", F.col("b.root").alias("big"), F.ceil(F.col("b.n") / cap).alias("bigs"), F.ceil((F.col("all") - F.col("b.n")) / cap).alias("others")), "big")
    own = own.join(big, "s").withColumn("is_big", F.col("root") == F.col("big"))
    own = own.withColumn("p", F.pmod(F.xxhash64("s", "node"), F.when(F.col("is_big"), F.col("bigs")).otherwise(F.col("others"))))
    among = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    key = lambda kind, x, y: F.xxhash64(F.lit(kind), "s", x, y)
    with_others = F.transform(among(F.col("others")), lambda q: F.when(F.col("is_big"), key("b", F.col("p"), q)).otherwise(key("o", F.least(F.col("p"), q), F.greatest(F.col("p"), q))))
    with_bigs = F.when(F.col("is_big"), F.array().cast("array<long>")).otherwise(F.transform(among(F.col("bigs")), lambda q: key("b", q, F.col("p"))))
    return own.select(F.explode(F.concat(with_others, with_bigs)).alias("g"), "node", "root")


def similar_forest(nodes: list[int], sets: list[np.ndarray], similarity: float, roots: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Edges between nodes whose sorted sets have this exact Jaccard similarity or more.

    With the links that the nodes of one root have already, their components are those of all such pairs.
    """
    size = np.asarray([len(x) for x in sets], np.int64)
    root = np.asarray(nodes if roots is None else roots, np.int64)
    a, b, rest = [], [], np.arange(len(nodes))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            fits = np.minimum(size[rest], size[p]) >= np.maximum(size[rest], size[p]) * similarity - 1
            some = rest[fits & (size[rest] > 0) & (root[rest] != root[p])]
            if not len(some) or not size[p]:
                continue
            flat = np.concatenate([sets[i] for i in some])
            hit = sets[p][np.minimum(np.searchsorted(sets[p], flat), size[p] - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(size[some]) - size[some], dtype=np.int64)
            found = some[both / (size[some] + size[p] - both) >= similarity]
            a += [nodes[i] for i in found]
            b += [nodes[p]] * len(found)
            queue += found.tolist()
            rest = np.setdiff1d(rest, found, assume_unique=True)
    return a, b


def verified_links(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a, b`` that, with those of equal roots, join whatever pairs of different roots in a group have at this exact similarity or more.

    ``groups`` has ``g, node, root``, ``sets`` has ``node, shingles``. A task holds the sets of one group at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            a, b = similar_forest(list(own), [x for _, x in own.values()], similarity, [r for r, _ in own.values()])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        at, own = None, {}
        for batch in batches:
            shingles = batch.column("shingles")
            flat, ends = shingles.values.to_numpy().view(np.uint64), shingles.offsets.to_numpy()
            for i, (g, node, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "node", "root")), strict=True)):
                if g != at:
                    if len(own) > 1:
                        yield out()
                    at, own = g, {}
                own[node] = root, flat[ends[i] : ends[i + 1]].copy()
        if len(own) > 1:
            yield out()

    rows = groups.join(sets, "node").select("g", "node", "root", "shingles").repartition("g").sortWithinPartitions("g")
    return small_batches(rows).mapInArrow(run, "a long, b long").distinct()


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long, zero for a null text or one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in texts(batch, "text"):
                fps = np.asarray([fingerprint(x, words) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(own).mapInArrow(run, "doc_id long, fp long")


@cache
def codeword_indices() -> np.ndarray:
    """For every word of 23 bits the index, of 12 bits, of the one codeword within three bits."""
    v = np.arange(1 << 23, dtype=np.uint32)

    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> np.uint32(bit) & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
        return x

    errors = np.asarray([sum(1 << b for b in c) for n in range(4) for c in combinations(range(23), n)], np.uint32)
    fix = np.zeros(1 << 11, np.uint32)
    fix[syndrome(errors)] = errors
    out = np.empty(1 << 23, np.uint16)
    for at in range(0, len(v), 1 << 20):
        part = v[at : at + (1 << 20)]
        out[at : at + (1 << 20)] = (part ^ fix[syndrome(part)]) >> 11
    return out


def segment_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """One to six different indices for each word, the other places -1."""
    table = codeword_indices()
    near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(bits, dtype=np.int64))], axis=1)
    found = np.sort(table[near].astype(np.int64), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(words), 6), -1, np.int64)
    rows, _ = np.nonzero(first)
    out[rows, (np.cumsum(first, axis=1) - 1)[first]] = found[first]
    return out


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``fps`` (unsigned), the keys of each, and whether a key is made of its own index."""
    at, words, near = 64, [], []
    for bits in SEGMENTS:
        at -= bits
        words.append((fps >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1))
        near.append(segment_keys(words[-1], bits))
    own = [codeword_indices()[w].astype(np.int64)[:, None] for w in words]
    rows, keys, first = [], [], []

    def add(kind: int, fixed: np.ndarray, s: int) -> None:
        good = near[s] >= 0
        rows.append(np.nonzero(good)[0])
        keys.append((((kind << 22 | fixed) << 12)[:, None] | near[s])[good])
        first.append((near[s] == own[s])[good])

    for kind, (x, y) in enumerate(permutations(range(3), 2)):
        add(kind, words[x], y)
    halves = [(w & 0x3FF, w >> 10) for w in words]
    for i, j in product(range(2), range(2)):
        add(6 + 2 * i + j, halves[1][i] << 11 | halves[2][j], 0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(first)


def block_masks(free: int) -> list[int]:
    """Masks of three out of six about equal blocks of the bits of ``free``."""
    bits = [b for b in range(64) if free >> b & 1]
    blocks = [sum(1 << b for b in bits[i::6]) for i in range(6)]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _spanning(nodes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the sorted nodes that is linked to a smaller one, directly or over others, and the smallest such."""
    label = np.arange(len(nodes))
    while True:
        new = np.where(near, label[None, :], len(nodes)).min(axis=1)
        if (new == label).all():
            break
        label = new
    moved = label < np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    fps = np.unique(fps)
    return _spanning(fps, np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= bits)


def _forests(groups: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x in batch.column("fps"):
                found = _forest(x.values.to_numpy(), bits)
                a.append(found[0])
                b.append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long")


def linked(fps: DataFrame, bits: int = 3, cap: int = 2048) -> DataFrame:
    """Edges ``a, b`` between the distinct values of ``fp`` whose components are those of all links at ``bits`` or fewer.

    ``bits`` may be 0 to 3, what the keys are made for.
    """
    if not 0 <= bits <= 3:
        raise ValueError("links are exact up to three bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                own = batch.column("fp").slice(at, 2000).to_numpy()
                rows, keys, first = golay_keys(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows]), pa.array(first)], ["key", "fp", "own"])

    keys = written(fps.select("fp").where("fp is not null").distinct().mapInArrow(keyed, "key long, fp long, own boolean"), "golay")
    found: DataFrame | None = None
    for level in range(4):
        names = [c for c in keys.columns if c not in ("fp", "own")]
        # Most keys are rare, so a task's partial sums are as many as its rows: a quarter of the keys at a time.
        quarters = [keys.where(F.pmod(F.xxhash64(*names), F.lit(4)) == i) for i in range(4)]
        sizes = [q.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("b"), F.max("fp").alias("a"), F.max("own").alias("own")) for q in quarters]
        sizes = written(reduce(DataFrame.unionByName, sizes).where("n > 1 and own").drop("own"), "sizes")
        pairs = sizes.where(f"n = 2 and bit_count(a ^ b) <= {bits}").select("a", "b")
        most = cap if level < 3 else max(cap, 512)  # nine bits are left free at level 3
        some = keys.join(sizes.where(f"n between 3 and {most}").select(*names), names).groupBy(*names).agg(F.collect_list("fp").alias("fps"))
        new = pairs.unionByName(_forests(some, bits))
        found = new if found is None else found.unionByName(new)
        large = sizes.where(f"n > {most}").select(*names)
        if large.isEmpty():
            break
        keys = written(_refined(keys.join(large, names), level), "blocks")
    return found.distinct()


def _refined(rows: DataFrame, level: int) -> DataFrame:
    """Rows under finer keys: the masks chosen so far, as one number, and the fingerprint's bits under them; any key counts as own."""
    rows = rows.select("fp").distinct().withColumn("masks", F.lit(0)) if level == 0 else rows.select("fp", "masks").distinct()

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, list[int]]] = {}

        def masks(code: int) -> tuple[int, list[int]]:
            if code not in known:
                held, at = 0, []
                c = code
                while c:
                    at.append(c % 21 - 1)
                    c //= 21
                for i in reversed(at):
                    held |= block_masks(~held & (1 << 64) - 1)[i]
                known[code] = held, block_masks(~held & (1 << 64) - 1)
            return known[code]

        for batch in batches:
            fps, codes = batch.column("fp").to_numpy().view(np.uint64), batch.column("masks").to_numpy()
            for code in np.unique(codes).tolist():
                held, more = masks(code)
                own = fps[codes == code]
                for i, m in enumerate(more):
                    part = (own & np.uint64(held | m)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), code * 21 + i + 1, np.int64)), pa.array(part), pa.array(own.view(np.int64))], ["masks", "held", "fp"])

    return rows.select("fp", F.col("masks").cast("long")).mapInArrow(finer, "masks long, held long, fp long").withColumn("own", F.lit(True))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, cap: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest id that links of ``bits`` or fewer can reach.

    Null texts and texts without words have fingerprint zero and are linked like any other. Rows that
    repeat are returned each. A null id is never the smallest; a component of null ids only has a null
    ``component_id``. Other columns are ignored; an empty table gives no rows.
    """
    own = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    least = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(linked(least, bits, cap)).withColumnRenamed("node", "fp")
    least = written(least.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    ids = written(least.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = written(least.join(ids, "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 3, cap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, fp, component_id, first`` for every row, linking texts of this exact Jaccard similarity of their shingles or more.

    Texts with the same set of shingles are one. Candidates are those that share the SimHash of one of
    their samples, and the links of ``bits`` or fewer; every link is verified on the two sets. Two texts at
    a similarity of 0.8 miss each other once in 30,000 times by the samples, however many share one: a
    sample over ``cap`` is compared in parts first, and then across the parts whatever is not linked by then.
    ``first`` marks the row of the smallest id (rows without an id last), and of the smallest ``text_key``
    among those, of each component; rows that repeat id and text are all marked. Nulls, empty texts, repeats
    and other columns are treated as in ``near_duplicates``; hashes of texts and sets have 64 bits.
    """
    own = written(sketches(docs, words, id_col, text_col), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(row).alias("row"), F.min_by(F.struct("fp", "samples"), "text_key").alias("s"))
    least = written(least.select("node", "least", "row", "s.fp", "s.samples"), "distinct")
    firsts = written(least.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    near = linked(firsts.select("fp"), bits).join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    near = near.select("x", "y").unionByName(least.join(firsts, "fp").where("node <> first").select(F.col("node").alias("x"), F.col("first").alias("y")))
    near = near.select(F.xxhash64("x", "y").alias("g"), F.explode(F.array("x", "y")).alias("node")).withColumn("root", F.col("node"))
    shared = shared_samples(least.select("node", "samples"))
    groups = written(part_groups(shared, cap).unionByName(near), "groups")
    keys = written(least.join(groups.select("node").distinct(), "node", "left_semi").select("row.*"), "keys")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    some = broadcast_if_small(keys.select(F.col("doc_id").alias("k"), F.col("text_key").alias("t")))
    text = text.join(some, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_key") == F.col("t")), "left_semi")
    sets = shingle_sets(text, words).dropDuplicates(["node"])
    links = written(verified_links(groups, sets, similarity), "links")
    across = written(rest_groups(shared, components(links), cap), "across")
    if not across.isEmpty():
        links = written(links.unionByName(verified_links(across, sets, similarity)), "links")
    root = components(links)
    least = written(least.select("node", "least", "row").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    ids = written(least.groupBy("root").agg(F.min("least").alias("component_id"), F.min("row").alias("head")), "ids")
    named = written(least.join(ids, "root").select("node", "component_id", "head"), "named")
    out = own.select("doc_id", "text_key", "fp", "node").join(named, "node")
    return out.select("doc_id", "text_key", "fp", "component_id", (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))).alias("first"))
