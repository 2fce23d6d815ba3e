"""The n-gram join, lexical search and fill-in-middle against brute force and round trips."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import fill_in_middle as fim
from quillspan.llm import lexical_search as search
from quillspan.llm import ngram_join as join

EDGES = [None, "", " \t\n", "one", "two words", "a b c d e f g h", "word " * 300, "x" * 30_000, "Ä ö 日本 \x00 \x1c", "same text here", "same text here"]
#: Columns that clash with names the operators use.
MORE = "node long, n int, g string, k string, rare string, item string, rank int, score string, length long, form string, output string"


def docs_of(spark, texts, ids=None):
    rows = [(i, t, *[None] * 11) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {MORE}")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Fill-in-middle


def _middle(doc_id, text):
    """The contract, word for word."""
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    r = random.Random(3)
    passage = " ".join(f"shared{i} passage, of words {i * 7}!" for i in range(60))
    texts = [*EDGES, "a<P>b", "x <S> y", "<M>", "<<S", "end<", "P>x<S", *("".join(r.choices("abcXYZ .,\n1é日<>", k=r.randint(1, 400))) for _ in range(150)), *(f"{'x' * i}{passage}{'é' * i}tail {i}" for i in range(80))]
    docs = docs_of(spark, texts)
    got = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == _middle(x.doc_id, texts[x.doc_id]), x.doc_id
        assert x.back == (texts[x.doc_id] or "")
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    nulls = docs_of(spark, ["some words here", "some words here"], [None, None])
    assert {tuple(x)[1:] for x in fim.transform(nulls).collect()} == {_middle(None, "some words here")}
    assert fim.transform(docs.limit(0)).count() == 0


def test_chunks_are_shared_and_bounded():
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 9)))
    passage = " ".join(word() for _ in range(3000)).encode()
    chunks = fim.Chunks()
    fim.Document(b"head one " + passage, chunks)
    made = chunks.made
    fim.Document(b"another, longer head " + passage + b" and a tail", chunks)
    assert made > 20 and chunks.made - made <= 6  # the passage's inner chunks are the same
    small = fim.Chunks(most=1000)
    fim.Document(passage, small)
    assert small.held <= 1000 and sum(map(len, small.known)) == small.held
    assert all(p == 0 or q - p <= fim.MOST + 3 for p, q in zip([0, *fim.chunk_ends(b"x" * 50_000)], fim.chunk_ends(b"x" * 50_000), strict=False))
    wide = ("é日" * 9000).encode()
    assert all(wide[:e].decode() is not None for e in fim.chunk_ends(wide))


@pytest.mark.parametrize("text", ["y" * 1_500_000, "ab, c日 9" * 150_000])
def test_middle_of_a_very_long_text(text):
    began = time.time()
    for i in range(4):
        n, form, prefix, middle, out = fim.rearranged(text.encode(), i, fim.Chunks())
        assert (n, form, prefix, middle, out.decode()) == _middle(i, text)
    assert time.time() - began < 60


# Ranked lexical search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _ranking(texts, ids, items, k):
    docs = [(i, Counter(_TERM.findall(low(t)))) for i, t in zip(ids, texts, strict=True)]
    docs = [(i, c) for i, c in docs if c]
    n, all_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n // all_terms
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(_TERM.findall(low(text))) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "block", "group_terms"), [(5, 7, 10**6), (50, 4096, 10**6), (3, 40, 20), (1000, 16, 10**6)])
def test_search(spark, k, block, group_terms):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "UPPER"]
    weight = [1 / (i + 1) for i in range(len(words))]
    texts = [*EDGES, *(" ".join(r.choices(words, weight, k=r.choice((1, 3, 8, 30, 200)))) for _ in range(300)), *["w1 w2 w3"] * 20]
    items = [(i, "-".join(r.choices(words, k=r.randint(1, 12)))) for i in range(8)] + [(8, "same text here, one"), (9, ""), (10, None), (11, "unknown"), (12, "w1 w1 W1")]
    docs = docs_of(spark, texts).repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items] + [(0, items[0][1], "again")], "item_id long, text string, doc_id string")
    got = sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in search.search(docs, bench.select("item_id", "text"), k=k, block=block, group_terms=group_terms).collect()), key=str)
    assert got == _ranking(texts, range(len(texts)), items, k)


def test_search_edges(spark):
    items = spark.createDataFrame([(None, "one"), (1, "two words"), (1, "same text")], "item_id int, text string")
    got = search.search(docs_of(spark, [*EDGES, "one", "one"], [*range(len(EDGES)), None, 3]), items).collect()
    assert [(x["rank"], x.doc_id) for x in sorted(got, key=lambda x: x["rank"]) if x.item_id is None] == [(1, 3), (2, 3), (3, None)]
    assert sorted((x["rank"], x.doc_id) for x in got if x.item_id == 1) == [(1, 4), (1, 9), (2, 10)]
    docs = docs_of(spark, EDGES)
    assert search.search(docs.limit(0), items).count() == 0 and search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.where("text is null"), items).count() == 0
    long = docs_of(spark, ["needle " + "hay " * 300_000, "hay"])
    began = time.time()
    assert [x.doc_id for x in search.search(long, spark.createDataFrame([(1, "needle")], "item_id int, text string")).collect()] == [0]
    assert time.time() - began < 60


def test_pair_bounds_hold_and_tighten():
    r = np.random.default_rng(2)
    for _ in range(50):
        terms = {t: (np.flatnonzero(d := r.random(40) < 0.3), r.integers(1, 100, int(d.sum()))) for t in range(4)}
        terms = {t: v for t, v in terms.items() if len(v[0])}
        joint = {}
        for a in terms:
            for b in terms:
                both = set(terms[a][0]) & set(terms[b][0])
                if a < b and both:
                    joint[a, b] = max(terms[a][1][list(terms[a][0]).index(x)] + terms[b][1][list(terms[b][0]).index(x)] for x in both)
        block = search.Block(np.arange(40), terms, joint)
        score = np.zeros(40, int)
        for at, v in terms.values():
            score[at] += v
        for units in ([(0, 1), (2, 3)], [(0,), (1, 2), (3,)]):
            assert sum(block.bound(u) for u in units) >= score.max()
            assert all(block.bound(u) <= sum(block.most.get(t, 0) for t in u) for u in units)
            floor = int(np.sort(score)[-5])
            at, found = block.best(units, floor, 5)
            assert sorted(found.tolist(), reverse=True)[:5] == sorted(score.tolist(), reverse=True)[:5] and (score[at] == found).all()


# N-gram Jaccard join


def _sets(texts, words=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        out.append({" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {" ".join(w)} if w else set())
    return out


def _classes(texts, ids, num=4, den=5):
    sets, root = _sets(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), math.inf), math.inf if d is None else d)
    return sorted(((d, len(sets[i]), None if least[find(i)] == math.inf else least[find(i)]) for i, d in enumerate(ids)), key=str)


def _near(r, base, edits):
    out = list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize(("num", "den"), [(4, 5), (1, 2)])
def test_ngram_join(spark, num, den):
    r = random.Random(7)
    texts = list(EDGES)
    for family in range(12):
        base = [f"f{family}w{r.randrange(500)}" for _ in range(r.choice((6, 12, 40, 150)))]
        texts += [" ".join(_near(r, base, r.choice((0, 0, 1, 2, 3, 5)))) for _ in range(12)]
    shared = " ".join(f"license{i}" for i in range(60))
    texts += [f"{shared} " + " ".join(f"own{i}x{k}" for k in range(r.choice((3, 8, 40)))) for i in range(60)]
    texts += [" ".join(r.choices("abc", k=r.randint(5, 9))) for _ in range(80)]  # many small sets of few common shingles
    ids = list(range(len(texts)))
    got = join.linked_documents(docs_of(spark, texts, ids).repartition(3), num=num, den=den).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == _classes(texts, ids, num, den)


def test_ngram_join_large_groups(spark):
    """Near copies whose members differ so much that not all link to one leader, and exact copies beside them."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(_near(r, base, r.choice((1, 2, 3, 4)))) for _ in range(220)] + [" ".join(base)] * 150
    ids = list(range(len(texts)))
    got = join.linked_documents(docs_of(spark, texts, ids)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == _classes(texts, ids)


def test_ngram_join_edges(spark):
    texts = ["a b c d e f", "A b C d e f", "a b c d e f", "x y", None, "", "x  y", "q"]
    ids = [5, None, 3, 9, 8, None, None, None]
    got = join.linked_documents(docs_of(spark, texts, ids)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == _classes(texts, ids)
    docs = docs_of(spark, EDGES)
    assert join.linked_documents(docs.limit(0)).count() == 0
    assert {x.component_id for x in join.linked_documents(docs.where("doc_id < 3")).collect()} == {0, 1, 2}
    long = [f"w{i}" for i in range(150_000)]
    texts = [" ".join(long), " ".join([*long[:75_000], "other", *long[75_000:]])]
    began = time.time()
    assert {x.component_id for x in join.linked_documents(docs_of(spark, texts)).collect()} == {0}
    assert time.time() - began < 120


def _shuffled(spark):
    """Records shuffled by each stage so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_ngram_join_shuffles_given_shingles_once(spark):
    """Disk: no shingle is shuffled to be counted and again to be joined, and what counting shuffled doesn't stay."""
    texts = [" ".join(f"d{i}w{k}" for k in range(500)) for i in range(40)] + [" ".join(f"d{i}w{k}" for k in range(20, 500)) for i in range(3)]
    sets = join.written(join.document_sets(docs_of(spark, texts).repartition(2), 5, 4, 5, "doc_id", "text"), "sets")
    given = sets.where("g is not null").agg(F.sum(F.size("g"))).first()[0]
    before, files = _shuffled(spark), _shuffle_files(spark)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of a real size
    try:
        rows = join.written(join.prefixes(sets, 4, 5), "prefixes")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert sum(n for s, n in _shuffled(spark).items() if s not in before) < 1.5 * given
    kept, until = lambda: {f.split("_")[1] for f in _shuffle_files(spark) - files}, time.time() + 20
    while len(kept()) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(kept()) <= 1  # the shuffle of the table just written
    assert rows.select("node").distinct().count() == 6


def test_ngram_join_copies_in_several_tasks_share_nothing(spark):
    """Sets that several tasks give are one node: their shingles aren't shared by that."""
    texts = [" ".join(f"c{i}w{k}" for k in range(60)) for i in range(3)] * 8 + [" ".join(f"c0w{k}" for k in range(3, 60))]
    docs = docs_of(spark, texts).repartition(6)
    sets = join.written(join.document_sets(docs, 5, 4, 5, "doc_id", "text"), "sets")
    assert sets.where("g is not null").count() > 4
    assert join.prefixes(sets, 4, 5).select("node").distinct().count() == 2
    got = join.linked_documents(docs).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == _classes(texts, range(len(texts)))
