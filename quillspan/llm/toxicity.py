"""Toxicity of deobfuscated text, as a noisy channel.

A character language model (trigrams, mixed with bigrams and single letters) is counted on all documents.
A token that may be disguised - digits or signs among letters, a letter three times in a row, signs
between letters, or a run of single letters - becomes a lattice: each character can stand for itself, for
the letters it resembles, or for nothing (a sign, a gap, one more of the same letter), at the channel's
cost. Viterbi decoding finds the likeliest restored text under the model; it is exact, as the state is the
last two letters and no state is dropped. All other tokens have a lattice with one path and are restored as
they are.

The restored text is scored by terms (words, and stems of four to six letters) that labelled rows show to
be toxic. Boosted trees weigh how strong, how many and how frequent the terms found are; they are fitted on
halves of the labelled rows, each with the terms of the other half. A toxic row whose strongest term is stronger
than those of all clean rows counts once more with this term alone, so that one mention of it is enough.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.quality_model import labelled_rows
from quillspan.llm.shared import remainder, small_batches, texts, written
from quillspan.llm.trees import Forest, boosted

#: Letters of the model: a gap, any other sign, a to z, and the small letters of Latin-1.
ALPHABET = " ?" + "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = len(ALPHABET)
_CODE = np.ones(0x250, np.int32)
for _i, _c in enumerate(ALPHABET):
    if _c != "?":
        _CODE[ord(_c)] = _i
for _c in "\t\n\x0b\x0c\r":
    _CODE[ord(_c)] = 0

#: What a sign may stand for.
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SIGNS = " .-_*~'`·:,;/\\^=#%&\"<>[]{})?"
COST = {"same": 0.0, "resembles": 1.0, "nothing": 0.7, "again": 1.5}


def codes(text: str) -> np.ndarray:
    found = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _CODE[np.minimum(found, len(_CODE) - 1)]


def _grams(c: np.ndarray) -> np.ndarray:
    """The trigrams of letter numbers, without those that touch two or more single letters in a row: these may be spaced-out words."""
    grams = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
    single = (c[:-2] == 0) & (c[1:-1] != 0) & (c[2:] == 0)
    run = np.zeros(len(single) + 4, bool)
    two = single[:-2] & single[2:]
    for k in range(5):  # the letters of the two, and the gaps around them
        run[k : k + len(two)] |= two
    return grams[~run[1 : 1 + len(grams)]]


def letter_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram, n``: the trigrams of all texts, as numbers in base ``len(ALPHABET)``; at most its cube of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for _, found in texts(batch, "text"):
                total += np.bincount(_grams(codes(b"  ".join([b"", *found, b""]).decode("utf-8", "replace").lower())), minlength=SIZE**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    return small_batches(docs.select(F.col(text_col).alias("text"))).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Log probability of a letter after two others, as a cube; uniform if nothing was counted."""
    seen = counts.toPandas()  # at most len(ALPHABET) ** 3 rows
    n = np.zeros(SIZE**3)
    n[seen["gram"].to_numpy(int)] = seen["n"].to_numpy(float)
    n = n.reshape(SIZE, SIZE, SIZE)
    one = n.sum(axis=(0, 1)) + 1
    two = n.sum(axis=0)
    one = one / one.sum()
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(three).astype(np.float32)


def with_words(model: np.ndarray, words: list[str], share: float = 0.2) -> np.ndarray:
    """The letter model mixed with that of some words, so that these are decoded more readily."""
    n = np.zeros((SIZE, SIZE, SIZE))
    for w in words:
        c = codes(f"  {w}  ")
        np.add.at(n, (c[:-2], c[1:-1], c[2:]), 1)
    total = n.sum(axis=2, keepdims=True)
    return np.where(total > 0, np.log((1 - share) * np.exp(model) + share * n / np.maximum(total, 1)), model).astype(np.float32)


class _Arcs(dict):
    """What a character may stand for, and at which cost, by the character and whether it repeats the one before; an empty text stands for nothing.

    In a spaced-out run every letter is followed by a gap, so a gap there is most likely none.
    """

    def __init__(self, spaced: bool):
        self.spaced = spaced

    def __missing__(self, key: tuple[str, bool]) -> list[tuple[str, int, float]]:
        if len(self) >= 100_000:
            self.clear()
        c, again = key
        if c.isalpha():
            arcs = [(c, COST["same"])]
            if again:
                arcs.append(("", COST["again"] + 1.5))
        else:
            arcs = [(x, COST["resembles"]) for x in RESEMBLES.get(c, "")]
            if c.isspace():
                arcs += [("", 0.2), (" ", 1.8)] if self.spaced else [("", COST["nothing"] + 1.5), (" ", COST["same"])]
            elif c in SIGNS:
                arcs.append(("", COST["nothing"] + 1.5))
            else:
                arcs += [("", 3.5), (c, 3.0)]
        self[key] = found = [(out, int(_CODE[min(ord(out), len(_CODE) - 1)]) if out else -1, cost) for out, cost in arcs]
        return found


_ARCS = {spaced: _Arcs(spaced) for spaced in (False, True)}


def _step(score: np.ndarray, arcs: list[tuple[str, int, float]], model: np.ndarray) -> tuple[np.ndarray, dict]:
    """The scores after one more character, and by each new letter what it stands for, the letter two before, and whether it was taken."""
    new = score - min((cost for out, _, cost in arcs if not out), default=np.inf)
    took: dict[int, tuple[str | np.ndarray, np.ndarray, np.ndarray]] = {}
    for out, k, cost in arcs:
        if out:
            value = score + model[:, :, k] - cost
            first = value.argmax(axis=0).astype(np.uint8)
            best = value[first, np.arange(len(first))]
            better = best > new[:, k]
            if k in took:  # two signs of one number: the better of the two
                prior = took[k]
                took[k] = (np.where(better, out, prior[0]), np.where(better, first, prior[1]), better | prior[2])
            else:
                took[k] = (out, first, better)
            new[:, k] = np.where(better, best, new[:, k])
    return new, took


#: Steps after which what paths say so far is no longer held letter by letter.
_HELD = 8192


def decode(token: str, model: np.ndarray, spaced: bool = False, few: int = 40) -> str:
    """The likeliest restored text of a lower-case token or run of letters, of any length.

    Exact: the state is the last two letters, of which there are at most ``SIZE`` squared, and all are kept.
    Steps over ``few`` states or less are done one by one, the rest on the matrix of all. Two letters that can
    only stand for themselves leave one state, and what led there is written out. Between such places scores are
    kept at about the square root of the token's length of steps, and the steps from one to the next are done
    again on the way back, so memory grows with that root and not with the token.
    """
    table, n = _ARCS[spaced], len(token)
    arcs_at = lambda i: table[token[i], i > 0 and token[i] == token[i - 1]]
    apart = max(1024, 4 * math.isqrt(n))
    done: list[str] = []
    used: list[int] = []  # the matrix is of those letters only that the token may give
    # A path's text is held as its last letter and the path before, so a step takes the same time at any length.
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    at = since = 0
    while at < n:
        while at < n and len(paths) <= few and at - since < _HELD:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in paths.items():
                for out, k, cost in arcs_at(at):
                    if out:
                        state, value, held = (b, k), score + float(model[a, b, k]) - cost, (out, path)
                    else:
                        state, value, held = (a, b), score - cost, path
                    if state not in new or value > new[state][0]:
                        new[state] = (value, held)
            paths, at = new, at + 1
            if len(paths) == 1:
                ((state, (value, path)),) = paths.items()
                done.append(_letters(path))
                paths, since = {state: (value, None)}, at
        if at == n:
            path = max(((v + float(model[a, b, 0]), path) for (a, b), (v, path) in paths.items()), key=lambda x: x[0])[1]
            return "".join([*done, _letters(path)])

        if not used:
            narrow = {(c, again): table[c, again] for c in set(token) for again in (False, True)}
            used = sorted({0, *(k for arcs in narrow.values() for _, k, _ in arcs if k >= 0)})
            place = {k: i for i, k in enumerate(used)}
            small = np.ascontiguousarray(model[np.ix_(used, used, used)])
            narrow = {key: [(out, place.get(k, -1), cost) for out, k, cost in arcs] for key, arcs in narrow.items()}
            arcs_of = lambda i: narrow[token[i], i > 0 and token[i] == token[i - 1]]  # noqa: B023, E731
        score = np.full((len(used), len(used)), -np.inf)
        for (a, b), (v, _) in paths.items():
            score[place[a], place[b]] = v
        begin, kept, alone = at, [], 0
        while at < n and alone < 2:
            if (at - begin) % apart == 0:
                kept.append(score)
            arcs = arcs_of(at)
            if len(arcs) > 1 or arcs[0][0]:  # a sign that can only be nothing leaves all states as they are
                alone = alone + 1 if len(arcs) == 1 else 0
            score, _ = _step(score, arcs, small)
            at += 1
        a, b = map(int, np.unravel_index(int((score + small[:, :, 0] if at == n else score).argmax()), score.shape))
        value, state = float(score[a, b]), (used[a], used[b])
        parts: list[str] = []
        for block in range(len(kept) - 1, -1, -1):
            first, back, now = begin + block * apart, [], kept[block]
            for i in range(first, min(at, first + apart)):
                now, took = _step(now, arcs_of(i), small)
                back.append(took)
            found: list[str] = []
            for took in reversed(back):
                if b in took and took[b][2][a]:
                    out, letter, _ = took[b]
                    found.append(out if isinstance(out, str) else str(out[a]))
                    a, b = int(letter[a]), a
            parts.append("".join(reversed(found)))
        done += [_letters(paths[used[a], used[b]][1]), *reversed(parts)]
        paths, since = {state: (value, None)}, at
    return "".join(done)


def _letters(path: tuple | None) -> str:
    """The letters of a path."""
    found = []
    while path:
        found.append(path[0])
        path = path[1]
    return "".join(reversed(found))


def _single(word: bytes) -> bool:
    """Whether UTF-8 bytes are one code point."""
    return len(word) == 1 or 1 < len(word) <= 4 and word[0] >= 0xC0 and len(word.decode("utf-8", "replace")) == 1


#: Two or more signs in a row: where words that are joined without blanks may end.
_GAPS = re.compile("[" + re.escape(SIGNS) + "]{2,}")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_EDGE = b".,;:!?\"'()[]{}|%&#*$<>-_~/"
#: Signs at a token's ends that may stand for letters, and those that may not.
_EDGE_LETTERS = "".join(c for c in RESEMBLES if c in _EDGE.decode())
_OUTER = "".join(c for c in _EDGE.decode() if c not in RESEMBLES)
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")


class _Filled(dict):
    """A bounded table that makes what it lacks."""

    def __init__(self, make, keep: int = 100_000):
        self.make, self.keep = make, keep

    def __missing__(self, key):
        if len(self) >= self.keep:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Restorer:
    """Restored words of texts; ``take`` makes of a token's words what is kept for it in a bounded table."""

    def __init__(self, model: np.ndarray, take=lambda words: words):
        self.model, self.take = model, take
        self.known = _Filled(lambda token: take(self._token(token)))

    def _token(self, token: bytes) -> tuple[str, ...]:
        core = token.strip(_EDGE)
        if core.isalpha():
            text = core.lower().decode()
        else:
            text = core.decode("utf-8", "replace").lower()
        if text.isalpha():
            words: tuple[str, ...] = (text,)
        else:
            words = tuple(_LETTERS.findall(text))
            full = token.decode("utf-8", "replace").lower().rstrip(".,;:?")
            if _LETTER.search(full):
                inner = full.strip("%&#*$!|<>\"'()[]{}")
                for x in {full.rstrip("!"), inner}:
                    if x and not x.isalpha() and _LETTER.search(x):
                        words += tuple(decode(x, self.model).split())
                pieces = _GAPS.split(full)
                if len(pieces) > 1:
                    words += tuple(w for x in pieces if x and not x.isalpha() and _LETTER.search(x) for w in decode(x, self.model).split())
        if _THRICE.search(text):
            words += (decode(text, self.model),)
        outer = token.decode("utf-8", "replace").lower().strip(_OUTER)
        if outer and (outer[0] in _EDGE_LETTERS or outer[-1] in _EDGE_LETTERS) and _LETTER.search(outer):
            for x in {outer, outer.rstrip("!")}:
                if not x.isalpha():
                    words += tuple(decode(x, self.model).split())
        return words

    def runs(self, words: list[bytes]) -> Iterator[str]:
        """Restored texts of runs of three or more single characters; a character more than twice in a row is two."""
        at = [i for i, w in enumerate(words) if _single(w)]
        start = 0
        for j in range(1, len(at) + 1):
            if j == len(at) or at[j] != at[j - 1] + 1:
                if j - start >= 3:
                    run = b"".join(words[at[start] : at[j - 1] + 1]).decode("utf-8", "replace").lower()
                    run = re.sub(r"(.)\1{2,}", r"\1\1", run)
                    if len(set(run)) > 2:
                        yield decode(" ".join(run), self.model, spaced=True)
                start = j

    def found(self, own: list[bytes]) -> Iterator:
        """What is kept for the distinct tokens and for the restored runs, where there is something."""
        yield from filter(None, map(self.known.__getitem__, set(own)))
        for run in self.runs(own):
            if kept := self.take(tuple(run.split())):
                yield kept


def terms(word: str) -> list[str]:
    """A word, and its stems marked by a dash."""
    return [word, *(word[:k] + "-" for k in (4, 5, 6) if len(word) >= k)]


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float]
    trees: Forest


class Scorer:
    """Features of texts from the toxic terms that their restored words have."""

    def __init__(self, letters: np.ndarray, weights: dict[str, float]):
        def hits(words: tuple[str, ...]) -> tuple[tuple[str, float], ...]:
            return tuple((w, max(weights[t] for t in own)) for w in words if (own := [t for t in terms(w) if t in weights]))

        self.restorer = Restorer(with_words(letters, [t for t in weights if not t.endswith("-")]), hits)

    def features(self, text: bytes) -> list[float]:
        own = text.split()
        seen = {w: v for kept in self.restorer.found(own) for w, v in kept}
        top = [*sorted(seen.values(), reverse=True)[:3], 0.0, 0.0, 0.0][:3]
        times = sum(1 for t in own if any(w in seen for w, _ in self.restorer.known[t])) if seen else 0
        return [*top, sum(seen.values()), float(len(seen)), float(times), times / max(1, len(own))]


#: MinHashes by which near copies among labelled rows are found; two texts at a similarity of 0.5 share none once in 64 times.
FAMILIES = 6


def _families(rows: DataFrame) -> DataFrame:
    """Adds ``m``, MinHashes of three-word shingles, which near copies share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part, found in texts(batch, "text"):
                least = []
                for text in found:
                    w = text.lower().split()
                    grams = [b" ".join(x) for x in zip(w, w[1:], w[2:], strict=False)] or [b" ".join(w)]
                    least.append([min(xxhash.xxh64_intdigest(g, seed) for g in grams) - (1 << 63) for seed in range(FAMILIES)])
                yield pa.RecordBatch.from_arrays([part.column("text"), part.column("y"), pa.array(least, pa.list_(pa.int64()))], ["text", "y", "m"])

    return rows.mapInArrow(run, "text string, y int, m array<long>")


def _weights(counted: list, halves: tuple[int, ...]) -> dict[str, float]:
    """Log odds of the terms that are far more often in toxic texts of these halves than chance."""
    total = {r["half"]: r for r in counted if r["term"] == "" and r["half"] in halves}
    tox, n = sum(r["tox"] for r in total.values()), sum(r["n"] for r in total.values())
    if not 0 < tox < n:
        return {}
    sums: dict[str, list[int]] = {}
    for r in counted:
        if r["half"] in halves and r["term"]:
            one = sums.setdefault(r["term"], [0, 0])
            one[0] += r["tox"]
            one[1] += r["n"]
    rate = tox / n
    strong = {t: (a, m) for t, (a, m) in sums.items() if a >= 4 and (a - m * rate) / math.sqrt(m * rate * (1 - rate)) >= 5}
    return {t: math.log((a + 0.5) / (m - a + 0.5) * (1 - rate) / rate) for t, (a, m) in strong.items()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, fit_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The letter model of all documents; toxic terms and trees from at most ``fit_rows`` labelled ones.

    Near copies among the labelled rows count once, so that a text copied often is no evidence for its
    rare words. No labels, or labels of one class only, give a model of one score.
    """
    letters = language_model(letter_counts(docs, text_col))
    rows = _families(labelled_rows(docs, labels, label, folds, held_out, fit_rows, id_col, text_col))
    # Of texts of one label that share a hash the smallest stays, so the same one in every run.
    for i in range(FAMILIES):
        rows = rows.groupBy("y", F.col("m")[i].alias("key")).agg(F.min(F.struct("text", "m")).alias("r")).select("r.text", "y", "r.m")
    rows = written(rows.select("text", "y", F.pmod(F.col("m")[0], F.lit(2)).cast("int").alias("half")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tox, every = Restorer(letters), Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(every)
            cols = [pa.array([t for t, _ in keys], pa.string()), pa.array([h for _, h in keys], pa.int32())]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array([c[k] for k in keys], pa.int64()) for c in (tox, every))], ["term", "half", "tox", "n"])

        for batch in batches:
            for part, found in texts(batch, "text"):
                for y, half, text in zip(part.column("y").to_pylist(), part.column("half").to_pylist(), found, strict=True):
                    seen = {(t, half) for words in own.found(text.split()) for w in words for t in terms(w)} | {("", half)}
                    every.update(seen)
                    if y:
                        tox.update(seen)
                if len(every) > 100_000:
                    yield out()
                    tox.clear()
                    every.clear()
        yield out()

    counted = rows.select("text", "y", "half").mapInArrow(count, "term string, half int, tox long, n long").groupBy("term", "half").agg(F.sum("tox").alias("tox"), F.sum("n").alias("n"))
    both = counted.groupBy("term").agg(F.sum("tox").alias("t"), F.sum("n").alias("m")).where("term = '' or t >= 4 and 3 * t >= m")
    counted = counted.join(both.select("term"), "term").collect()  # terms of the bounded sample that lean to toxic
    crossed = [_weights(counted, (1,)), _weights(counted, (0,))]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(letters, w) for w in crossed]
        for batch in batches:
            for part, found in texts(batch, "text"):
                x = [scorers[h].features(t) for h, t in zip(part.column("half").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    seen = rows.select("text", "y", "half").mapInArrow(look, "y int, x array<double>").toPandas().sort_values(["y", "x"], key=lambda c: c.map(lambda v: v if isinstance(v, int) else tuple(v)))
    x, y = np.asarray(seen["x"].tolist(), float).reshape(len(seen), 7), seen["y"].to_numpy(float)
    clean = x[y == 0, 0].max() if (y == 0).any() else 0.0
    alone = x[(y == 1) & (x[:, 0] > clean)]
    alone = np.column_stack([alone[:, 0], 0 * alone[:, :2], alone[:, 0], np.ones((len(alone), 2)), alone[:, 6] / np.maximum(alone[:, 5], 1)])
    return Model(letters, _weights(counted, (0, 1)), boosted(np.concatenate([x, alone]), np.concatenate([y, np.ones(len(alone))]), trees=40, depth=3))


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column, from 0 to 1; null texts score as empty."""
    held: list[Scorer] = []

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(model.letters, model.weights))
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        x = [held[0].features(t) for _, part in texts(batch, "text") for t in part]
        return pa.array(model.trees.probability(np.asarray(x, float).reshape(len(x), 7)))

    return scores(text)


def score(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Null texts count as empty and are scored like any other. Null ids belong to the fold of an empty
    text. Repeated rows are scored each for itself; other columns are no inputs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, folds) == held_out).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
