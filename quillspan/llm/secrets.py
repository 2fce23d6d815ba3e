"""Secret scans: candidates of high recall, and a random forest that removes the false positives.

A candidate is a run of 12 key characters or more that has a digit, an inner capital or an assignment, any run
of 6 or more that is assigned to a word such as password, and any known format. The forest sees its length, its character transitions (mean and lowest log probability of a letter after another,
counted on all texts, and changes of character class), its dictionary coverage (the share of its letters
in pieces of four letters that are frequent in all texts' words), its path, and its neighbouring words.

It is trained from labelled findings: those a caller hands in, or those that a list of known formats and
known harmless forms labels. Everything between the two is left to the forest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import mixed_bits, small_batches, texts, written
from quillspan.llm.trees import Forest, random_forest

# Public formats of credentials, and words that stand before one.
KNOWN = (
    rb"(?:AKIA|ASIA)[A-Z0-9]{16}",
    rb"gh[pousr]_[A-Za-z0-9]{36}",
    rb"glpat-[A-Za-z0-9_-]{20}",
    rb"xox[abprs]-[A-Za-z0-9-]{10,}",
    rb"sk_(?:live|test)_[A-Za-z0-9]{16,}",
    rb"AIza[A-Za-z0-9_-]{35}",
    rb"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
)
CUES = (b"password", b"passwd", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"access_key", b"auth", b"bearer", b"credential", b"private_key")
_KNOWN = re.compile(b"|".join(b"(?:" + k + b")" for k in KNOWN)).fullmatch
_KNOWN_IN = re.compile(b"|".join(KNOWN)).search
_CUE = re.compile(b"(?i)" + b"|".join(CUES)).search
_ODD = re.compile(rb"[0-9]|[a-z][A-Z]|[A-Za-z][=:]").search
_CORE = re.compile(rb"[A-Za-z0-9+/_.~-]{6,}={0,2}").finditer
_ASSIGNS = re.compile(rb"[=:]\W*$").search
_HARMLESS = re.compile(rb"[0-9.,:/+()-]+|[^@]*@.*|(?i:https?:|www\.).*|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[A-Za-z]+[.,;:]?|[A-Za-z]{3,}(?:[./_-][A-Za-z0-9]{1,12})+").fullmatch
_HEX = re.compile(rb"[0-9a-fA-F]+").fullmatch
_TEST = re.compile(r"(?i)test|example|sample|doc|mock").search

#: Letters of the transition model: a to z without case, digits as one, all else as one.
_CLASS = np.full(256, 27, np.int64)
_CLASS[65:91] = _CLASS[97:123] = np.arange(26)
_CLASS[48:58] = 26
N_CLASSES, PIECE = 28, 4
N_FEATURES = 18


@dataclass
class Finding:
    start: int
    end: int
    text: bytes
    before: list[bytes]
    after: bytes
    lead: bytes
    tail: bytes


def findings(text: bytes) -> Iterator[Finding]:
    """Candidates in order, in byte offsets."""
    words, at, low = text.split(), 0, text.lower()
    cued: set[int] = set()
    if any(c in low for c in CUES):
        cued = {i + k for i, w in enumerate(words) if _CUE(w) for k in range(3)}
    for i, w in enumerate(words):
        long = len(w) >= 12 and (_ODD(w) or _KNOWN_IN(w))
        if not long and not (i in cued and len(w) >= 6):
            continue
        at = _find(text, words, i, at)
        for m in _CORE(w):
            core, lead = m.group(), w[: m.start()]
            odd = long and len(core) >= 12 and (re.search(rb"[0-9]|[a-z][A-Z]", core) or re.search(rb"[=:]", lead) or _KNOWN(core))
            near = b" ".join([*words[max(0, i - 2) : i], lead])
            if odd or i in cued and _CUE(near) and _ASSIGNS(near):
                yield Finding(at + m.start(), at + m.end(), core, words[max(0, i - 3) : i], words[i + 1] if i + 1 < len(words) else b"", lead, w[m.end() :])
        at += len(w)


def _find(text: bytes, words: list[bytes], i: int, at: int) -> int:
    """The place of word ``i`` from ``at`` on, where it stands between white space."""
    w = words[i]
    while True:
        at = text.find(w, at)
        if (at == 0 or text[at - 1 : at].isspace()) and (at + len(w) == len(text) or text[at + len(w) : at + len(w) + 1].isspace()):
            return at
        at += 1


def known_label(f: Finding) -> int | None:
    """1 for a known format or a random value that is assigned to a cue, 0 for a known harmless form, else None."""
    if _KNOWN(f.text):
        return 1
    near = b" ".join([*f.before[-2:], f.lead])
    assigned = _CUE(near) and _ASSIGNS(near)
    if not assigned and (_HARMLESS(f.text) or b"@" in f.tail[:1] + f.lead[-1:]):
        return 0
    if assigned and len(set(f.text)) >= min(8, len(f.text) - 2) and re.search(rb"[0-9]", f.text):
        return 1
    return None


@dataclass
class Language:
    transitions: np.ndarray
    frequent: np.ndarray


def features(f: Finding, path: str, language: Language) -> list[float]:
    t, c = f.text, _CLASS[np.frombuffer(f.text, np.uint8)]
    steps = language.transitions[c[:-1], c[1:]]
    pieces = ((c[:-3] * N_CLASSES + c[1:-2]) * N_CLASSES + c[2:-1]) * N_CLASSES + c[3:]
    covered = np.zeros(len(c), bool)
    for k in range(PIECE):
        covered[k : len(c) - PIECE + 1 + k] |= language.frequent[pieces]
    n = len(t)
    digit = c == 26
    upper = sum(65 <= x < 91 for x in t)
    changes = int((digit[1:] != digit[:-1]).sum()) + int(sum(a.isupper() != b.isupper() for a, b in zip(t.decode("latin-1"), t.decode("latin-1")[1:], strict=False)))
    near = b" ".join(f.before).lower()
    return [
        float(n), digit.mean(), upper / n, float(steps.mean()), float(steps.min()), changes / n, covered.mean(), float(bool(_HEX(t))), len(set(t)) / n,
        float(bool(_CUE(f.lead))), float(bool(_CUE(near))), float(f.lead.endswith((b"=", b":", b'"', b"'"))), float(bool(re.search(rb"[=:]\W*$", f.lead + near[-3:]))),
        float(f.tail[:1] in (b'"', b"'")), float(b"@" in f.lead + f.tail), float(len(path)), float(bool(_TEST(path))), float(f.after[:1].isalpha()),
    ]


def language(docs: DataFrame, text_col: str = "text", least: float = 2e-6) -> Language:
    """Letter transitions and frequent word pieces of all texts; a piece is frequent from a share of ``least`` on."""
    size = N_CLASSES**PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, found in texts(batch, "text"):
                c = _CLASS[np.frombuffer(b"   ".join([*found, b"", b""]), np.uint8)]
                total += np.bincount(((c[:-3] * N_CLASSES + c[1:-2]) * N_CLASSES + c[2:-1]) * N_CLASSES + c[3:], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["piece", "n"])

    counted = small_batches(docs.select(F.col(text_col).alias("text"))).mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(size)
    n[counted["piece"].to_numpy(int)] = counted["n"].to_numpy(float)
    cube = n.reshape([N_CLASSES] * 4)
    two = cube.sum(axis=(2, 3)) + 1
    letters = np.indices([N_CLASSES] * 4).max(axis=0) < 26
    return Language(np.log(two / two.sum(axis=1, keepdims=True)), (n >= max(2.0, least * n.sum())) & letters.ravel())


def labelled_findings(docs: DataFrame, model: Language, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``y, x``: features of at most ``fit_rows`` findings of either label that the known forms decide, chosen by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in texts(batch, "text"):
                rows = [(y, features(f, path or "", model)) for path, text in zip(part.column("path").to_pylist(), found, strict=True) for f in findings(text) if (y := known_label(f)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], ["y", "x"])

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = written(docs.select(path.alias("path"), F.col(text_col).alias("text")).mapInArrow(run, "y int, x array<double>"), "findings")
    some = [rows.where(F.col("y") == y).orderBy(mixed_bits(F.to_json(F.struct("x")), seed=7), "x").limit(fit_rows) for y in (0, 1)]
    return some[0].unionByName(some[1])


def fit(labelled: DataFrame, trees: int = 60, depth: int = 6) -> Forest:
    """The forest from ``y, x``; without findings of both labels it is constant."""
    seen = labelled.toPandas()
    return random_forest(np.asarray(seen["x"].tolist(), float).reshape(len(seen), N_FEATURES), seen["y"].to_numpy(float), trees, depth)


def scan(docs: DataFrame, model: Language, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``doc_id, start, end, score, secret``: a row for each candidate of each row, in code points, end exclusive.

    Null and empty texts have no candidates; a null path is empty. Repeated rows give repeated findings,
    null ids stay null, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in texts(batch, "text"):
                ids, starts, ends, xs = [], [], [], []
                for doc_id, path, text in zip(part.column("doc_id").to_pylist(), part.column("path").to_pylist(), found, strict=True):
                    byte = point = 0
                    for f in findings(text):
                        point += len(text[byte : f.start].decode("utf-8", "replace"))
                        byte = f.start
                        ids.append(doc_id)
                        starts.append(point)
                        ends.append(point + f.end - f.start)  # candidates are ASCII
                        xs.append(features(f, path or "", model))
                score = np.clip(forest.sums(np.asarray(xs, float).reshape(len(xs), N_FEATURES)), 0, 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(score)], ["doc_id", "start", "end", "score"])

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, score double").withColumn("secret", F.col("score") >= threshold)
