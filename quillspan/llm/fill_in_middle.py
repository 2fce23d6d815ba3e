"""Fill-in-middle transformation by content-defined chunk memoization.

A rolling hash of the last 32 bytes cuts a text into chunks, so passages that many texts share give the same
chunks wherever they stand. A chunk's boundary summary - its tokens, its code points, and whether a letter
stands first and last - is computed once and kept in a bounded cache, found by the chunk's whole content. Two
neighbours whose run of letters goes on over the cut share one token, so the counts of all chunks add up to those
of the text, and a prefix sum of them finds the chunk in which a cut falls; only this chunk is looked at again.

Tokens are runs of ASCII letters and every other code point by itself. Texts are whole, and any length will do:
the hash is computed in blocks, and a stretch without a cut is cut every ``MOST`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import small_batches, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a chunk, on average (a power of two) and at most; bytes of content that a task's cache holds.
AVERAGE, MOST, CACHE = 256, 8192, 32 << 20
_BLOCK = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: A number for each byte, from a multiplicative mix of its value.
_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """For every byte a hash of the last 32: the sum of their numbers, each shifted by its distance."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def chunk_ends(text: bytes) -> list[int]:
    """Where the chunks of UTF-8 bytes end, between code points; the last end is the text's."""
    data, found = np.frombuffer(text, np.uint8), []
    for at in range(0, len(data), _BLOCK):
        first = max(0, at - 31)
        h = rolling(data[first : at + _BLOCK])[at - first :]
        found.append(np.flatnonzero(h < np.uint32((1 << 32) // AVERAGE)) + at + 1)
    ends, last = [], 0
    for end in [*(np.concatenate(found).tolist() if found else []), len(text)]:
        while last + MOST < end:
            last = _boundary(data, last + MOST)
            ends.append(last)
        end = _boundary(data, end)
        if end > last:
            ends.append(end)
            last = end
    return ends


def _boundary(data: np.ndarray, at: int) -> int:
    """The next place between code points."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _heads(chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a code point, and which begin a token of the chunk by itself."""
    data = np.frombuffer(chunk, np.uint8)
    points, letter = data & 0xC0 != 0x80, _LETTER[data]
    tokens = points.copy()
    tokens[1:] &= ~(letter[1:] & letter[:-1])
    return points, tokens


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Tokens and code points of a chunk that isn't empty, and whether its first and last bytes are letters."""
    points, tokens = _heads(chunk)
    return int(tokens.sum()), int(points.sum()), bool(_LETTER[chunk[0]]), bool(_LETTER[chunk[-1]])


class Chunks:
    """Summaries of chunks, kept for up to ``most`` bytes of content; the oldest go first."""

    def __init__(self, most: int = CACHE):
        self.known: dict[bytes, tuple[int, int, bool, bool]] = {}  # a dict compares whole contents
        self.most, self.held, self.asked, self.made = most, 0, 0, 0

    def __call__(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        self.asked += 1
        found = self.known.get(chunk)
        if found is None:
            self.made += 1
            found = self.known[chunk] = summary(chunk)
            self.held += len(chunk)
            while self.held > self.most:
                oldest = next(iter(self.known))
                self.held -= len(oldest)
                del self.known[oldest]
        return found


class Document:
    """A text's chunks with the tokens and code points that begin before each."""

    def __init__(self, text: bytes, chunks: Chunks):
        ends = chunk_ends(text)
        self.text, self.starts = text, [0, *ends[:-1]] if ends else []
        self.joined, self.before, self.points, letter = [], [0], [0], False
        for start, end in zip(self.starts, ends, strict=True):
            tokens, points, first, last = chunks(text[start:end])
            self.joined.append(letter and first)
            self.before.append(self.before[-1] + tokens - self.joined[-1])
            self.points.append(self.points[-1] + points)
            letter = last
        self.ends, self.n = ends, self.before[-1]

    def place(self, token: int) -> tuple[int, int]:
        """The byte and the code point at which a token, counted from 0, begins; the text's end for the one after the last."""
        if token >= self.n:
            return len(self.text), self.points[-1]
        k = int(np.searchsorted(self.before, token, "right")) - 1
        points, tokens = _heads(self.text[self.starts[k] : self.ends[k]])
        at = int(np.flatnonzero(tokens)[token - self.before[k] + self.joined[k]])
        return self.starts[k] + at, self.points[k] + int(points[:at].sum())


def draws(doc_id) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from an id; a null id counts as an empty one."""
    found = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return tuple(int(found[i : i + 8], 16) for i in (0, 8, 16, 24))


def rearranged(text: bytes, doc_id, chunks: Chunks, plain: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, code points of prefix and middle (none if plain), and the output.

    ``plain`` of 100 ids at most are transformed, ``spm`` of 100 of these with the suffix first.
    """
    own = Document(text, chunks)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= plain:
        return own.n, "plain", None, None, text
    (a, i), (b, j) = (own.place(c) for c in sorted((h1 % (own.n + 1), h2 % (own.n + 1))))
    form = "spm" if h4 % 100 < spm else "psm"
    prefix, suffix = PREFIX + text[:a], SUFFIX + text[b:]
    parts = (suffix, prefix) if form == "spm" else (prefix, suffix)
    return own.n, form, i, j - i, b"".join((*parts, MIDDLE, text[a:b]))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = 90, spm: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row.

    Null and empty texts, and texts that hold one of the three marks, stay as they are (a null text becomes
    empty). The cuts depend on the id only, so rows that repeat give the same; null ids share one draw.
    Texts of any length are cut whole; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for batch in batches:
            for part, found in texts(batch, "text"):
                n, form, prefix, middle, out = zip(*(rearranged(t, i, chunks, plain, spm) for i, t in zip(part.column("doc_id").to_pylist(), found, strict=True)), strict=True)
                numbers = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
                cols = [part.column("doc_id"), numbers[0], pa.array(form, pa.string()), *numbers[1:], pa.array(out, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(own).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a mark in it is never taken apart, so the first marks are the inserted ones."""

    def parts(second: str) -> tuple[Column, Column, Column]:
        at, middle = F.instr(output, second), F.instr(output, MIDDLE.decode())
        return F.substr(output, F.lit(4), at - 4), F.substr(output, at + 3, middle - at - 3), F.substr(output, middle + 3)

    prefix, suffix, middle = parts(SUFFIX.decode())
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX.decode())
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || doc_id) as h from documents),
h as (select *, len(u) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
