"""Statistics of one text, each computed once and only when asked for."""

from __future__ import annotations

from functools import cached_property

import numpy as np

_SPACE = b" \t\n\x0b\x0c\r"
_NOT_FIRST = bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


class Stats:
    """Counts of a text given as UTF-8 bytes; words are runs of anything but ASCII white space."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.text.translate(None, _NOT_FIRST + _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return _count(self.text, b"#*$%&|<>")

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> np.ndarray:
        known: dict[bytes, int] = {}
        return np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of three words which the text has twice or more."""
        ids = self.word_ids
        if len(ids) < 4:
            return 0
        most = int(ids.max()) + 1
        keys = ids[:-2] * most + ids[1:-1]
        if most >= 1 << 21:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * most + ids[2:]
        ordered = np.sort(keys)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(again):
            return 0
        hit = np.isin(keys, again)
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : len(ids) - 2 + k] |= hit
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        """Letters A to Z."""
        return _count(self.text, _UPPER)

    @cached_property
    def n_lower(self) -> int:
        return _count(self.text, _LOWER)

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count(b"!!")

    def features(self) -> list[float]:
        """What the quality classifier looks at; shares are of words, so long and short texts compare."""
        n, text = max(1, self.n_words), self.text
        ids = self.word_ids
        counts = np.bincount(ids) if len(ids) else np.zeros(1, int)
        same = int((ids[1:] == ids[:-1]).sum()) if len(ids) > 1 else 0
        return [
            float(np.log1p(self.n_words)), self.word_chars / n, self.n_symbols / n, self.n_dup_lines / max(1, len(self.lines)),
            self.n_repeat_words / n, self.n_upper / max(1, self.n_upper + self.n_lower), self.n_shouts / n, len(counts) / n,
            int(counts.max()) / n, same / n, _count(text, b".") / n, _count(text, b",") / n, _count(text, b"0123456789") / n,
            _count(text, b"|") / n, _count(text, b"!?") / n, len(self.lines) / n, _count(text, b"()[]{}=_/\\@+:;\"") / n,
        ]


N_FEATURES = 17
