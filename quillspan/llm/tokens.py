"""Token ids of whole texts by a public word-piece vocabulary, one lookup a word.

The vocabulary's rules never look across white space, so a text's ids are those of its words put end to
end. A word is encoded once per worker and kept, as little-endian bytes, in a bounded table. A word of
plain Latin letters and punctuation goes straight to the vocabulary's merges, by ``tiktoken``; any other
one, and every text that holds a special token's string, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np

_SUFFIX = "</w>"
_MARK = b"\xff"  # ends a word in the merge table; never part of UTF-8


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    """``ids(text)`` gives the ids of UTF-8 bytes as little-endian numbers of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u4", special: bool = True, keep: int = 300_000):
        """``special``: a special token's string in a text is that token; else it is ordinary text."""
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.dtype, self.keep = np.dtype(dtype), keep
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.whole.encode_special_tokens = not special
        self.special = [x["content"].encode() for x in spec["added_tokens"] if special]
        self.fast = spec["model"].get("end_of_word_suffix") == _SUFFIX and not spec["model"].get("dropout")
        self.cache: dict[bytes, bytes] = _Missing(self._encode, keep)
        self.pieces: dict[bytes, bytes] = {}
        if self.fast:
            back = _byte_of_char()
            ranks: dict[bytes, int] = {}
            for token, i in spec["model"]["vocab"].items():
                if token in {x["content"] for x in spec["added_tokens"]}:
                    continue
                stem, end = (token[: -len(_SUFFIX)], _MARK) if token.endswith(_SUFFIX) else (token, b"")
                ranks.setdefault(bytes(back[c] for c in stem) + end, i)
            self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
            self.plain = regex.compile(r"[\x21-\x7EÀ-ſ]+").fullmatch

    def _piece(self, piece: bytes) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array(self.code, self.piece(piece + _MARK)).tobytes()
            if len(self.pieces) >= self.keep:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _encode(self, word: bytes) -> bytes:
        if self.fast and word.isalpha():
            out = self._piece(word.lower())
        elif self.fast and word[-1:] in b".,;:" and word[:-1].isalpha():
            out = self._piece(word[:-1].lower()) + self._piece(word[-1:])
        else:
            text = word.decode("utf-8", "replace")
            if not (self.fast and self.plain(text) and unicodedata.is_normalized("NFC", text)):
                return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
            out = b"".join([self._piece(x.encode()) for x in self.cut(text.lower())])
        return out

    def ids(self, text: bytes) -> bytes:
        if b"<|" in text and any(x in text for x in self.special):
            return np.asarray(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.cache.__getitem__, text.split()))


class _Missing(dict):
    """A table that fills itself and starts anew when full, so its memory is bounded."""

    def __init__(self, make, keep: int):
        self.make, self.keep = make, keep

    def __missing__(self, key):
        if len(self) >= self.keep:
            self.clear()
        value = self.make(key)
        if len(key) < 64:
            self[key] = value
        return value


_loaded: dict[tuple, WordIds] = {}


def word_ids(path: str, dtype: str = "<u4", special: bool = True) -> WordIds:
    """One tokenizer a worker process."""
    key = (path, dtype, special)
    if key not in _loaded:
        _loaded[key] = WordIds(*key)
    return _loaded[key]
