"""Token ids of the lower-casing word-end BPE vocabulary, exactly as its library gives them.

The library splits a text into words and encodes each word alone. Most words
occur again and again, so the ids of words and of chunks between blanks are
kept in bounded tables, and the library's model encodes the others. Texts with characters beyond Latin
Extended-A, with rarer control characters or with the strings of special tokens
go to the library whole.
"""

from __future__ import annotations

import re
import struct
import unicodedata

SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_PLAIN = "\t\n\x0b\x0c\r\x20-\x7e\x85\xa0-įı-ſ"
_UNUSUAL = re.compile(f"[^{_PLAIN}]")
_LETTERS, _NUMBERS = ("".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == kind) for kind in "LN")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

# The byte alphabet of such vocabularies: bytes that print stand for themselves, the others follow 255 in order.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    """Short keys and what ``make`` gives for them; emptied when full."""

    def __init__(self, make, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.words = _Known(self._word, most)
        self.chunks = _Known(self._chunk, most)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else "".join(map(BYTE_ALPHABET.__getitem__, word.encode()))
        return _packed([t.id for t in self.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORDS.findall(chunk)))

    def encode(self, text: str) -> bytes:
        if _UNUSUAL.search(text) or any(s in text for s in SPECIAL):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One encoder for a process, so that its tables serve all its tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
