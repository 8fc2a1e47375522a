"""Exact token ids through a cache of pre-tokens.

Both byte-pair vocabularies used here merge only inside pre-tokens, so the ids of a text are the
concatenated ids of its pre-tokens. Each distinct pre-token goes through the tokenizers library once
per cache; texts with characters outside the range whose classes are spelled out below, or with a
special token's string, go through the library whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Letters and numbers up to U+024F, spelled out, as both vocabularies' patterns class them.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \xa0"
#: A text with any other character, or with a special token's opening, is not cut here.
OTHER = re.compile("[^\t-\r\x20-\x7e\xa0-\u024f]|<\\|")
#: Where texts are lower-cased first, nor is one with a letter whose lower case is outside the range.
LEAVING = "".join(c for c in map(chr, range(0xA0, 0x250)) if OTHER.search(c.lower()))
OTHER_LOWERED = re.compile(f"[^\t-\r\x20-\x7e\xa0-\u024f]|[{LEAVING}]|<\\|")
#: The pre-token patterns of the two vocabulary files, with the classes above.
BYTE_PATTERN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
WORD_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
#: Entries of a worker's cache; full, it becomes the old one, of which what is asked for again returns.
CACHE = 250_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {i: chr(i) if i in plain else chr(next(rest)) for i in range(256)}


class Known(dict):
    """Pre-token -> ids as bytes; what is missing goes through the library's model."""

    def __init__(self, library: Tokenizer, size: int) -> None:
        super().__init__()
        self.tokenize, self.size, self.old = library.model.tokenize, size, {}
        self.letters = str.maketrans(_byte_letters())

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = _packed([x.id for x in self.tokenize(word.encode().decode("latin-1").translate(self.letters))])
        self[word] = ids
        return ids


class PretokenEncoder:
    """encode(texts) -> list of ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str = "byte_bpe_50k.json", cache: int = CACHE) -> None:
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.words = name.startswith("word")
        self.find = (WORD_PATTERN if self.words else BYTE_PATTERN).findall
        self.other = (OTHER_LOWERED if self.words else OTHER).search
        self.known = Known(self.library, cache)

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens, or None if the text must go through the library whole."""
        if self.other(text):
            return None
        return self.find(text.lower() if self.words else text)

    def encode_one(self, text: str) -> bytes:
        cut = self.split(text)
        return self.whole(text) if cut is None else b"".join(map(self.known.__getitem__, cut))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.encode_one(x) for x in texts]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, PretokenEncoder] = {}


def encoder(name: str) -> PretokenEncoder:
    """One per Python worker and vocabulary."""
    if name not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[name] = PretokenEncoder(name)
    return _encoders[name]
