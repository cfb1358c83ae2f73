"""Split texts into the pre-tokens of a word-level BPE tokenizer file.

The file's normaliser is NFC, white space to one space, lower case; its
pre-tokeniser keeps the matches of one pattern and drops white space.  Texts
whose characters all lie below U+0250 and that are in NFC take a short way with
the same result; all others go through the file's own normaliser and
pre-tokeniser.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from tokenizers import Tokenizer

_LOW = re.compile("[^\\u0000-\\u024f]")
_LOW_SPLIT = re.compile(
    # Fixed value: the file's split pattern 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+;
    # below U+0250, \w is the letters, the numbers and the underscore; numbers outside ASCII are the six named
    r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\t-\r \x85\xa0]|_)+"
)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


_BYTES = {c: b for b, c in enumerate(byte_alphabet())}


class PreTokenizer:
    """Pre-tokens and added tokens of a text, in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the library's normaliser and pre-tokeniser, without the memory of its vocabulary
        empty = {"type": "BPE", "vocab": {}, "merges": []}
        self.tokenizer = Tokenizer.from_str(json.dumps(spec | {"model": empty, "added_tokens": []}))
        self.marker = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def lowered(self, text: str) -> str | None:
        """The text in lower case, if all of it lies below U+0250 and is in NFC before and after; else None."""
        if text.isascii():
            return text.lower()
        if not _LOW.search(text) and unicodedata.is_normalized("NFC", text):
            low = text.lower()
            if not _LOW.search(low):
                return low
        return None

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        low = self.lowered(text)
        if low is not None:
            return _LOW_SPLIT.findall(low)
        normal = self.tokenizer.normalizer.normalize_str(text)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(_BYTES.__getitem__, p)).decode() for p, _ in pieces]

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """(is an added token, string) for each stretch of a text."""
        if self.marker is None or not self.marker.search(text):
            return [(False, text)] if text else []
        return [(s in self.added, s) for s in self.marker.split(text) if s]


@lru_cache(maxsize=2)
def pretokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)
