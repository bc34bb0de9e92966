"""Token ids by the tokenizers library, with a bounded memory of chunks.

A text is cut at places where the tokenizer's own pre-tokenisation always cuts, so that the chunks' ids put together are
the text's ids; each pre-token is encoded by the library's model and its ids are remembered. Cuts:

* words: at white space, which the normaliser of a word-level vocabulary drops;
* bytes: before a white space that follows something else, where the byte-level pattern always begins a new pre-token.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from codecs import charmap_decode
from collections.abc import Callable
from functools import lru_cache

import regex

from .token_counts import SEPARATORS, WESTERN, WHITE, byte_symbols, special_strings

#: Strings that a memory of a worker holds in one of its two generations.
REMEMBERED = 400_000
REMEMBERED_LENGTH = 64
#: The byte-level pattern, with the white space of Unicode.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A white space after something that is none.
EDGE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})", regex.V1)


class Memory(dict):
    """Results by string. What isn't there is taken from the generation before, or made; long strings are made each
    time. Two generations are held, so that frequent strings outlive the others."""

    def __init__(self, make: Callable[[str], bytes], before: dict | None = None):
        super().__init__()
        self.make, self.before = make, before or {}

    def __missing__(self, key: str) -> bytes:
        if (out := self.before.get(key)) is None:
            out = self.make(key)
        if len(key) <= REMEMBERED_LENGTH:
            self[key] = out
        return out

    def bounded(self) -> Memory:
        """This memory, or its next generation if it is full."""
        if len(self) <= REMEMBERED:
            return self
        self.before = {}
        return Memory(self.make, self)


class ChunkEncoder:
    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.symbols = self.tokenizer.model, "".join(byte_symbols())
        self.pattern = BYTE_PATTERN
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = special_strings(spec)
        #: What every special string begins with; a chunk without it holds none.
        self.mark = os.path.commonprefix(special) if special else None
        if words:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.pieces = Memory(self.piece)
        self.known = Memory(self.ids)
        self.spaced = Memory(lambda chunk: self.ids(" " + chunk))

    def piece(self, pre_token: str) -> bytes:
        visible = charmap_decode(pre_token.encode(), "strict", self.symbols)[0]
        return array("I", [t.id for t in self.model.tokenize(visible)]).tobytes()

    def ids(self, chunk: str) -> bytes:
        """The ids of a chunk as little-endian 32-bit integers."""
        plain = chunk.isascii()
        if not plain and max(chunk) > WESTERN or self.mark is not None and self.mark in chunk:
            # May hold a special string, which the library looks for first, or what the pattern library may not know.
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if self.words:
            chunk = chunk.lower() if plain else "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
        word = chunk if self.words else chunk.removeprefix(" ")  # one word, with a comma or full stop perhaps
        if word.isalpha():
            # The chunk itself is remembered; accented words are pieces too, since they return with a comma or full stop.
            return self.piece(chunk) if plain else self.pieces[chunk]
        if word[:-1].isalpha() and word[-1] in ",.":
            return self.pieces[chunk[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def text_ids(self, text: str) -> bytes:
        known = self.known.__getitem__
        if self.words:
            return b"".join(map(known, [c for c in WHITE.split(text) if c] if SEPARATORS.search(text) else text.split()))
        if "  " in text:
            return b"".join(map(known, EDGE.split(text)))
        # Between single spaces every chunk but the first begins with its space.
        first, *rest = text.split(" ")
        return known(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text, with the id `end` after them."""
        self.pieces, self.known, self.spaced = self.pieces.bounded(), self.known.bounded(), self.spaced.bounded()
        last = array("I", [end]).tobytes()
        return [self.text_ids(t) + last for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str, words: bool) -> ChunkEncoder:
    return ChunkEncoder(path, words)
