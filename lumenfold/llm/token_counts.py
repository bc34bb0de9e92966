"""Token counts by rank-synchronous array merging.

The counter reads the vocabulary file of a byte-pair tokenizer with word ends (`word_bpe_49k.json`) and counts the
tokens that the tokenizers library would give, without calling the library. A text is normalised and cut into
pre-tokens; pre-tokens that were not seen lately are held together as one ragged array of symbols, and in each round
every sequence has its lowest-ranked adjacent pair replaced at all its places at once. When no pair of a sequence has
a rank, its surviving symbols are its tokens.

A null or empty text has 0 bytes and 0 tokens. Ids may repeat or be null: there is one output row for each input row,
and none for an empty table. Equal texts have equal counts. A very long text is counted as a whole; its pre-tokens are
held once each.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns, map_arrow

#: Counts of chunks that a worker remembers; it starts anew when there are more.
REMEMBERED = 300_000
#: Longer chunks are counted, not remembered.
REMEMBERED_LENGTH = 80

NONE = np.int64(1 << 40)
SEPARATORS = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand
    for themselves and the others take the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(moved)) for b in range(256)]


#: Up to here every code point is assigned and every library knows what it is.
WESTERN = "\u024f"
CONTRACTIONS = regex.compile("'(?:s|t|re|ve|m|ll|d)")


def scanned(chunk: str) -> list[str]:
    """The pre-tokens of a chunk without white space, by the general categories of its code points: contractions, runs
    of letters, single numbers, runs of the rest. (The pattern library takes many unassigned code points for letters.)"""
    kinds = [k if (k := unicodedata.category(c)[0]) in "LN" else "O" for c in chunk]
    out, i = [], 0
    while i < len(chunk):
        end = i + 1
        if m := CONTRACTIONS.match(chunk, i):
            end = m.end()
        elif kinds[i] != "N":
            while end < len(chunk) and kinds[end] == kinds[i]:
                end += 1
        out.append(chunk[i:end])
        i = end
    return out


def special_strings(spec: dict) -> list[str]:
    """The strings that a vocabulary file wants found inside texts first. One with white space, or one that also takes
    the space beside it or ignores case, would reach beyond the chunks that texts are cut into: such a file is refused."""
    for token in spec["added_tokens"]:
        if WHITE.search(token["content"]) or any(token.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"the added token {token['content']!r} needs more than its own text")
    return [token["content"] for token in spec["added_tokens"] if token["content"]]


class MergeCounter:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.width = np.int64(max(vocab.values()) + 1)
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + end] for c in symbols], np.int64)
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        self.result = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        # A merge may run at all its places at once unless what it makes could take part in a lower-ranked merge.
        lowest = np.full(int(self.width), NONE)
        np.minimum.at(lowest, left, np.arange(len(left)))
        np.minimum.at(lowest, right, np.arange(len(left)))
        self.one_by_one = lowest[self.result] < np.arange(len(left))
        self.special = special_strings(spec)
        self.cut = regex.compile("(?:" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pre = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def rank_of(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], NONE)

    def merged_lengths(self, words: list[str]) -> np.ndarray:
        """For each pre-token, how many symbols survive."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        out = np.ones(len(words), np.int64)
        of = np.repeat(np.arange(len(words)), sizes)
        many = sizes[of] > 1
        symbols, of = symbols[many], of[many]
        while len(symbols):
            first = np.r_[True, of[1:] != of[:-1]]
            starts = np.flatnonzero(first)
            rank = np.full(len(symbols), NONE)
            inside = np.flatnonzero(~first[1:])
            rank[inside] = self.rank_of(symbols[inside] * self.width + symbols[inside + 1])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            open_ = least < NONE
            if not open_.all():
                out[of[starts[~open_]]] = counts[~open_]
            least_each = np.repeat(least, counts)
            chosen = (rank == least_each) & (least_each < NONE)
            at = np.flatnonzero(chosen)
            if not len(at):
                break
            # Of overlapping places (a pair of equal symbols in a row) every second one is taken, from the left.
            new_run = np.r_[True, np.diff(at) > 1]
            run = np.cumsum(new_run) - 1
            at = at[(at - at[new_run][run]) % 2 == 0]
            single = self.one_by_one[rank[at]]
            if single.any():
                leftmost = np.r_[True, of[at][1:] != of[at][:-1]]
                at = at[leftmost | ~single]
            symbols[at] = self.result[rank[at]]
            keep = np.repeat(open_, counts)
            keep[at + 1] = False
            symbols, of = symbols[keep], of[keep]
        return out

    def pre_tokens(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return self.pre.findall(chunk.lower())
        chunk = "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
        return self.pre.findall(chunk) if max(chunk) <= WESTERN else scanned(chunk)

    def chunks(self, text: str) -> list[str]:
        """The text between white space. Python also splits at the four separators 0x1C to 0x1F; the tokenizer doesn't."""
        if SEPARATORS.search(text):
            return [c for c in WHITE.split(text) if c]
        return text.split()

    def learn(self, chunks: set[str], extra: dict[str, int]) -> None:
        """Puts the counts of new chunks into the memory, or into extra if they are long."""
        new = [c for c in chunks if c not in self.known]
        if not new:
            return
        words: dict[str, int] = {}
        parts = [[words.setdefault(w, len(words)) for w in self.pre_tokens(c)] for c in new]
        lengths = self.merged_lengths(list(words)) if words else np.zeros(0, np.int64)
        for c, p in zip(new, parts, strict=True):
            (self.known if len(c) <= REMEMBERED_LENGTH else extra)[c] = int(sum(lengths[i] for i in p))

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; special strings inside a text count as one token each."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        specials, cut = [], []
        for t in texts:
            if any(s in t for s in self.special):
                pieces = self.cut.split(t)
                specials.append(len(pieces) - 1)
                cut.append([c for p in pieces for c in self.chunks(p)])
            else:
                specials.append(0)
                cut.append(self.chunks(t))
        extra: dict[str, int] = {}
        self.learn(set().union(*cut), extra)
        known = self.known
        if extra:
            return [s + sum(known[c] if c in known else extra[c] for c in chunks) for s, chunks in zip(specials, cut, strict=True)]
        return [s + sum(map(known.__getitem__, chunks)) for s, chunks in zip(specials, cut, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    path: the vocabulary file, which every executor can read. A narrow map: no shuffle, whatever the keys or lengths.
    """
    check_columns(docs, doc_id, text)

    def make():
        count = counter(path)

        def each(columns):
            texts = [t or "" for t in columns[1]]
            n = np.array(count.count(texts), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return each

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
