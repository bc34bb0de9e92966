"""Document fingerprints by order min-hash.

A text's k-mers (K code points in a row, overlapping) are numbered by occurrence, so that repeats count. For each of
SIZE hash functions the TUPLE numbered k-mers with the least values are selected, put back into text order, and hashed
together to one 32-bit component: moving, inserting or deleting text changes order or selection, so that the share of
equal components falls with the edit distance. The fingerprint is the components as hexadecimal digits.

Nulls and odd rows: a null text counts as empty; an empty text has the fingerprint of zeros. Texts with fewer than K code
points have one k-mer of them all. Of k-mers with equal values the one with the lesser hash is taken. Documents are
ordered by id (null first), equal ids by a hash of the text; the successor of the last is the first, of a single document
itself; repeated rows stand beside each other. A very long text is held with some arrays of 8 bytes for each code point;
the values of all hash functions are made for a block at a time. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, check_columns, in_id_order, map_arrow, slices

#: Code points of a k-mer, k-mers of a component, components.
K, TUPLE, SIZE = 8, 2, 32
#: K-mers looked at together; longer texts are taken in blocks.
BLOCK = 1 << 12

SEEDS = np.random.Generator(np.random.PCG64(1_811_234)).integers(1, 1 << 31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
FULL = np.uint32(0xFFFFFFFF)
EACH = np.arange(SIZE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[0]
    return x ^ (x >> np.uint64(29))


def numbered_grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the text's k-mers in text order; and, for each k-mer in the order of its hash, a 32-bit key of the
    hash and its number among the equal ones, and its place. The k-mers of one hash are numbered from left to right."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    k = min(K, len(code))
    grams = code
    for i in range(1, k):
        grams = grams[: len(code) - i] * ODD[1] + code[i:]
    grams = mixed(grams + np.uint64(k))
    bits = np.uint64(max(20, len(grams).bit_length()))
    # Hash and place in one number: sorted, equal hashes stand together in text order.
    ranked = np.sort(grams >> bits << bits | np.arange(len(grams), dtype=np.uint64))
    places = (ranked & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ranked >>= bits
    at = np.arange(len(ranked))
    starts = np.maximum.accumulate(np.where(np.concatenate([[True], ranked[1:] != ranked[:-1]]), at, 0))
    keys = mixed(ranked * ODD[2] + (at - starts).astype(np.uint64))
    return grams, (keys >> np.uint64(32)).astype(np.uint32), places


def components(text: str) -> np.ndarray:
    """The signature: SIZE numbers of 32 bits."""
    if not text:
        return np.zeros(SIZE, np.uint32)
    grams, keys, places = numbered_grams(text)
    least: list[tuple[np.ndarray, np.ndarray]] = []  # values and places, TUPLE of each for each block
    for begin in range(0, len(keys), BLOCK):
        values = keys[begin : begin + BLOCK] * SEEDS[:, None]
        values ^= values >> np.uint32(15)
        for _ in range(min(TUPLE, values.shape[1])):
            at = values.argmin(1)
            least.append((values[EACH, at], places[at + begin]))
            values[EACH, at] = FULL
    values, chosen = (np.stack(x, 1) for x in zip(*least, strict=True))
    if values.shape[1] > TUPLE:
        chosen = np.take_along_axis(chosen, np.argsort(values, axis=1, kind="stable")[:, :TUPLE], 1)
    chosen.sort(axis=1)
    out = np.zeros(SIZE, np.uint64)
    for i in range(chosen.shape[1]):
        out = mixed(out * ODD[1] + grams[chosen[:, i]])
    return (out >> np.uint64(32)).astype(np.uint32)


def hexadecimal(components: np.ndarray) -> str:
    return components.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal components."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the following text's beginning, or by all of it."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row: a narrow map without a shuffle."""
    check_columns(docs, doc_id, text)

    def make():
        def each(columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([hexadecimal(components(t or "")) for t in columns[1]], pa.string())], ["doc_id", "fingerprint"])

        return each

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), make, "doc_id long, fingerprint string")


def edit_likeness(docs: DataFrame, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    Each document needs its successor by id. Bounds from the table cut it into ranges of about equal row counts, also
    where one id has many rows; one shuffle, of compressed texts, brings a range together, and the first document of each
    range goes to the range before as well (that of the first range to the last one). Every range is then one sorted pass
    that holds two texts at a time.
    """
    check_columns(docs, doc_id, text)
    rows = in_id_order(docs, doc_id, text)
    cuts = Cuts(rows, parts)
    if cuts.first is None:
        return docs.sparkSession.createDataFrame([], EDIT_SCHEMA)

    def shrink():
        squeeze = zstandard.ZstdCompressor(level=1).compress
        copied: set[tuple[int, tuple[int, int]]] = set()
        number = 0

        def each(columns):
            nonlocal number
            out = []
            for i, p, h, t in zip(*columns, strict=True):
                data = squeeze((t or "").encode("utf-8", "surrogatepass"))
                out.append((cuts.range_of((p, h), number), False, i, p, h, data))
                number += 1
                # Of equal rows one copy from each task is enough.
                for r in [r - 1 for r in cuts.begun_by((p, h))] + [cuts.ranges - 1] * cuts.is_first((p, h)):
                    if (r, (p, h)) not in copied:
                        copied.add((r, (p, h)))
                        out.append((r, True, i, p, h, data))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["range", "copy", "doc_id", "place", "hash", "data"])

        return each

    def walk(batches):
        grow = zstandard.ZstdDecompressor().decompress
        held = None  # range, id, text and components of the document whose successor is still to come
        for ranges, copies, ids, data in slices(batches, 3, 1_000_000):
            out = []
            for r, copy, i, d in zip(ranges, copies, ids, data, strict=True):
                if held is None and copy:
                    continue  # copies beyond the first, or of a range without own documents
                now = grow(d).decode("utf-8", "surrogatepass")
                mine = components(now)
                if held is not None and held[0] == r:
                    _, before_id, before, theirs = held
                    changed = edited(before, now)
                    new = components(changed)
                    out.append((before_id, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), hexadecimal(theirs), hexadecimal(new), likeness(theirs, new), likeness(theirs, mine)))
                held = None if copy else (r, i, now, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), EDIT_TYPES, strict=True)], EDIT_NAMES)

    small = map_arrow(rows, shrink, "range int, copy boolean, doc_id long, place long, hash long, data binary", text=3)
    ranged = small.repartitionById(cuts.ranges, F.col("range")).sortWithinPartitions("range", "copy", "place", "hash", "data")
    return ranged.select("range", "copy", "doc_id", "data").mapInArrow(walk, EDIT_SCHEMA)


EDIT_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
EDIT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
