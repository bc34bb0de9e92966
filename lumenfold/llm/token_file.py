"""Token ids on disk as directly addressable codes.

Documents are range-sorted by id; each range becomes shards, and a shard is one binary file image in this format
(little-endian, everything aligned to bytes):

    magic  b"LDAC1\\0"        6 bytes
    levels uint16             number of chunk levels
    docs   uint64             number of documents
    ids    uint64             number of token ids
    widths uint8 x levels     bits of a chunk on each level, lowest bits first
    counts uint64 x levels    chunks on each level
    starts uint64 x (docs+1)  first id of each document in the shard
    then for each level: its chunks, `width` bits each; and, but for the last level, its continuation bitmap and the
    bitmap's rank directory, a uint32 of ones before each block of 512 bits.

Id i has its lowest chunk at place i of level 0. If the continuation bit there is set, its next chunk is on level 1 at
the rank of that bit, and so on: any id is read with a few bit operations and no decoding of its neighbours. The widths
are those of 1 to 4 levels that need the fewest bits for the shard.

The shards are the binary column of an uncompressed Parquet table, one row each, so that any file system Spark reads
will do, the commit protocol drops the output of lost tasks, and a reader needs only the row it wants.

Null texts are empty documents (the end id alone). A null id comes first; equal ids are ordered by a hash of the text,
and repeated rows stand beside each other in any order. A document is never split: one beyond SHARD_IDS ids is a shard of
its own, and a very long text is encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_encoder import encoder
from .common import Cuts, check_columns, in_id_order, map_arrow, own_folder, slices

MAGIC = b"LDAC1\0"
BLOCK = 512
#: Ids in a shard, about; a document is never split.
SHARD_IDS = 1 << 20


def level_widths(ids: np.ndarray, most: int = 4) -> list[int]:
    """The chunk widths that need the fewest bits: by dynamic programming over the ids' bit lengths."""
    lengths = np.maximum(1, np.frexp(ids.astype(np.float64))[1]) if len(ids) else np.array([1])
    top = int(lengths.max())
    longer = (len(lengths) - np.cumsum(np.bincount(lengths))).tolist()
    best = {(top, 0): (0, [])}
    for used in range(1, most + 1):
        for begin in range(top - 1, -1, -1):
            options = []
            for end in range(begin + 1, top + 1):
                if (rest := best.get((end, used - 1))) is not None:
                    options.append((longer[begin] * (end - begin) + (longer[begin] * 1.0625 if end < top else 0) + rest[0], [end - begin, *rest[1]]))
            if options:
                best[begin, used] = min(options)
    return min(best[0, used] for used in range(1, most + 1) if (0, used) in best)[1]


def lanes(width: int) -> Iterator[tuple[int, int, int]]:
    """64 values of `width` bits fill `width` words of 64 bits: each value's number, the word it begins in, and at which bit."""
    return ((i, *divmod(i * width, 64)) for i in range(64))


def packed(values: np.ndarray, width: int) -> bytes:
    """values, none beyond `width` bits, side by side, lowest bits first."""
    table = np.zeros((-(-len(values) // 64), 64), np.uint64)
    table.reshape(-1)[: len(values)] = values
    words = np.zeros((width, len(table)), np.uint64)
    for i, word, bit in lanes(width):
        value = table[:, i].copy()
        words[word] |= value << np.uint64(bit)
        if bit + width > 64:
            words[word + 1] |= value >> np.uint64(64 - bit)
    return words.T.astype("<u8").tobytes()[: -(-width * len(values) // 8)]


def unpacked(data: np.ndarray, width: int, count: int) -> np.ndarray:
    """The first `count` values that packed() put into the bytes `data`."""
    padded = np.zeros(-(-count // 64) * 8 * width, np.uint8)
    padded[: len(data)] = data
    words = np.ascontiguousarray(padded.view("<u8").reshape(-1, width).T)
    out = np.empty((words.shape[1], 64), np.uint32)
    for i, word, bit in lanes(width):
        value = words[word] >> np.uint64(bit)
        if bit + width > 64:
            value |= words[word + 1] << np.uint64(64 - bit)
        out[:, i] = value & np.uint64((1 << width) - 1)
    return out.reshape(-1)[:count]


def encode_shard(documents: list[np.ndarray]) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    starts = np.r_[0, np.cumsum([len(d) for d in documents])].astype("<u8")
    widths = level_widths(ids)
    rest, body, counts = ids.astype(np.uint32), [], []
    for level, width in enumerate(widths):
        counts.append(len(rest))
        body.append(packed(rest & np.uint32((1 << width) - 1), width))
        if level < len(widths) - 1:
            more = (rest >> np.uint32(width)) > 0
            padded = np.zeros(-(-max(1, len(more)) // BLOCK) * BLOCK, np.uint8)
            padded[: len(more)] = more
            ones = padded.reshape(-1, BLOCK).sum(1, dtype=np.uint32)
            body += [np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
            rest = rest[more] >> np.uint32(width)
    head = MAGIC + struct.pack("<HQQ", len(widths), len(documents), len(ids)) + bytes(widths) + np.array(counts, "<u8").tobytes()
    return head + starts.tobytes() + b"".join(body)


class Shard:
    """Reads a shard in place."""

    def __init__(self, data: bytes):
        if data[:6] != MAGIC:
            raise ValueError("no shard of token ids")
        self.data = np.frombuffer(data, np.uint8)
        levels, self.docs, self.ids = struct.unpack_from("<HQQ", data, 6)
        at = 24
        self.widths = list(data[at : at + levels])
        at += levels
        self.counts = np.frombuffer(data, "<u8", levels, at).tolist()
        at += 8 * levels
        self.starts = np.frombuffer(data, "<u8", self.docs + 1, at).astype(np.int64)
        at += 8 * (self.docs + 1)
        self.at, self.more, self.rank = [], [], []
        for level, (width, count) in enumerate(zip(self.widths, self.counts, strict=True)):
            self.at.append(at)
            at += -(-width * count // 8)
            if level < levels - 1:
                blocks = -(-max(1, count) // BLOCK)
                self.more.append(at)
                at += blocks * BLOCK // 8
                self.rank.append(np.frombuffer(data, "<u4", blocks, at))
                at += 4 * blocks

    def id(self, i: int) -> int:
        """Token id i of the shard."""
        if not 0 <= i < self.ids:
            raise IndexError(i)
        value = shift = 0
        for level, width in enumerate(self.widths):
            first = i * width
            begin, end = self.at[level] + first // 8, self.at[level] + -(-(first + width) // 8)
            word = int.from_bytes(self.data[begin:end].tobytes(), "little")
            value |= (word >> first % 8 & (1 << width) - 1) << shift
            shift += width
            if level == len(self.widths) - 1:
                break
            bitmap = self.more[level]
            if not self.data[bitmap + i // 8] >> i % 8 & 1:
                break
            block = i // BLOCK
            inside = int.from_bytes(self.data[bitmap + block * BLOCK // 8 : bitmap + i // 8 + 1].tobytes(), "little")
            i = int(self.rank[level][block]) + (inside & (1 << i - block * BLOCK) - 1).bit_count()
        return value

    def document(self, k: int) -> np.ndarray:
        return np.array([self.id(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)

    def all(self) -> np.ndarray:
        """All ids in order, level by level."""
        out = where = None
        shift = 0
        for level, (width, count) in enumerate(zip(self.widths, self.counts, strict=True)):
            size = -(-width * count // 8)
            chunk = unpacked(self.data[self.at[level] : self.at[level] + size], width, count)
            if out is None:
                out, where = chunk, np.arange(count)
            else:
                out[where] |= chunk << np.uint32(shift)
            shift += width
            if level < len(self.widths) - 1:
                blocks = -(-max(1, count) // BLOCK) * BLOCK // 8
                where = where[np.unpackbits(self.data[self.more[level] : self.more[level] + blocks], count=count, bitorder="little").astype(bool)]
        return out if out is not None else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end: int, words: bool = False, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents, each with the id `end` after it, to `path` in ascending order of doc_id.

    Bounds from the table cut it into `parts` ranges of about equal row counts, whatever the sources or lengths are and
    also where one id has many rows; one shuffle, of compressed texts, brings a range together.
    Columns: part and shard (their order is the documents' order), before (ids of the part before this shard), n_ids,
    doc_ids, data.
    """
    check_columns(docs, doc_id, text)
    rows = in_id_order(docs, doc_id, text)
    cuts = Cuts(rows, parts)

    def shrink():
        squeeze = zstandard.ZstdCompressor(level=1).compress
        number = 0

        def each(columns):
            nonlocal number
            ids, places, hashes, texts = columns
            data = [squeeze((t or "").encode()) for t in texts]
            ranges = [cuts.range_of(row, number + k) for k, row in enumerate(zip(places, hashes, strict=True))]
            number += len(ids)
            return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(hashes, pa.int64()), pa.array(data, pa.binary())], ["range", "doc_id", "place", "hash", "data"])

        return each

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        grow = zstandard.ZstdDecompressor().decompress
        encode, held, ids, n, shard, before = encoder(vocabulary, words).encode, [], [], 0, 0, 0

        def flush():
            row = [[part], [shard], [before], [n], [ids], [encode_shard(held)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, SHARD_TYPES, strict=True)], SHARD_NAMES)

        for doc_ids, data in slices(batches, 1, 500_000):
            for i, b in zip(doc_ids, encode([grow(d).decode() for d in data], end), strict=True):
                if n and n + len(b) // 4 > SHARD_IDS:
                    yield flush()
                    shard, before, held, ids, n = shard + 1, before + n, [], [], 0
                held.append(np.frombuffer(b, np.uint32))
                ids.append(i)
                n += len(b) // 4
        if n:
            yield flush()

    small = map_arrow(rows, shrink, "range int, doc_id long, place long, hash long, data binary", text=3)
    ranged = small.repartitionById(cuts.ranges, F.col("range")).sortWithinPartitions("place", "hash", "data").select("doc_id", "data")
    ranged.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


SHARD_SCHEMA = "part int, shard int, before long, n_ids long, doc_ids array<bigint>, data binary"
SHARD_NAMES = ["part", "shard", "before", "n_ids", "doc_ids", "data"]
SHARD_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]


def read_token_files(spark, path: str) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32.

    Only the number of ids in each part goes to the driver: as many rows as there are partitions.
    """
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sums = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    first, total = {}, 0
    for part, n in sums:
        first[part], total = total, total + n

    def decode(batches):
        for batch in batches:
            for part, before, doc_ids, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "doc_ids", "data")), strict=True):
                shard = Shard(data)
                ids, starts = shard.all(), shard.starts
                for b in starts[1:].tolist():  # every document's last id, read by itself, must be what the levels give
                    if shard.id(b - 1) != ids[b - 1]:
                        raise ValueError(f"shard at id {first[part] + before} is damaged")
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + (first[part] + before)), pa.array(np.diff(starts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "before", "doc_ids", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_path(spark) -> str:
    """A folder for token files that is dropped with the application; give write_token_files() a path to keep them."""
    return f"{own_folder(spark)}/tokens-{uuid.uuid4().hex}"
