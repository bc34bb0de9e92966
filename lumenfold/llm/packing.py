"""Best-fit packing of token sequences, bulk-synchronously.

Every document is cut into pieces of `limit` tokens at most (only longer ones are cut). All waiting pieces of one length
are a run, and so are neighbouring bins with the same gap; runs are rows of a table. A round goes like this:

1. runs of pieces and of gaps are put into ranges of sizes, and sorted within each, largest first;
2. every range is swept by a task of its own, which matches each run of pieces with its successor, the least gap that
   still holds it. What finds no partner, pieces and then gaps, goes to the task that sweeps the neighbouring ranges'
   rests, FAN ranges at a time, until one range is left. As in the matching of brackets, the order of these steps
   doesn't matter: the matches are those of one sweep over everything (tests compare them);
3. runs of pieces that want the same gap are served by rank: longer pieces first, then by their number. A bin takes as
   many pieces of one run as its gap holds;
4. gaps are updated, written, and the next round starts with them.

When no waiting piece fits any gap, the longest ones open bins, as many as the waiting tokens need at least. Rounds
repeat until no piece waits; a round takes a job or two over a small table, and 10 to 20 rounds occur. A run's row is a
few numbers and a sweep adds no more rows than there are sizes and runs, so no table of a round grows with the documents.

The result is a list of runs: "pieces of length l with ranks a to b go to bins c, c+1, ... at offset o, k to a bin". Each
piece finds its rank among those of its length by counting (length, salt) groups, so that a length shared by a third of
all rows is spread over many tasks, and looks its run up.

Nulls and odd rows: a null or empty text is a document of the end id alone. Ids may repeat or be null: each row is a
document of its own. Pieces of equal length are ranked by a salt, then by id; which of equal rows goes where is any
choice. A very long text is encoded whole and cut into pieces. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk_encoder import encoder
from .common import check_columns, scratch, slices, written

SALTS = 256
#: Ranges of sizes that are swept at first, and how many neighbours' rests are swept together then.
RANGES, FAN = 16, 4
#: Kinds of runs: bins with a gap, waiting pieces, gaps that a round leaves for the next, and what a round decided.
GAP, PIECE, LATER, MATCH = range(4)
#: size, and from where to where: bins of a gap, ranks of pieces. A match also has its first bin, offset and fit.
RUNS = "kind int, size long, first long, last long, bin long, offset long, fit long"
RUN_NAMES = [column.split()[0] for column in RUNS.split(", ")]
RUN_TYPES = [pa.int32(), *[pa.int64()] * 6]
STRUCT = ",".join(column.replace(" ", ":") for column in RUNS.split(", "))


def sweep(runs: list[tuple], limit: int) -> list[tuple]:
    """One sweep over runs (rows of RUNS): the matches, the gaps that they leave for later, and what found no partner."""
    rest: list[tuple] = []
    out: list[tuple] = []
    gaps: list[list[int]] = []  # the last one is the least of those passed: the successor
    for kind, size, first, last, *more in sorted(runs, key=lambda r: (-r[1], r[0], r[2])):
        if kind == GAP:
            if gaps and gaps[-1][0] == size and gaps[-1][2] == first:
                gaps[-1][2] = last
            else:
                gaps.append([size, first, last])
        elif kind == PIECE:
            while first < last and gaps:
                gap, begin, end = gaps[-1]
                fit = gap // size
                bins = min(end - begin, (last - first) // fit)
                if not bins:
                    bins, fit = 1, last - first
                out.append((MATCH, size, first, first + bins * fit, begin, limit - gap, fit))
                if gap > fit * size:
                    out.append((LATER, gap - fit * size, begin, begin + bins, 0, 0, 0))
                first += bins * fit
                gaps[-1][1] += bins
                if gaps[-1][1] == end:
                    gaps.pop()
            if first < last:
                rest.append((PIECE, size, first, last, 0, 0, 0))
        else:
            out.append((kind, size, first, last, *more))
    return out + rest + [(GAP, *gap, 0, 0, 0) for gap in gaps]


def matched(runs: DataFrame, limit: int) -> DataFrame:
    """A round's sweep, range by range and then over what the ranges leave."""

    def each(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = sweep(list(zip(*(c.to_pylist() for c in table.drop_columns("part").columns), strict=True)), limit)
        return pa.table([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUN_TYPES, strict=True)), pa.array([part] * len(rows), pa.int32())], [*RUN_NAMES, "part"])

    runs = runs.withColumn("part", F.expr(f"cast((({limit} - size) * {RANGES}) div {limit + 1} as int)"))
    ranges = RANGES
    while True:
        runs = runs.groupBy("part").applyInArrow(each, f"{RUNS}, part int")
        if ranges == 1:
            return runs.drop("part")
        ranges //= FAN
        runs = runs.withColumn("part", F.expr(f"cast(part div {FAN} as int)"))


def opened(runs: DataFrame, limit: int, bins: int, number: int) -> DataFrame:
    """The `number` longest waiting pieces open bins, from bin `bins` on. Only runs of pieces are looked at, a row a size."""
    before = F.coalesce(F.sum(F.col("last") - F.col("first")).over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    waiting = runs.where(F.col("kind") == PIECE).select("size", "first", "last", before.alias("before"))
    waiting = waiting.withColumn("mid", F.col("first") + F.least(F.col("last") - F.col("first"), F.greatest(F.lit(number) - F.col("before"), F.lit(0))))

    def run(kind, size, first, last, bin_=F.lit(0), fit=0):
        values = [F.lit(kind), size, first, last, bin_, F.lit(0), F.lit(fit)]
        return F.struct(*(F.col(v).alias(n) if isinstance(v, str) else v.alias(n) for v, n in zip(values, RUN_NAMES, strict=True)))

    at = F.col("before") + bins
    three = [run(MATCH, "size", "first", "mid", at, 1), run(GAP, F.lit(limit) - F.col("size"), at, at + F.col("mid") - F.col("first")), run(PIECE, "size", "mid", "last")]
    made = waiting.select(F.explode(F.array(*(t.cast(f"struct<{STRUCT}>") for t in three))).alias("run")).select("run.*")
    return made.where("first < last AND size > 0")


def plan(counts: DataFrame, limit: int) -> np.ndarray:
    """counts: length, n, the number of pieces of each length. Rows (length, first rank, end rank, first bin, offset, fit):
    the piece of that length with rank r in [first rank, end rank) goes to bin `first bin + (r - first rank) // fit`, at
    `offset + (r - first rank) % fit * length`. No bin gets over `limit` tokens.

    The driver gets one row of numbers a round, and the list in the end."""
    with scratch(counts.sparkSession):
        zero = F.lit(0)
        runs = counts.select(*(c.cast(t.split()[1]).alias(n) for c, n, t in zip([F.lit(PIECE), F.col("length"), zero, F.col("n"), zero, zero, zero], RUN_NAMES, RUNS.split(", "), strict=True)))
        runs = written(runs, "runs")
        piece, tokens = F.col("kind") == PIECE, F.col("size") * (F.col("last") - F.col("first"))
        done, bins = [], 0
        while True:
            now = runs.agg(
                F.min(F.when(piece, F.col("size"))).alias("least"),
                F.max(F.when(F.col("kind").isin(GAP, LATER), F.col("size"))).alias("widest"),
                F.sum(F.when(piece, tokens)).alias("tokens"),
                F.sum(F.when(piece & (F.col("size") * 2 > limit), F.col("last") - F.col("first"))).alias("large"),
            ).first()
            if now.least is None:
                break
            if not bins or (now.widest or 0) < now.least:
                number = now.large if not bins and now.large else -(-now.tokens // limit)  # no two large ones share a bin
                runs = written(opened(runs, limit, bins, number), "opened")
                bins += number  # the waiting pieces are as many at least, since none is longer than `limit`
            else:
                live = runs.where((F.col("kind") != MATCH) & (piece | (F.col("size") >= now.least)))
                live = live.withColumn("kind", F.when(F.col("kind") == LATER, GAP).otherwise(F.col("kind")))
                runs = written(matched(live, limit), "swept")
            done.append(runs.where(F.col("kind") == MATCH).drop("kind"))
        found = reduce(DataFrame.union, done).collect() if done else []
    return np.array(found, np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, vocabulary: str, end: int, limit: int, words: bool, doc_id: str, text: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a salt. A narrow map."""

    def cut(batches):
        encode = encoder(vocabulary, words).encode
        row = 0  # of the task, so that equal rows get different salts; the pieces are written before anything reads them
        for ids, texts in slices(batches, 1, 500_000):
            out = []
            for i, data in zip(ids, encode([t or "" for t in texts], end), strict=True):
                row += 1
                for k, begin in enumerate(range(0, len(data), 4 * limit)):
                    part = data[begin : begin + 4 * limit]
                    crc = zlib.crc32(part)
                    out.append((i, k, begin // 4, len(part) // 4, crc, (zlib.crc32(f"{i}:{k}:{crc}".encode()) + row) % SALTS))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECE_TYPES, strict=True)], PIECE_NAMES)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE_SCHEMA)


PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def packed(docs: DataFrame, vocabulary: str, end: int, limit: int = 4096, words: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are read and encoded once, where they lie; what is shuffled is a few numbers for each piece.
    """
    check_columns(docs, doc_id, text)
    rows = written(pieces(docs, vocabulary, end, limit, words, doc_id, text), "pieces")
    # Pieces of a length are ranked by salt, then by id: first the salts' counts (at most limit x SALTS rows), then rows.
    salted = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = written(salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    runs = plan(salted.groupBy("length").agg(F.sum("n").alias("n")), limit)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = runs[:, 0] << 44 | runs[:, 1]
    # The runs are bounded by sizes and rounds, not by documents; a sweep adds no more than one for each size it passes.
    shared = docs.sparkSession.sparkContext.broadcast((keys, runs))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("within", F.row_number().over(within) - 1)
    ranked = ranked.join(salted.select("length", "salt", "before"), ["length", "salt"])  # both sides lie by these keys

    def place(batches):
        keys, runs = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            bins, place = np.divmod(rank - run[:, 1], run[:, 5])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + bins), pa.array(run[:, 4] + place * length)], [*PIECE_NAMES[:5], "sequence_id", "offset"])

    ranked = ranked.select(*PIECE_NAMES[:5], (F.col("before") + F.col("within")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
