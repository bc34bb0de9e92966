"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at once inside a Python worker; the arrays made from them stay within some tens of MB.
SLICE_CHARS = 2_000_000
#: Bytes of an Arrow batch between the JVM and Python (a single longer row is a batch of its own), unless the session
#: names a bound of its own. Spark's default holds 64 MB, several times over, beside the heap.
BATCH_BYTES = 4 << 20
#: Tables in the shared folder that are dropped when the scratch block around them ends.
OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    folder; a cluster gets an error, since a folder of one machine would be wrong there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lumenfold-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one. It is dropped when the driver's Python ends."""
    path = f"{shared_folder(spark)}/lumenfold-{spark.sparkContext.applicationId}"
    seen = spark.sparkContext.__dict__.setdefault("_lumenfold_folders", set())
    if path not in seen:
        seen.add(path)
        atexit.register(dropped, spark, path)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of this package; what can't be deleted any more, as the JVM is gone, stays."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
    except Exception as e:  # noqa: BLE001  at the end of a session, py4j raises errors of many kinds
        print(f"lumenfold: {path} was not deleted: {e}")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and a lost executor costs nothing that was finished."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if OPEN:
        OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block are dropped when it ends; only what is written after it may outlive it."""
    OPEN.append([])
    try:
        yield
    finally:
        for path in OPEN.pop():
            dropped(spark, path)


def result_of(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, as a table; all tables that make() wrote on its way are dropped."""
    with scratch(spark):
        out = written(make(), name)
        path = OPEN[-1].pop()
    if OPEN:
        OPEN[-1].append(path)
    return out


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each session, so that they need not have it installed, and
    bounds the Arrow batches of a session that doesn't."""
    context = spark.sparkContext
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) == "67108864b":
        spark.conf.set(bound, str(BATCH_BYTES))
    if not getattr(context, "_lumenfold_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="lumenfold-")
        copy = os.path.join(folder, "tree", os.path.basename(package))
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, "lumenfold"), "zip", os.path.join(folder, "tree")))
        context._lumenfold_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, chars: int = SLICE_CHARS) -> Iterator[list[list]]:
    """The batches' columns as Python lists, cut so that a cut holds about `chars` bytes of column `text` at most
    (a single longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > chars:
                yield [c.to_pylist() for c in batch.slice(begin, i - begin).columns]
                begin, held = i, 0
            held += n + 16
        yield [c.to_pylist() for c in batch.slice(begin).columns]
    give_back()


def give_back() -> None:
    """Returns memory that a task has freed to the machine. Workers serve one task after the other, and what Arrow's pool
    and the C library keep for reuse would add to the next stage's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU C library has it
    if trim:
        trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[list[list]], pa.RecordBatch]], schema: str, text: int = 1, chars: int = SLICE_CHARS) -> DataFrame:
    """mapInArrow over slices. make() runs once in each task and returns what turns a slice's columns into a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for columns in slices(batches, text, chars):
            each = each or make()
            yield each(columns)

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the documents that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def spread_sample(df: DataFrame, rows: int, doc_id: str = "doc_id") -> DataFrame:
    """At most `rows` rows of df, chosen by a hash of the id, so that the choice does not depend on order or layout.
    Only if one id has so many rows that the hash alone doesn't hold the bound, a limit does."""
    n = df.count()
    if n <= rows:
        return df
    aim = max(1.0, rows - 4 * rows**0.5)
    sample = df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id)), F.lit(1 << 40)) < int(aim * (1 << 40) / n))
    return sample.limit(rows) if sample.count() > rows else sample


def check_columns(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"no column {name!r}; there are {df.columns}")


def fresh(name: str, *tables: DataFrame) -> str:
    """name, with underscores before it until no table has such a column."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_id_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, place, hash, text: ordered by place and hash, rows stand in ascending order of id (null first), equal ids
    in the order of a hash of the text. Both numbers have at most 53 bits, so that Spark's percentiles, which count in
    doubles, give elements of the columns."""
    i, t = F.col(doc_id).cast("long"), F.col(text).cast("string")
    ends = docs.agg(F.min(i).alias("low"), F.max(i).alias("high")).first()
    code = F.shiftrightunsigned(F.xxhash64(F.coalesce(t, F.lit(""))), 12)
    if ends.low is None or ends.high - ends.low < 1 << 52:
        place = F.coalesce(i - F.lit(ends.low or 0), F.lit(-1))
    else:  # the low bits of far apart ids go before the hash
        place = F.coalesce(F.shiftright(i, 12), F.lit(-(1 << 52)))
        code = F.shiftleft(F.coalesce(i.bitwiseAND(4095), F.lit(0)), 40).bitwiseOR(F.shiftrightunsigned(code, 12))
    return docs.select(i.alias("doc_id"), place.cast("long").alias("place"), code.cast("long").alias("hash"), t.alias("text"))


class Cuts:
    """Bounds that cut rows, ordered by place and then by hash, into ranges of about equal numbers of rows.

    Row (place, hash) lies in the range behind the last bound that isn't greater. A place with more rows than a range
    has bounds by hash as well, and where equal rows alone fill several ranges, they are dealt out by their number."""

    #: Rows of a range, at most about, beside what the session's number of shuffle partitions asks for.
    ROWS = 250_000
    LOW = -1

    def __init__(self, rows: DataFrame, parts: int | None = None):
        """rows: as in_id_order() gives them. Only elements of place and hash go to the driver, one a range."""
        n = rows.count()
        parts = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // self.ROWS))
        shares = [i / parts for i in range(1, parts)] or [0.5]
        found = rows.agg(F.min("place").alias("first"), F.percentile_approx("place", shares, 10 * parts).alias("cuts")).first()
        self.first, cuts = found.first, (list(found.cuts or []) if parts > 1 else [])
        times = {c: cuts.count(c) for c in dict.fromkeys(cuts)}
        often = {c: k for c, k in times.items() if k > 1}
        self.least: dict[int, int] = {}
        inner: dict[int, list[int]] = {}
        if often:
            most = max(often.values())
            hot = rows.where(F.col("place").isin(list(often))).groupBy("place")
            for r in hot.agg(F.min("hash").alias("least"), F.percentile_approx("hash", [i / most for i in range(1, most)], 10 * most).alias("cuts")).collect():
                k = often[r.place]
                self.least[r.place] = r.least
                inner[r.place] = [r.cuts[i * most // k - 1] for i in range(1, k)]
        self.bounds = sorted((c, h) for c in times for h in [self.least.get(c, self.LOW), *inner.get(c, [])])
        if self.bounds and self.bounds[0] == (self.first, self.least.get(self.first, self.LOW)):
            del self.bounds[0]  # nothing lies before it
        self.ranges = len(self.bounds) + 1

    def range_of(self, row: tuple[int, int], number: int) -> int:
        low, high = bisect_left(self.bounds, row), bisect_right(self.bounds, row)
        return low + 1 + number % (high - low) if high > low else high

    def begun_by(self, row: tuple[int, int]) -> range:
        """The ranges whose first row may be this one."""
        if row[0] not in self.least:
            row = row[0], self.LOW
        return range(bisect_left(self.bounds, row) + 1, bisect_right(self.bounds, row) + 1)

    def is_first(self, row: tuple[int, int]) -> bool:
        """Whether no row lies before this one, but perhaps some of a place with few rows."""
        return row[0] == self.first and self.least.get(row[0], row[1]) == row[1]
