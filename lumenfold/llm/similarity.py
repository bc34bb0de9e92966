"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. A parity sketch XORs every shingle into one of k words: what two
sets share cancels out, and a shingle that only one of them has changes one word at most, so the number of differing
words, or of differing bits, is a lower bound of the symmetric difference. Sets of Jaccard similarity t or more, the
smaller of size n, differ in d = n(1-t)/t shingles at most; with k = d + 1 + x words, x + 1 of them agree at least. That
is the pigeonhole join, per band of sizes:

1. Rows with the same set are one class, whose smallest id represents it (sums of hashes; nothing is compared).
2. Coarse sketches (small x) of all representatives: a document of which too few words occur elsewhere can have no
   partner. Most documents end here. A task counts the words of a block of documents first and sends each word once,
   so that a word which a third of all documents share makes one row for each block.
3. Fine sketches (large x) of the rest. Of the words that two similar sets share, the rarest is among the d + 1 rarest
   of either, so only those are kept: what many documents have in common joins nothing.
4. Candidates that share a kept word are verified: first the Hamming distance of their sketches of 1024 bits, then the
   exact sets. There are three rounds: every document with the smallest member of the group it shares most words with;
   then with the smallest members of its other groups; then, where members of a group still lie in different
   components, across these components. A pair inside a component needs no test, so a large group of near copies costs
   about one test for each member, not one for each pair. The last round uses the sketch at its finest resolution, with
   a bit for every shingle hash: there the distance is the symmetric difference itself, and what each side lacks can be
   bounded on its own (see across()).
   After every round the links are closed to components by alternating large-star and small-star steps.

The joins on words are plain merge joins of written tables, whose hot keys Spark splits. Nothing is capped: a word of any
frequency stays in the join unless the pigeonhole bound shows that it isn't needed. Documents of one family that all lie
just below the threshold are still compared with each other where neither bound tells them apart.

Odd rows: a null or empty text, or one of white space, has the empty set and is linked with nothing. Rows with the same
id are one document: each gives an output row with its own set's size, and all have the document's component. A row with
a null id is linked with nothing and has a null component. Ties between hubs go to the smaller id. Very long texts are
hashed in blocks of a MB; their set (8 bytes for each distinct shingle) must fit in a task. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import check_columns, fresh, map_arrow, result_of, slices, written

RATIO = 1.3
#: Spare words of a coarse and of a fine sketch, as a share of d + 1.
COARSE, FINE = 0.2, 3.0
#: Tables of one or two numbers a row are broadcast up to so many rows, else merge-joined.
BROADCAST_ROWS = 1_000_000
#: Sketch words that a task counts together before it sends them.
BLOCK_KEYS = 500_000
#: Words of 64 bits in the sketch that candidates are tested with before their sets are.
BITS = 16
#: Bytes of text whose words are hashed together; longer words are hashed one by one.
HASHED, LONG = 1 << 20, 1 << 10
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * C3
    x = (x ^ (x >> np.uint64(29))) * C1
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte values (A-Z as a-z), white space, and powers of an odd number with their inverses modulo 2^64."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * C2)
    values[65:91] = values[97:123]
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    base = int(C2) | 1
    powers = [np.full(HASHED + LONG, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for p in powers:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    return values, white, *powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word of data, and the word's hash: a polynomial of its bytes, by sums over the data."""
    values, white, powers, inverse = hash_tables()
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], white[raw], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    long = ends - starts > LONG
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].lower())
    short = np.flatnonzero(~long)
    for begin in range(0, len(raw), HASHED):
        some = short[np.searchsorted(starts[short], begin) : np.searchsorted(starts[short], begin + HASHED)]
        if len(some):
            last = ends[some[-1]]
            sums = np.zeros(last - begin + 1, np.uint64)
            np.cumsum(values[raw[begin:last]] * powers[: last - begin], out=sums[1:])
            a, b = starts[some] - begin, ends[some] - begin
            out[some] = mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    return starts, out


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles. Words are separated by ASCII white space; A-Z count as
    a-z."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([0, *(len(b) + 1 for b in raw)])
    starts, h = word_hashes(b" ".join(raw))
    of = np.searchsorted(starts, begins)
    counts = np.diff(of)
    grams = np.zeros(0, np.uint64)
    if len(h) >= width:
        grams = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            grams = mixed(grams * C2 + h[i : len(h) - width + 1 + i])
    out = []
    for begin, n in zip(of[:-1].tolist(), counts.tolist(), strict=True):
        if n >= width:
            mine = np.sort(grams[begin : begin + n - width + 1])
            mine = mine[np.concatenate([[True], mine[1:] != mine[:-1]])] if len(mine) > 1 else mine
        else:
            mine = np.full(min(n, 1), n, np.uint64)
            for i in range(n):
                mine = mixed(mine * C2 + h[begin + i])
        out.append(mine)
    return out


def shingles(text: str | None, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """The least size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO) + 1))
    return np.array(out)


def sketch_keys(grams: np.ndarray, percent: int, spare: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each band in which a set takes part: the band, how many of its words must occur elsewhere, the words' keys."""
    n, starts = len(grams), bands()
    band = int(np.searchsorted(starts, n, "right")) - 1
    smallest = -(-percent * n // 100)  # the size that the smaller set of a pair has at least
    where = mixed(grams ^ C2) >> np.uint64(32)
    while band >= 0 and starts[band + 1] - 1 >= smallest:
        d = int(starts[band + 1] - 1) * (100 - percent) // percent
        x = -(-int(spare * 100) * (d + 1) // 100) if d else 0
        k = d + 1 + x
        block = ((where * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        ranked = block[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        words, places = np.bitwise_xor.reduceat(grams[order], first), ranked[first]
        empty = k - len(places)
        if empty > x:  # only then may two similar sets agree in empty words alone; all words are kept, then
            places = np.r_[places, np.setdiff1d(np.arange(k), places)]
            words = np.r_[words, np.zeros(empty, np.uint64)]
        yield band, max(1, x + 1 - empty), mixed(words + mixed((places + (band << 32) + 1).astype(np.uint64) * C2))
        band -= 1


def bit_sketch(grams: np.ndarray) -> np.ndarray:
    """The parity sketch of 64 x BITS bits: every shingle flips one."""
    bit = (mixed(grams + C3) >> np.uint64(64 - (64 * BITS - 1).bit_length())).astype(np.int64)
    odd = np.bincount(bit, minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def by_key(df: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """df joined with a written table, which is broadcast if it is counted small."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, key, how)


def words_of(docs: DataFrame, width: int, percent: int, spare: float) -> DataFrame:
    """rep, need (band and number of words that must occur elsewhere), key: the sketch words of each document."""

    def each(batches):
        for ids, texts in slices(batches, 1, HASHED):
            reps, needs, keys = [], [], []
            for i, grams in zip(ids, shingle_sets(texts, width), strict=True):
                for band, need, key in sketch_keys(grams, percent, spare) if len(grams) else ():
                    reps.append(np.full(len(key), i, np.int64))
                    needs.append(np.full(len(key), band << 32 | need, np.int64))
                    keys.append(key)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), pa.array(np.concatenate(needs)), pa.array(np.concatenate(keys).view(np.int64))], ["rep", "need", "key"])

    return docs.mapInArrow(each, "rep long, need long, key long")


def block_words(docs: DataFrame, width: int, percent: int, spare: float) -> DataFrame:
    """key, rep, need, held: the sketch words of each document, counted within blocks of documents.

    A word that one document of its block has is a row with held = 0. A word that several have is one row without a
    document, and each of these documents has a row with the number of such words, under a key of its own."""

    def counted(reps, needs, sizes, keys):
        key = np.concatenate(keys)
        of = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        last = np.concatenate([new[1:], [True]])
        alone = new & last
        live = np.bincount(of[order[~alone]], minlength=len(sizes))
        some = np.flatnonzero(live)
        reps, needs = np.array(reps, np.int64), np.array(needs, np.int64)
        single, shared = order[alone], order[new & ~alone]
        none = np.full(len(shared), -1, np.int64)
        own = mixed(reps[some].view(np.uint64) + needs[some].view(np.uint64) * C2)
        columns = [
            np.concatenate([key[single], key[shared], own]).view(np.int64),
            np.concatenate([reps[of[single]], none, reps[some]]),
            np.concatenate([needs[of[single]], none, needs[some]]),
            np.concatenate([np.zeros(len(single) + len(shared), np.int32), live[some].astype(np.int32)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "rep", "need", "held"])

    def each(batches):
        reps, needs, sizes, keys, n = [], [], [], [], 0
        for ids, texts in slices(batches, 1, HASHED):
            for i, grams in zip(ids, shingle_sets(texts, width), strict=True):
                for band, need, key in sketch_keys(grams, percent, spare) if len(grams) else ():
                    reps.append(i)
                    needs.append(band << 32 | need)
                    sizes.append(len(key))
                    keys.append(key)
                    n += len(key)
            if n > BLOCK_KEYS:
                yield from spread(counted(reps, needs, sizes, keys))
                reps, needs, sizes, keys, n = [], [], [], [], 0
        if n:
            yield from spread(counted(reps, needs, sizes, keys))

    def spread(batch, rows: int = 100_000):
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)

    return docs.mapInArrow(each, "key long, rep long, need long, held int")


def need() -> F.Column:
    return F.col("need").bitwiseAND((1 << 32) - 1)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of edges (a, b): large-star and small-star in turn.

    Every step groups by node with partial minima and merge-joins the minima back; its result is a written table.
    """

    def signature(df):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        return row.n, row.x

    def star(df, small):
        both = df if small else df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a's neighbours are in b; of the small star only those below a, which edges with a > b are.
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        joined = both.join(least, "a")
        if small:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        else:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return written(out.where("a != b").distinct(), "star")

    # Edges point from the larger node to the smaller.
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before, now = None, signature(edges)
    while now != before and now[0]:
        edges = star(star(edges, small=False), small=True)
        before, now = now, signature(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def edges_of(found: DataFrame) -> DataFrame:
    """Components as edges: a later closure starts from stars instead of all links again."""
    return found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough: sizes first, then sketches, then the sets themselves."""
    left = sets.select(F.col("rep").alias("a"), F.col("grams").alias("left"), F.col("bits").alias("one"))
    right = sets.select(F.col("rep").alias("b"), F.col("grams").alias("right"), F.col("bits").alias("two"))
    both = pairs.join(left, "a").join(right, "b")
    sizes = F.size("left") + F.size("right")
    near = F.least(F.size("left"), F.size("right")) * 100 >= F.greatest(F.size("left"), F.size("right")) * percent
    distance = F.aggregate(F.zip_with("one", "two", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    close = distance * (100 + percent) <= sizes * (100 - percent)
    common = F.size(F.array_intersect("left", "right"))
    # One condition after the other: a pair that the sketches tell apart is not intersected.
    return both.where(F.when(near & close, common * 100 >= (sizes - common) * percent).otherwise(F.lit(False))).select("a", "b").distinct()


def candidates(reps: DataFrame, width: int, percent: int) -> DataFrame | None:
    """rep, key: the words that join each document with documents that may be similar to it."""
    coarse = block_words(reps, width, percent, COARSE)
    occurring = F.count(F.when(F.col("held") == 0, 1)).over(Window.partitionBy("key"))
    live = F.when(F.col("held") > 0, F.col("held")).when(F.col("n") > 1, 1).otherwise(0)
    coarse = coarse.withColumn("n", occurring).where("(held > 0 OR n > 1) AND rep IS NOT NULL AND need >= 0")
    left = coarse.groupBy("rep", "need").agg(F.sum(live).alias("n")).where(F.col("n") >= need())
    left = written(left.select(F.col("rep").alias("doc_id")).distinct(), "coarse")
    fine = written(words_of(by_key(reps, left, "doc_id", "left_semi"), width, percent, FINE), "fine")
    shared = written(fine.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    rows = fine.join(shared, "key")
    mine = Window.partitionBy("rep", "need")
    rows = rows.withColumns({"live": F.count(F.lit(1)).over(mine), "rank": F.row_number().over(mine.orderBy("n", "key"))})
    return written(rows.where(F.col("rank") <= F.col("live") - need() + 1).select("rep", "key").distinct(), "kept")


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, the smallest id that links of Jaccard similarity
    of at least percent / 100 reach. The result is a written table; what was written on the way is dropped."""
    check_columns(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return result_of(docs.sparkSession, "similar", lambda: with_components(rows, width, percent))


def with_components(rows: DataFrame, width: int, percent: int) -> DataFrame:
    def make():
        def each(columns):
            sets = shingle_sets(columns[1], width)
            sums = np.array([[mixed(s ^ C1).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s + C1))] if len(s) else [0, 0] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["doc_id", "n_shingles", "h1", "h2"])

        return each

    sums = written(map_arrow(rows, make, "doc_id long, n_shingles long, h1 long, h2 long", chars=HASHED), "sets")
    some = sums.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    classes = written(classes.withColumn("class", F.struct("n_shingles", "h1", "h2")).select("class", "rep"), "classes")
    copies = by_key(some.withColumn("class", F.struct("n_shingles", "h1", "h2")), classes, "class").where("doc_id != rep")
    copies = written(copies.select("doc_id", "rep").distinct(), "copies")
    # An id with several sets is one document all the same: it stays a node of its own, with links to its classes.
    several = written(some.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("doc_id"), "several")
    given = by_key(copies, several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    copies = written(by_key(copies, several, "doc_id", "left_anti"), "copies")
    reps = by_key(rows.where("doc_id IS NOT NULL"), copies.select("doc_id"), "doc_id", "left_anti")
    found = links_closed(reps, given, width, percent)
    # A row's component is its representative's; who is neither a copy nor linked is a component of its own.
    named = by_key(sums.select("doc_id", "n_shingles"), copies, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    named = by_key(named, written(found.select(F.col("node").alias("rep"), "component"), "named"), "rep", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def links_closed(reps: DataFrame, given: DataFrame, width: int, percent: int) -> DataFrame:
    """node, component of the documents that have links, found or given."""
    kept = candidates(reps, width, percent)
    hubs = written(kept.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("key", "hub"), "hubs")
    if not hubs.take(1):
        return components(given)
    wanted = written(kept.join(hubs.select("key"), "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "wanted")

    def exact(batches):
        for ids, texts in slices(batches, 1, HASHED):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bit_sketch(s) for s in sets], pa.list_(pa.int64()))], ["rep", "grams", "bits"])

    sets = written(by_key(reps, wanted, "doc_id", "left_semi").mapInArrow(exact, "rep long, grams array<bigint>, bits array<bigint>"), "exact")
    spokes = kept.join(hubs, "key").where("rep != hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("n"))
    spokes = written(spokes.select(F.col("hub").alias("a"), F.col("rep").alias("b"), "n"), "spokes")
    # First round: with the smallest member of the group that shares most.
    first = written(spokes.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "first")
    found = written(components(written(linked(first, sets, percent).union(given), "links")), "components")
    # Second round: the smallest members of the other groups, where they lie elsewhere.
    second = written(apart(spokes.select("a", "b").join(first, ["a", "b"], "left_anti"), found), "second")
    if second.take(1):
        links = written(edges_of(found).union(linked(second, sets, percent)), "links")
        found = written(components(links), "components")
    # Third round: across the components that a group still has.
    placed = kept.join(hubs.select("key"), "key", "left_semi").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    placed = written(placed.select("key", "rep", F.coalesce("component", "rep").alias("component")), "placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_ = written(placed.join(open_, "key", "left_semi").select("rep", "component").distinct(), "open")
    if open_.take(1):
        third = written(across(sets.join(open_, "rep"), percent).join(first.union(second), ["a", "b"], "left_anti"), "third")
        links = written(edges_of(found).union(linked(third, sets, percent)), "links")
        found = written(components(links), "components")
    return found


def across(sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different components that may be similar, by the finest sketches: a bit for each shingle hash.

    Bits are ordered by how few of these documents have them. For sets of sizes n and m the first bit they share,
    at places i and j, leaves room for min(n - i + 1, m - j + 1) common ones, of which (n + m) t / (1 + t) are needed. A
    place that leaves too little for a partner of equal size can only pair with a smaller one, so two such places never
    join: what a family of variants has in common stands behind its own edits and is not enumerated.
    """
    size = F.size("grams").cast("long").alias("n")
    grams = sets.select("rep", "component", size, F.explode("grams").alias("gram"))
    often = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    mine = Window.partitionBy("rep")
    rows = grams.join(often, "gram")
    # Bits of one document alone come first and join nothing: they only count.
    at = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("often", "gram"))
    rows = rows.withColumn("room", F.col("n") - at + 1).where(F.col("room") >= F.ceil(F.col("n") * percent / 100))
    light = F.col("room") * (100 + percent) >= 2 * percent * F.col("n")
    rows = written(rows.select("rep", "component", "n", "gram", "room", light.alias("light")), "prefixes")
    other = rows.select("gram", F.col("rep").alias("b"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("room").alias("space"), F.col("light").alias("slight"))
    enough = F.least("room", "space") * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    pairs = rows.where("light").withColumnRenamed("rep", "a").join(other, "gram").where((F.col("component") != F.col("other")) & enough & (~F.col("slight") | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are in different components."""
    for side in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that have another component's smallest id: one document of each group stays, and
    so do rows with a null id. All columns stay."""
    name = fresh("gone", docs)
    gone = result_of(docs.sparkSession, "gone", lambda: similar_documents(docs, width, percent, doc_id, text).where("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct())
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")
