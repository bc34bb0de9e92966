"""Benchmark decontamination by spaced seeds. DataFrame functions only.

Words are runs of letters and digits, lower-cased; in scripts that don't part words by spaces each letter is one. A
mask is a fixed set of places in a short window; a window's seed is the hash of the words at those places, so that words
at the other places may differ. Seeds of the benchmark items are joined with seeds of all windows of all documents. A
hit gives an item, a document and their alignment; around it the item's and the document's words are compared place by
place, and the document is contaminated by the item if some stretch of `stretch` words (or the whole item, if it is
shorter) has at least `share` of them equal.

The masks miss no stretch that the comparison would accept: whichever words of it differ, a window of one mask has none
of them. An item shorter than a stretch has masks by its own number of words: the same, the lighter ones of SHORT, or a
run of words that always is left equal, the first of these that miss nothing. Documents have windows of those masks only
that some item needs. Where no word may differ (one to three words at a share of 0.75) the seed is of the whole item.

Nulls and odd rows: null and empty texts have no words and no hits. An item of one word is found in every document that
has the word. A document with a null id can't be named and is not reported, and so can't an item. Repeated documents and
items are judged like any other; the result has one row for each pair of ids. Of several places in a document the one
with the best stretch counts, of equal ones that with more equal words, then the first. A very long text is one row while
it is cut into words; beyond that, each of its hits carries an item's length of words. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, fresh, result_of, written

#: Places of a window whose words count. These two hit all stretches of 9 words or more with a quarter of them replaced.
MASKS = ((0, 1, 2, 4), (0, 3, 4, 5))
#: For items of 4 to 8 words, a quarter of them replaced.
SHORT = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Seeds of the benchmark (16 bytes and two small numbers each) are broadcast up to so many, else merge-joined.
BROADCAST_SEEDS = 1_000_000
#: Alignments to verify (three numbers each) are broadcast to the documents up to so many, else merge-joined.
BROADCAST_HITS = 500_000
OTHER = r"[^\p{L}\p{N}]+"
#: Letters of scripts without spaces between words.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def words(text: Column) -> Column:
    """The text's words; an array with one empty word if it has none."""
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNSPACED, " $1 ")
    clean = F.regexp_replace(apart, rf"\A{OTHER}|{OTHER}\z", "")
    return F.split(clean, OTHER)


def hit_all(masks: Sequence[Sequence[int]], length: int, wrong: int) -> bool:
    """Whether any choice of `wrong` words out of `length` leaves some window of some mask without one of them."""
    if comb(length, wrong) > 100_000:  # too many to try
        return False
    windows = [{b + o for o in mask} for mask in masks for b in range(length - max(mask))]
    return all(any(w.isdisjoint(c) for w in windows) for c in combinations(range(length), wrong))


def complete(masks: Sequence[Sequence[int]], length: int, share: float) -> tuple[tuple[int, ...], ...]:
    """The masks, if they hit all stretches of that length with `share` of their words equal; else SHORT if it does; else
    the longest run of equal words that every such stretch has."""
    equal = max(1, ceil(share * length))
    wrong = length - equal
    run = tuple(range(ceil(equal / (wrong + 1))))
    if wrong == 0:
        return (run,)
    return next((tuple(map(tuple, m)) for m in (masks, SHORT) if hit_all(m, length, wrong)), (run,))


def seeds(hashes: Column, mask: Sequence[int], number: int) -> Column:
    """The seeds of all windows of an array of word hashes, in order; an empty array if it is shorter than the mask."""
    span = max(mask) + 1
    places = F.when(F.size(hashes) >= span, F.sequence(F.lit(0), F.size(hashes) - span)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(number), *[F.get(hashes, i + o) for o in mask]))


def seeded(df: DataFrame, key: str, masks: Sequence[Sequence[int]], needed: Callable[[int], Column] | None = None) -> DataFrame:
    """key, seed, at (the word at which its window begins), from columns key and words. needed(number) says of a row
    whether it has seeds of that mask; all do by default."""
    none = F.array().cast("array<bigint>")
    hashed = df.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    arrays = [seeds(F.col("hashes"), mask, k) for k, mask in enumerate(masks)]
    arrays = [F.when(needed(k), a).otherwise(none) for k, a in enumerate(arrays)] if needed else arrays
    arrays = hashed.select(key, *[a.alias(f"m{k}") for k, a in enumerate(arrays)])
    # One generator for all masks: the arrays in a row, and how many windows the earlier masks have.
    sizes = [F.size(f"m{k}") for k in range(len(masks))]
    arrays = arrays.select(key, F.concat(*[f"m{k}" for k in range(len(masks))]).alias("all"), *[s.alias(f"n{k}") for k, s in enumerate(sizes[:-1])])
    # The outer form, since for the inner one Spark infers a filter that would compute the arrays twice, word by word;
    # the null seed of a text without windows joins with nothing.
    rows = arrays.select(key, *[f"n{k}" for k in range(len(masks) - 1)], F.posexplode_outer("all").alias("at", "seed"))
    at = F.col("at")
    for k in range(len(masks) - 1):  # a place beyond a mask's windows belongs to a later one
        before = sum((F.col(f"n{j}") for j in range(k + 1)), F.lit(0))
        at = F.when(F.col("at") >= before, F.col("at") - before).otherwise(at)
    return rows.select(key, "seed", at.alias("at"))


def stretches(same: Column, length: Column) -> Column:
    """The most equal words in any stretch of that length, from an array of 1 (equal) and 0."""
    starts = F.sequence(F.lit(1), F.size(same) - length + 1)
    return F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice(same, i, length), F.lit(0), lambda a, x: a + x)))


def contaminated(docs: DataFrame, benchmark: DataFrame, stretch: int = 13, share: float = 0.75, masks: Sequence[Sequence[int]] = MASKS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each pair of a document and an item that contaminates it: doc_id, item_id, doc_word (where the item
    would begin in the document), n_words and n_equal (of the item), best_stretch (equal words in its best stretch).
    The result is a written table; what was written on the way is dropped."""
    check_columns(docs, doc_id, text)
    check_columns(benchmark, item_id, item_text)
    names = (doc_id, text, item_id, item_text)
    return result_of(docs.sparkSession, "pairs", lambda: compared(docs, benchmark, stretch, share, masks, *names))


def compared(docs: DataFrame, benchmark: DataFrame, stretch: int, share: float, masks: Sequence[Sequence[int]], doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), words(F.col(item_text)).alias("words"))
    items = written(items.withColumn("n", F.least(F.lit(stretch), F.size("words"))).where((F.col("words")[0] != "") & F.col("item_id").isNotNull()), "items")
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # The items' numbers of words, up to a stretch, and the masks of each.
    wanted = {r.n: complete(masks, r.n, share) for r in items.select("n").distinct().collect()}
    if not wanted:
        wanted = {stretch: complete(masks, stretch, share)}
    used = list(dict.fromkeys(m for n in sorted(wanted, reverse=True) for m in wanted[n]))
    exact = [n for n in wanted if ceil(share * n) >= n]
    named = items.withColumn("item", F.struct("item_id", F.col("n").isin(exact).alias("whole")))
    known = seeded(named, "item", used, lambda k: F.col("n").isin([n for n in wanted if used[k] in wanted[n]]))
    known = written(known.where(F.col("seed").isNotNull()).select("item.*", "seed", F.col("at").alias("item_at")).distinct(), "seeds")
    if known.count() <= BROADCAST_SEEDS:
        known = F.broadcast(known)
    windows = seeded(texts.select("doc_id", words(F.col("text")).alias("words")), "doc_id", used)
    hits = windows.join(known, "seed").select("doc_id", "item_id", "whole", (F.col("at") - F.col("item_at")).alias("shift"))
    # Of an item that must be equal as a whole the first place is enough.
    hits = hits.groupBy("doc_id", "item_id", F.when(~F.col("whole"), F.col("shift")).alias("place")).agg(F.min("shift").alias("shift"))
    hits = written(hits.select("doc_id", "item_id", "shift"), "hits")
    small = hits.count() <= BROADCAST_HITS
    # The words of a document with hits are written once, however many hits it has; also, Spark would otherwise put the
    # splitting of the text into the function of each word.
    hit = hits.select("doc_id").distinct()
    cut = written(texts.join(F.broadcast(hit) if small else hit, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("words")), "cut")
    # Of a document's words only the item's place goes on: what a hit costs depends on the item's length alone.
    sized = hits.join(items.select("item_id", F.size("words").alias("n_words")), "item_id")
    begin = F.greatest(F.col("shift"), F.lit(0))
    placed = cut.join(F.broadcast(sized) if small else sized, "doc_id")
    placed = written(placed.select("doc_id", "item_id", "shift", "n_words", F.slice("words", begin + 1, F.col("n_words")).alias("place")), "placed")
    aligned = placed.join(items.select("item_id", F.col("words").alias("item")), "item_id")
    # A word of the item that would lie before or behind the document has no partner: get() gives null there.
    skipped = F.least(F.col("shift"), F.lit(0))
    same = F.transform("item", lambda w, i: F.coalesce((F.get("place", i + skipped) == w).cast("int"), F.lit(0)))
    aligned = aligned.select("doc_id", "item_id", "shift", "n_words", same.alias("same"))
    length = F.least(F.lit(stretch), F.col("n_words"))
    aligned = written(aligned, "compared").withColumn("best_stretch", stretches(F.col("same"), length)).where(F.col("best_stretch") >= F.ceil(share * length))
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    best = F.max(F.struct("best_stretch", total.alias("n_equal"), (-F.col("shift")).alias("before"), "n_words")).alias("best")
    pairs = aligned.groupBy("doc_id", "item_id").agg(best)
    return pairs.select("doc_id", "item_id", (-F.col("best.before")).alias("doc_word"), "best.n_words", "best.n_equal", "best.best_stretch")


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose id is in no contaminated pair; rows with a null id stay. All columns stay."""
    name = fresh("bad_id", docs)
    bad = result_of(docs.sparkSession, "contaminated", lambda: contaminated(docs, benchmark, doc_id=doc_id, **options).select(F.col("doc_id").alias(name)).distinct())
    small = bad.count() <= BROADCAST_HITS
    return docs.join(F.broadcast(bad) if small else bad, F.col(doc_id).cast("long") == F.col(name), "left_anti")
