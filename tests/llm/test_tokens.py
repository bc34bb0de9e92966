"""Token counts, ids, files and packing against the tokenizers library."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from data import empty, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenfold.llm import packing, token_file
from lumenfold.llm.chunk_encoder import ChunkEncoder
from lumenfold.llm.token_counts import MergeCounter, token_counts

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = "aAbB 's'T  éÉßçÀñ\n\t.,!?<|endoftext|>0123456789ЖΣσς日本́ẛ̣\x1c\x1dİǅﬁ🙂👩‍👧{}#\u0085\u00a0"


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def odd_texts(n):
    draw = random.Random(4)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 50))) for _ in range(n)] + ["a" * 4000, "ha" * 2000, "=-" * 900, "", " ", "  ", "\n \n", "<|startoftext|><|endoftext|>"]


def test_counts_equal_the_library(library):
    texts = odd_texts(4000)
    assert MergeCounter(WORD).count(texts) == [len(e.ids) for e in library[WORD].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    for path, words in ((WORD, True), (BYTE, False)):
        encoder = KEPT.setdefault(path, ChunkEncoder(path, words))
        assert list(memoryview(encoder.encode([text], 7)[0]).cast("I")) == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 7]
    assert KEPT.setdefault("count", MergeCounter(WORD)).count([text]) == [len(KEPT[WORD].tokenizer.encode(text, add_special_tokens=False).ids)]


KEPT: dict = {}


@pytest.mark.parametrize("path,words", [(WORD, True), (BYTE, False)])
def test_ids_equal_the_library(library, path, words):
    texts = odd_texts(4000)
    got = ChunkEncoder(path, words).encode(texts, 3)
    assert [list(memoryview(b).cast("I")) for b in got] == [[*e.ids, 3] for e in library[path].encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path,words", [(WORD, True), (BYTE, False)])
def test_accented_words_need_no_pattern(library, path, words):
    """Single words with accents, also before a comma or full stop, were cut by the pattern each time."""
    texts = ["Árbol señor, niño. çà ªº ßÿ", "été, ñ. ÀÉ café café, café."]
    encoder = ChunkEncoder(path, words)
    encoder.pattern = None
    got = encoder.encode(texts, 3)
    assert [list(memoryview(b).cast("I")) for b in got] == [[*e.ids, 3] for e in library[path].encode_batch(texts, add_special_tokens=False)]


def test_count_query(spark, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark), WORD, limit=100).collect()}
    for i, text, *_ in rows():
        n = len(library[WORD].encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 100)
    assert token_counts(empty(spark), WORD).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [5] * 2000, list(range(3000)), [2**31, 1, 2**32 - 1]])
def test_shard_round_trip(ids):
    draw = np.random.default_rng(1)
    for documents in ([np.array(ids, np.uint32)], [draw.integers(0, 50_000, n, dtype=np.uint32) for n in (0, 1, 600, 0, 1300)]):
        shard = token_file.Shard(token_file.encode_shard(documents))
        flat = np.concatenate(documents)
        assert shard.ids == len(flat) and shard.docs == len(documents) and (shard.all() == flat).all()
        assert [shard.id(i) for i in range(len(flat))] == flat.tolist()
        assert all((shard.document(k) == d).all() for k, d in enumerate(documents))


@pytest.mark.parametrize("width", range(1, 33))
def test_bits_side_by_side(width):
    draw = random.Random(width)
    for n in (0, 1, 63, 64, 65, 300):
        values = [draw.choice([0, (1 << width) - 1, draw.randrange(1 << width)]) for _ in range(n)]
        data = token_file.packed(np.array(values, np.uint32), width)
        assert data == sum(v << k * width for k, v in enumerate(values)).to_bytes(-(-n * width // 8), "little")
        assert token_file.unpacked(np.frombuffer(data, np.uint8), width, n).tolist() == values


def test_a_shard_takes_no_matrix_of_bits():
    """Time went into arrays with an element for each bit of each id."""
    ids = np.random.default_rng(2).integers(0, 50_000, 1 << 18, dtype=np.uint32)
    tracemalloc.start()
    try:
        shard = token_file.Shard(token_file.encode_shard([ids]))
        assert (shard.all() == ids).all()
        assert tracemalloc.get_traced_memory()[1] < 64 * len(ids)
    finally:
        tracemalloc.stop()


def test_token_files(spark, library, tmp_path):
    path = str(tmp_path / "files")
    token_file.write_token_files(frame(spark), path, BYTE, end=0, parts=5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_file.read_token_files(spark, path).collect()}
    start = 0
    for i, text, *_ in sorted(rows()):
        ids = [*library[BYTE].encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_file.write_token_files(empty(spark), str(tmp_path / "none"), BYTE, end=0)
    assert token_file.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    data = [(7, "same", None, None, 4)] * 3 + [(None, "no id", None, None, 5), (7, "other", None, None, 5)]
    path = str(tmp_path / "files")
    token_file.write_token_files(frame(spark, data), path, BYTE, end=0)
    got = sorted((r.start, r.n_tokens) for r in token_file.read_token_files(spark, path).collect())
    assert len(got) == 5 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))
    assert packing.packed(frame(spark, data), WORD, 1, 16).count() == 5


def check_plan(spark, counts, limit):
    """The number of bins of a plan whose bins are gapless, hold `limit` at most, and have every piece once."""
    runs = packing.plan(spark.createDataFrame(sorted(counts.items()), "length long, n long"), limit)
    placed, bins = Counter(), {}
    for length, a, b, first, offset, fit in runs.tolist():
        for rank in range(a, b):
            placed[length, rank] += 1
            bins.setdefault(first + (rank - a) // fit, []).append((offset + (rank - a) % fit * length, length))
    assert placed == Counter((n, r) for n, k in counts.items() for r in range(k))
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= limit
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def best_fit(counts, limit):
    """Plain best fit of one piece after the other, longest first: the number of bins."""
    gaps = []
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= n), key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(limit)
            at = len(gaps) - 1
        gaps[at] -= n
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_near_best_fit(spark, seed):
    r = random.Random(seed)
    counts = {r.randint(1, 60): r.randint(1, 200) for _ in range(r.choice([1, 3, 15, 40]))}
    assert check_plan(spark, counts, 60) <= 1.05 * best_fit(counts, 60) + 1


def test_plan_of_extremes(spark):
    assert check_plan(spark, {64: 3}, 64) == 3
    assert check_plan(spark, {1: 129}, 64) == 3
    assert check_plan(spark, {33: 5, 31: 5}, 64) == 5
    assert check_plan(spark, {1: 1}, 1) == 1


RUNS = st.lists(st.tuples(st.sampled_from([packing.GAP, packing.PIECE]), st.integers(1, 64), st.integers(1, 9)), max_size=40)


@settings(max_examples=300, deadline=None)
@given(RUNS)
def test_sweeps_of_ranges_give_the_matches_of_one_sweep(found):
    """Also against a plain version that takes one piece after the other."""
    limit, runs, pieces, bins = 64, [], {}, 0
    for kind, size, n in found:
        if kind == packing.PIECE:
            pieces[size] = n
        else:
            runs.append((kind, size, bins, bins + n, 0, 0, 0))
            bins += n
    runs += [(packing.PIECE, size, 0, n, 0, 0, 0) for size, n in pieces.items()]

    def matches(rows):
        return sorted((size, rank, bin_ + (rank - a) // fit, offset + (rank - a) % fit * size) for kind, size, a, b, bin_, offset, fit in rows if kind == packing.MATCH for rank in range(a, b))

    parts = [packing.sweep([r for r in runs if (limit - r[1]) * 16 // (limit + 1) == part], limit) for part in range(16)]
    while len(parts) > 1:
        parts = [packing.sweep([r for p in parts[i : i + 4] for r in p], limit) for i in range(0, len(parts), 4)]
    got = matches(parts[0])
    assert got == matches(packing.sweep(runs, limit))

    gaps = {b: size for kind, size, a, e, *_ in runs if kind == packing.GAP for b in range(a, e)}
    fill, taker, sizes = {}, {}, []
    for size in sorted(pieces, reverse=True):
        for _ in range(pieces[size]):
            # A bin takes pieces of one size a round; the least gap that holds the piece is the successor.
            fits = [gaps[b] - fill.get(b, 0) for b in gaps if taker.get(b, size) == size and gaps[b] - fill.get(b, 0) >= size]
            begun = [b for b in gaps if taker.get(b) == size and gaps[b] - fill[b] >= size]
            if not fits:
                break
            bin_ = begun[0] if begun else min((b for b in gaps if b not in taker and gaps[b] >= size), key=lambda b: gaps[b])
            taker[bin_] = size
            sizes.append((size, limit - gaps[bin_] + fill.get(bin_, 0), gaps[bin_]))
            fill[bin_] = fill.get(bin_, 0) + size
    of = {b: g for b, g in gaps.items()}
    assert sorted((size, offset, of[b]) for size, _, b, offset in got) == sorted(sizes)


def test_plan_fills_sequences(spark):
    lengths = np.clip(np.random.default_rng(1).lognormal(6.5, 0.9, 20_000).astype(int), 1, 4096)
    counts = Counter(lengths.tolist())
    assert check_plan(spark, counts, 4096) <= 1.003 * lengths.sum() / 4096


def test_packing(spark, library):
    got = packing.packed(frame(spark), WORD, 1, 64).collect()
    want, bins = {}, {}
    for i, text, *_ in rows():
        ids = [*library[WORD].encode(text or "", add_special_tokens=False).ids, 1]
        for k, begin in enumerate(range(0, len(ids), 64)):
            part = ids[begin : begin + 64]
            want[i, k] = (begin, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(content), sorted(content)[1:], strict=False)) and min(content)[0] == 0
        assert sum(n for _, n in content) <= 64
    assert packing.packed(empty(spark), WORD, 1).count() == 0
