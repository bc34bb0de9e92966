"""Language, quality, fingerprints, personal data, decontamination, URLs and similarity against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from data import SCHEMA, WORDS, empty, frame, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.llm import decontamination, fingerprint, language, pii, quality, similarity, url_filter

# ------------------------------------------------------------------ language


def test_language(spark):
    data = [(i, prose(random.Random(i), lang, 60), lang, None, 0) for i in range(150) for lang in [sorted(WORDS)[i % 3]]]
    model = language.learn(frame(spark, data))
    assert model.languages == sorted(WORDS)
    got = {r.doc_id: r for r in language.languages(frame(spark, data), model).collect()}
    assert len(got) == 150 and any(r.held_out for r in got.values())
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang, _, _ in data)
    assert all(got[i].held_out == (__import__("zlib").crc32(str(i).encode()) % 5 == 0) for i in got)
    mixed = prose(random.Random(1), "en", 40) + " " + prose(random.Random(2), "de", 20)
    odd = {1: None, 2: "", 3: " 12 ,. ", 4: "привет мир", 5: mixed, 6: "schön " * 30_000}
    got = {r.doc_id: r for r in language.languages(frame(spark, [(k, t, None, None, 0) for k, t in odd.items()]), model).collect()}
    assert all((got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, "") for k in (1, 2, 3))
    assert got[4].lang_pred in WORDS and got[4].score == pytest.approx(1 / 3)
    assert got[5].spans == "en:0:40,de:40:60" and got[5].lang_pred == "en" and 0.5 < got[5].score < 0.9
    assert got[6].lang_pred == "de"
    kept = language.determined(frame(spark, [(k, t, None, None, 0) for k, t in odd.items()]), model)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6] and kept.columns == frame(spark, []).columns
    assert [r.doc_id for r in language.determined(frame(spark, [(k, t, None, None, 0) for k, t in odd.items()]), model, least=0.9).collect()] == [6]
    assert [r.doc_id for r in language.determined(frame(spark, [(k, t, None, None, 0) for k, t in odd.items()]), model, accepted=["en"]).collect()] == [5]
    repeated = frame(spark, [(7, odd[5], None, None, 0), (7, odd[5], None, None, 0), (None, odd[6], None, None, 0)])
    assert sorted((str(r.doc_id), r.lang_pred) for r in language.languages(repeated, model).collect()) == [("7", "en"), ("7", "en"), ("None", "de")]


def test_language_without_rows(spark):
    model = language.learn(empty(spark))
    assert model.languages == [] and language.languages(empty(spark), model).count() == 0
    assert {r.lang_pred for r in language.languages(frame(spark), model).collect()} == {"und"}
    assert language.determined(frame(spark), model).count() == len(rows())


def test_word_scores():
    """Counts and scores of letter n-grams by plain loops, and more languages than a byte numbers."""
    draw = random.Random(4)
    names = [f"l{i:03}" for i in range(150)]
    logs = np.random.Generator(np.random.PCG64(1)).normal(size=(3, language.BUCKETS, 150)).astype(np.float32)
    uses = np.zeros((len(language.NAMES), 150), bool)
    uses[language.NAMES.index("latin")] = True
    uses[language.NAMES.index("greek"), 140:] = True
    model = language.LanguageModel(names, logs, uses, 0)
    words = ["".join(draw.choice("abcé'αβЖ7") for _ in range(draw.randrange(1, 9))) for _ in range(200)]
    scores, letters = model.word_scores(words)
    word, shift = (1 << 64) - 1, lambda x: x >> 48

    def bucket(c):  # c: the letter two before, before, itself, after; 1 for what is no letter
        mix = 0x9E3779B97F4A7C15
        two = (c[1] * 0x100000001B3 + c[2]) * mix & word
        three = ((two ^ c[3]) + 0x632BE59BD9B4E019) * mix & word
        return shift(two), shift(three), shift(((three ^ c[0]) + 0x85157AF5) * mix & word)

    for w, got, n in zip(words, scores, letters, strict=True):
        padded = "\n\n" + w.lower() + "\n\n"
        code = [ord(c) if c.isalpha() else 1 for c in padded]
        want = np.zeros(150)
        for i, c in enumerate(padded):
            if c.isalpha():
                script = "greek" if c in "αβ" else "cyrillic" if c == "ж" else "latin"
                if script != "cyrillic":
                    each = sum(logs[k][g].astype(np.float64) for k, g in enumerate(bucket(code[i - 2 : i + 2]))) / 3
                    want += np.where(uses[language.NAMES.index(script)], each, -14)
        assert n == sum(map(str.isalpha, w)) and np.allclose(got, want, atol=1e-3)
    labels = language.viterbi(np.where(np.arange(150) == 149, 0.0, -1.0)[None].repeat(5, 0).astype(np.float32), np.array([5]), 1.0)
    assert labels.tolist() == [149] * 5
    found = language.Labeller(model, 0.0).label(["ααα βββ"])
    assert found[0][0] >= "l140" and found[0][2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-9, 0), st.integers(-9, 0), st.integers(-9, 0)), min_size=1, max_size=6), min_size=1, max_size=4), st.integers(0, 6))
def test_viterbi_finds_the_best_path(texts, penalty):
    from itertools import product

    texts = sorted(texts, key=len, reverse=True)
    labels = language.viterbi(np.array([w for t in texts for w in t], np.float32), np.array([len(t) for t in texts]), penalty)
    worth = lambda t, path: sum(w[s] for w, s in zip(t, path, strict=True)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))
    for t in texts:
        mine, labels = labels[: len(t)], labels[len(t) :]
        assert worth(t, list(mine)) == max(worth(t, p) for p in product(range(3), repeat=len(t)))


# ------------------------------------------------------------------ quality


def test_quality(spark):
    draw = random.Random(3)
    good = lambda: prose(draw, "en", 50)
    data = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), "en", None, 0) for i in range(400)]
    labels = spark.createDataFrame([(i, min(1, i % 3)) for i in range(400)] + [(401, None), (5000, 1)], "doc_id long, quality int")
    model = quality.learn(frame(spark, data), labels)
    out = quality.scores(frame(spark, [*data, (900, None, None, None, 0), (901, "", None, None, 0), (902, "wort " * 20_000, None, None, 0)]), model).collect()
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == min(1, r.doc_id % 3) for r in held) > 0.95 * len(held)
    none = quality.learn(empty(spark), labels.where("false"))
    assert {r.score for r in quality.scores(frame(spark), none).collect()} == {0.5} and quality.scores(empty(spark), model).count() == 0


def test_temperature_calibrates():
    draw = np.random.default_rng(0)
    logits = draw.normal(0, 2, 20_000)
    y = (draw.random(20_000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert quality.fit_temperature(3 * logits, y) == pytest.approx(3, rel=0.1)


# ------------------------------------------------------------------ fingerprints


def plain_components(text):
    """The selection recomputed k-mer by k-mer, with Python's integers."""
    word = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 31)) * int(fingerprint.ODD[0]) & word
        return x ^ (x >> 29)

    if not text:
        return [0] * fingerprint.SIZE
    k = min(fingerprint.K, len(text))
    grams = []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * int(fingerprint.ODD[1]) + ord(c)) & word
        grams.append(mixed((h + k) & word))
    bits = max(20, len(grams).bit_length())
    numbered, seen = [], {}
    for place, h in enumerate(grams):
        h >>= bits
        number = seen[h] = seen.get(h, -1) + 1
        numbered.append((h, place, mixed((h * int(fingerprint.ODD[2]) + number) & word) >> 32))
    out = []
    for seed in map(int, fingerprint.SEEDS):
        value = lambda key: (v := key * seed & 0xFFFFFFFF) ^ (v >> 15)  # noqa: B023, E731
        chosen = sorted(numbered, key=lambda x: (value(x[2]), x[0], x[1]))[: fingerprint.TUPLE]  # noqa: B023
        h = 0
        for place in sorted(x[1] for x in chosen):
            h = mixed((h * int(fingerprint.ODD[1]) + grams[place]) & word)
        out.append(h >> 32)
    return out


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab ", max_size=300)))
def test_selection(text):
    assert fingerprint.components(text).tolist() == plain_components(text)


def test_selection_in_blocks():
    draw = random.Random(3)
    text = "".join(draw.choice("abcde ") for _ in range(3 * fingerprint.BLOCK + 17))
    assert fingerprint.components(text).tolist() == plain_components(text)


def neighbours(data, got):
    """Each row's values against plain ones; got: rows by id and text."""
    import xxhash

    ordered = sorted(data, key=lambda d: (-(1 << 63) if d[0] is None else d[0], xxhash.xxh64_intdigest((d[1] or "").encode(), 42) >> 12))
    want = []
    for k, (i, text) in enumerate((i, t or "") for i, t in ordered):
        following = ordered[(k + 1) % len(ordered)][1] or ""
        q = len(text) // 4
        changed = text[: len(text) - q] + following[:q]
        mine, new, theirs = map(fingerprint.components, (text, changed, following))
        want.append((str(i), len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.hexadecimal(mine), fingerprint.hexadecimal(new), float(np.mean(mine == new)), float(np.mean(mine == theirs))))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_fingerprints_of_neighbours(spark):
    data = rows()
    got = fingerprint.edit_likeness(frame(spark, data), parts=7).collect()
    neighbours([d[:2] for d in data], got)
    named = {r.doc_id: r for r in got}
    assert named[1004].fingerprint == named[1005].fingerprint
    assert named[1000].fingerprint == named[1001].fingerprint == "0" * 8 * fingerprint.SIZE


@pytest.mark.parametrize("parts", [1, 2, 9, 40])
def test_fingerprints_with_one_frequent_id(spark, parts):
    draw = random.Random(parts)
    data = [(draw.choice([None, None, 5, 5, draw.randrange(30)]), draw.choice([None, "same text"] + [f"{i} " * (1 + i % 4) for i in range(20)])) for _ in range(150)]
    got = fingerprint.edit_likeness(frame(spark, [(i, t, None, None, 0) for i, t in data]), parts=parts).collect()
    neighbours(data, got)


def test_fingerprints_with_far_apart_ids(spark):
    draw = random.Random(8)
    data = [(draw.choice([None, draw.randrange(-(1 << 63), 1 << 63), (1 << 60) + draw.randrange(500)]), f"{i} {i % 3}") for i in range(200)]
    got = fingerprint.edit_likeness(frame(spark, [(i, t, None, None, 0) for i, t in data]), parts=12).collect()
    ids = sorted((d for d in data if d[0] is not None), key=lambda d: d[0])
    following = {a[0]: fingerprint.edited(a[1], b[1]) for a, b in zip(ids, ids[1:], strict=False) if a[0] != b[0]}
    found = {r.doc_id: r.edited_sha256 for r in got}
    single = [i for i in following if [d[0] for d in ids].count(i) == 1]
    assert len(got) == 200 and len(single) > 50
    assert all(found[i] == hashlib.sha256(following[i].encode()).hexdigest() for i in single if [d[0] for d in ids].count(ids[[d[0] for d in ids].index(i) + 1][0]) == 1)


def test_fingerprints_follow_edits_and_order():
    draw = random.Random(1)
    words = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    near = lambda changed: fingerprint.likeness(fingerprint.components(" ".join(words)), fingerprint.components(" ".join(changed)))
    assert near(words) == 1
    assert near(words[:390]) > 0.8 > near(words[:300]) > near(words[:100])
    assert near(words[200:] + words[:200]) < 0.9  # the same words in another order
    letter = [w[:-1] + "x" if i % 8 == 0 else w for i, w in enumerate(words)]
    assert 0.2 < near(letter) < 1  # a changed letter here and there
    solid = "".join(words)
    assert fingerprint.likeness(fingerprint.components(solid), fingerprint.components("y" + solid)) > 0.9
    assert len(fingerprint.components(" ".join(words * 200))) == fingerprint.SIZE


def test_fingerprint_edges(spark):
    assert fingerprint.edit_likeness(empty(spark)).count() == 0
    single = fingerprint.edit_likeness(frame(spark, [(5, "only one here", None, None, 0)])).collect()
    assert len(single) == 1 and single[0].near_next == 1
    ties = fingerprint.edit_likeness(frame(spark, [(None, "x y", None, None, 0), (4, "a b", None, None, 0), (4, "a b", None, None, 0), (4, "c d", None, None, 0)]))
    assert sorted(str(r.doc_id) for r in ties.collect()) == ["4", "4", "4", "None"]
    assert fingerprint.fingerprints(frame(spark)).count() == len(rows())


# ------------------------------------------------------------------ personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_pattern(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789012345..--  ()++@@ab%_éZ/:\n", max_size=60))
def test_base_spans(text):
    assert [s for s in pii.spans(text) if s[2] in pii.BASE] == by_pattern(text)


def test_more_spans():
    text = "IBAN: DE89 3704 0044 0532 0130 00 see https://a.example/x?y=1). Account no. 12345678 accountant 12"
    assert [(k, text[a:b]) for a, b, k in pii.spans(text) if k in ("account", "url")] == [("account", "DE89 3704 0044 0532 0130 00"), ("url", "https://a.example/x?y=1"), ("account", "12345678")]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_credentials():
    text = """x token = "04dbebab91ab" thou; api_key: 'k-1234567', password=hunter22! "accessToken": "abcdefgh1", tokens are words; bearer AbC123xyz99 secret = short1 Konto 12-345678 IBAN GB29 NWBK 6016 1331 9268 19 end"""
    found = [(k, text[a:b]) for a, b, k in pii.spans(text) if k in ("account", "secret")]
    assert found == [("secret", "04dbebab91ab"), ("secret", "k-1234567"), ("secret", "hunter22"), ("secret", "abcdefgh1"), ("secret", "AbC123xyz99"), ("account", "12-345678"), ("account", "GB29 NWBK 6016 1331 9268 19")]
    assert pii.redacted(text, pii.spans(text)).startswith('x token = "<secret>" thou')
    long = "account " + "1 " * 50_000 + "account " * 20_000  # one pass, whatever stands there
    assert len(pii.spans(long)) == 1


def test_pii_query(spark):
    data = [(1, "mail x@y.zz or +1 (555) 010-9999, 10.0.0.1, 4111 1111 1111 1111", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (4, "a@b " * 20_000, None, None, 0)]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, data)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    assert got[2].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[4].n_email == 0
    clean = {r.doc_id: r.text for r in pii.without_personal_data(frame(spark, data)).collect()}
    assert clean[1] == "mail <email> or <phone>, <ip>, <card>" and clean[2] is None and clean[3] == ""
    assert pii.personal_data(empty(spark)).count() == 0


# ------------------------------------------------------------------ decontamination


def leaks(docs, items, stretch=13, share=0.75):
    """All pairs that a hit of a mask and the comparison around it find, by brute force."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, text in docs:
        w = cut(text)
        for j, item in items:
            v = cut(item)
            for mask in decontamination.MASKS:
                seeds = {}
                for b in range(len(v) - max(mask)):
                    seeds.setdefault(tuple(v[b + o] for o in mask), []).append(b)
                for a in range(len(w) - max(mask)):
                    for b in seeds.get(tuple(w[a + o] for o in mask), ()):
                        same = [0 <= a - b + k < len(w) and w[a - b + k] == v[k] for k in range(len(v))]
                        n = min(stretch, len(v))
                        if max(sum(same[k : k + n]) for k in range(len(v) - n + 1)) >= np.ceil(share * n):
                            out.add((i, j))
    return out


def test_decontamination(spark):
    draw = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(j, text(draw.randint(12, 40))) for j in range(12)] + [(50, "too short"), (51, None)]
    docs = [(i, text(draw.randint(0, 80))) for i in range(60)]
    for i in range(60, 90):  # whole items, some words replaced, at any place
        passage = items[i % 12][1].split()
        for _ in range(i % 4):
            passage[draw.randrange(len(passage))] = "other"
        docs.append((i, f"{text(draw.randint(0, 30))}\n{' '.join(passage).upper()}! {text(draw.randint(0, 30))}"))
    docs += [(90, None), (91, ""), (92, items[0][1]), (92, items[0][1])]
    table = frame(spark, [(i, t, None, None, 0) for i, t in docs] + [(None, items[1][1], None, None, 0)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontamination.contaminated(table, benchmark).collect()]
    assert len(got) == len(set(got)) and set(got) == leaks(docs, items)
    assert {(i, i % 12) for i in range(60, 90) if i % 4 == 0} <= set(got)
    kept = decontamination.decontaminated(table, benchmark)
    bad = {i for i, _ in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in [*docs, (None, "")] if i not in bad) and kept.columns == table.columns
    assert decontamination.contaminated(empty(spark), benchmark).count() == 0
    assert decontamination.contaminated(table, benchmark.where("false")).count() == 0


def overlaps(docs, items, stretch=13, share=0.75):
    """All pairs that the comparison accepts at any alignment, without masks."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, text in docs:
        w = cut(text)
        for j, item in items:
            v = cut(item)
            n = min(stretch, len(v))
            for shift in range(1 - len(v), len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == v[k] for k in range(len(v))]
                if n and max(sum(same[k : k + n]) for k in range(len(v) - n + 1)) >= np.ceil(share * n):
                    out.add((i, j))
    return out


def test_decontamination_misses_no_accepted_stretch(spark):
    from itertools import combinations

    draw = random.Random(21)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    passage = [f"word{k}" for k in range(13)]
    items = [(0, " ".join(passage)), (1, " ".join(f"long{k}" for k in range(60)))] + [(j, " ".join(draw.choice(words) for _ in range(draw.randint(9, 30)))) for j in range(2, 10)]
    replaced = [" ".join("other" if k in c else w for k, w in enumerate(passage)) for c in combinations(range(13), 3)]
    docs = list(enumerate(["a b " + t + " c" for t in replaced]))
    docs.append((300, " ".join("other" if k % 4 == 3 else f"long{k}" for k in range(60))))
    for i in range(301, 361):  # a quarter of an item's words replaced, some cut off at the document's ends
        copy = items[2 + i % 8][1].split()
        for k in draw.sample(range(len(copy)), len(copy) // 4):
            copy[k] = "other"
        docs.append((i, " ".join(copy[draw.choice([0, 0, 2]) :])))
    table = frame(spark, [(i, t, None, None, 0) for i, t in docs])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for stretch, share, masks in ((13, 0.75, decontamination.MASKS), (13, 0.6, decontamination.MASKS), (9, 0.75, ((0, 1, 3, 4, 6, 7), (0, 2), (0, 1, 2)))):
        got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table, benchmark, stretch, share, masks).collect()}
        assert got == overlaps(docs, items, stretch, share)
        assert stretch != 13 or {(i, 0) for i in range(286)} | {(300, 1)} <= got


def test_decontamination_finds_short_items(spark):
    draw = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    items = [(n, " ".join(draw.sample(words, n))) for n in range(1, 14)] + [(20, "why"), (21, "one two three four five six seven eight"), (22, None), (23, " ?! ")]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 40)))) for i in range(30)]
    for n, item in items[:15]:  # verbatim, and with any one word and any two words replaced
        copy = item.split()
        for a in range(len(copy)):
            for b in range(a, len(copy)):
                docs.append((len(docs), "x y " + " ".join("other" if k in (a, b) else w for k, w in enumerate(copy)) + " z"))
        docs.append((len(docs), f"x {item.upper()}? z {item}"))
    docs += [(len(docs), ""), (len(docs) + 1, None)]
    table = frame(spark, [(i, t, None, None, 0) for i, t in docs])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontamination.contaminated(table, benchmark).collect()]
    assert len(got) == len(set(got)) and set(got) == overlaps(docs, items)
    # A question without spaces, inside longer runs.
    question = spark.createDataFrame([(1, "日本の首都はどこですか"), (2, "ดี")], "item_id long, text string")
    texts = [(1, "さて日本の首都はどこですかと聞いた", None, None, 0), (2, "大阪の名物は何でしょう", None, None, 0), (3, "日本の首都はここですか", None, None, 0)]
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, texts), question).collect()) == [(1, 1), (3, 1)]


def test_decontamination_runs_without_python(spark):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontamination.contaminated(frame(spark), benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------------ URLs

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1?q#f", "https://example.org/en", "ftp://x.com/de/", "http://x.com/fr/a", "http://notorg/", "http://b.example.org", None, "no scheme", "", "a://h?x=/de/", "http://org/#"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)] + [(None, "http://x.net/", "<p>")], "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, RULES, url_filter.page_outcome(F.col("html"), F.col("url"))).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en", "org/", "allow")
    assert got[2][2:] == ("com/de/", "block") and got[3][2:] == ("com/fr/", "allow") and got[4] == ("notorg", "/", None, "allow")
    assert got[5] == ("b.example.org", "", None, "allow") and got[6][:3] == got[7][:3] == got[8][:3] == ("", "", None)
    assert got[9][:2] == ("h", "") and got[10] == ("org", "/", "org/", "allow") and None in got
    assert url_filter.url_verdicts(pages.where("false"), RULES, url_filter.page_outcome(F.col("html"), F.col("url"))).count() == 0


def test_reputation_shrinks(spark):
    rows_ = [(f"h{i}.good.net", 0) for i in range(30) for _ in range(20)] + [(f"h{i}.bad.net", 1) for i in range(30) for _ in range(20)] + [("new.bad.net", 1), ("new.good.net", 1), ("none.good.net", None)]
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows_, "host string, outcome int")).collect()}
    assert got["h1.bad.net"].lower > 0.5 and got["h1.good.net"].upper < 0.5
    assert got["new.good.net"].bad_rate < got["new.bad.net"].bad_rate and got["none.good.net"].host_pages == 0


def test_beta_quantiles(spark):
    """Against quantiles of many draws, and against closed forms: Beta(1, b), Beta(a, 1)."""
    draw = np.random.Generator(np.random.PCG64(5))
    shapes = [(0.3, 5.0), (2.0, 7.5), (40.0, 3.0), (3000.0, 90.0), (0.2, 0.3), (1.0, 9.0), (6.0, 1.0)]
    df = spark.createDataFrame(shapes, "a double, b double")
    for p in (0.05, 0.5, 0.95):
        for r in df.select("a", "b", url_filter.beta_quantile(F.col("a"), F.col("b"), p).alias("q")).collect():
            sample = draw.beta(r.a, r.b, 200_000)
            assert abs((sample <= r.q).mean() - p) < 0.005
            exact = 1 - (1 - p) ** (1 / r.b) if r.a == 1 else p ** (1 / r.a) if r.b == 1 else r.q
            assert r.q == pytest.approx(exact, abs=2e-4)


def test_page_outcomes(spark):
    pages = {"<p>good words here</p>": 0, "<p>%%% $$$ !!</p> a": 1, "<script>x": 1, "<!-- " * 30_000 + "hidden": 1, "<script>" * 30_000: 1, "<p>LOUD WORDS a</p>": 1, "": 1, "&amp;&#33; text <style>p{!!!!}</style>": 0, "<b>open": 0}
    df = spark.createDataFrame([(h, "http://a.example/x") for h in pages] + [(None, "http://a.example/"), ("<p>fine</p>", "https://www.Best-CASINO.example/"), ("<p>fine</p>", "https://alphabets.example/")], "html string, url string")
    got = [r.o for r in df.select(url_filter.page_outcome(F.col("html"), F.col("url")).alias("o")).collect()]
    assert got == [*pages.values(), None, 1, 0]


def test_method_decides_pages(spark):
    """Pages without a rule, of hosts with good, bad and too few outcomes; repeated rows, a null id and an empty table."""
    rows_ = [(i, f"http://shop-casino.example/{i}", "<p>some words</p>") for i in range(40)] + [(100 + i, f"http://news.example/{i}", "<p>some words</p>") for i in range(200)]
    rows_ += [(900, "http://poker.tiny.test/", "<p>x</p>"), (901, "http://news.example/1", None), (None, "http://shop-casino.example/1", "<p>some words</p>")] + [(901, "http://news.example/1", None)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    got = url_filter.url_verdicts(pages, RULES, url_filter.page_outcome(F.col("html"), F.col("url"))).collect()
    assert len(got) == len(rows_) and all(r.rule is None for r in got)
    verdicts = {r.host: (r.verdict, r.lower) for r in got}
    assert verdicts["shop-casino.example"][0] == "block" and verdicts["news.example"][0] == "allow"
    assert verdicts["poker.tiny.test"][1] < verdicts["shop-casino.example"][1]


def test_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "y.x.co.uk": ("x.co.uk", "co.uk"), "com": ("com", "com"), "": ("", ""), "10.0.0.1": ("10.0.0.1", "10.0.0.1")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_filter.domain_and_suffix(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


# ------------------------------------------------------------------ similarity


def linked(data, width, percent):
    """Set sizes and components by brute force."""
    sets = {}
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    above = {i: i for i in sets}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                above[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def families(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcDE") for _ in range(3)) for _ in range(50)]
    out = []
    for _ in range(25):
        base = [draw.choice(words) for _ in range(draw.choice([1, 2, 5, 12, 40, 90, 200]))]
        for _ in range(draw.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                w[draw.randrange(len(w))] = draw.choice(words)
            out.append((len(out), draw.choice([" ", "\n"]).join(w)))
    for n, least, most in ((150, 3, 9), (60, 1, 5)):  # variants of one text, around the limit
        base = [f"w{draw.randrange(10**6)}" for _ in range(n)]
        for _ in range(60):
            w = list(base)
            for _ in range(draw.randint(least, most)):
                w[draw.randrange(len(w))] = f"v{draw.randrange(30)}"
            out.append((len(out), " ".join(w)))
    return out + [(len(out), None), (len(out) + 1, ""), (len(out) + 2, " \n ")]


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_similarity(spark, width, percent, seed):
    data = families(seed)
    table = frame(spark, [(i, t, None, None, 0) for i, t in data])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity.similar_documents(table, width, percent).collect()}
    assert got == linked(data, width, percent)


def test_similarity_with_repeated_ids(spark):
    """Rows with one id are one document: each gives a row, and the document links what either text is linked with."""
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    data = [(1, one), (2, two), (5, one), (5, two), (7, "z " + two), (8, None), (8, one), (9, "lone words")]
    got = similarity.similar_documents(frame(spark, [(i, t, None, None, 0) for i, t in data])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 36, 1), (2, 36, 1), (5, 36, 1), (5, 36, 1), (7, 37, 1), (8, 0, 1), (8, 36, 1), (9, 1, 9)]
    assert sorted(map(tuple, (r[:2] for r in similarity.one_of_each(frame(spark, [(i, t, None, None, 0) for i, t in data])).collect())), key=str) == [(1, one), (9, "lone words")]


def test_sketches(spark):
    draw = random.Random(2)
    a = np.array(sorted(draw.sample(range(1 << 60), 300)), np.uint64)
    b = np.array(sorted({*a.tolist()[20:], *draw.sample(range(1 << 60), 15)}), np.uint64)
    apart = sum((int(x) ^ int(y)).bit_count() for x, y in zip(*(similarity.bit_sketch(s).view(np.uint64) for s in (a, b)), strict=True))
    assert 0 < apart <= 35
    text = "One  two\tTHREE " + "x" * 5000 + "\x0bfour ünï " * 3
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    starts, h = similarity.word_hashes(text.encode())
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    long = " ".join(f"w{i % 1000}" for i in range(300_000))  # several blocks of bytes
    assert len(set(similarity.word_hashes(long.encode())[1].tolist())) == 1000


def test_similarity_edges(spark):
    assert similarity.similar_documents(empty(spark)).count() == 0
    data = [(None, "one two three four five six", None, None, 0), (3, "one two three four five six", None, None, 0), (3, "one two three four five six", None, None, 0), (9, "one two three four five six", None, None, 0), (10, "x", None, None, 0)]
    table = frame(spark, data)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in similarity.similar_documents(table).collect())
    assert got == [("10", "10"), ("3", "3"), ("3", "3"), ("9", "3"), ("None", "None")]
    kept = similarity.one_of_each(table)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "3", "3", "None"] and kept.columns == table.columns


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=120), st.data())
def test_pigeonhole(tokens, data):
    """Similar sets share as many words of a band as the bound says, and more if they need fewer differences."""
    a = np.array(sorted(tokens), np.uint64)
    drop = data.draw(st.sets(st.sampled_from(a.tolist()), max_size=max(0, len(a) // 8)))
    b = np.array(sorted(set(a.tolist()) - drop), np.uint64)
    common, union = len(b), len(a)
    if len(b) and 100 * common >= 80 * union:
        for spare in (0.2, 3.0):
            mine = {band: (need, set(keys.tolist())) for band, need, keys in similarity.sketch_keys(a, 80, spare)}
            other = {band: (need, set(keys.tolist())) for band, need, keys in similarity.sketch_keys(b, 80, spare)}
            band = int(np.searchsorted(similarity.bands(), len(b), "right")) - 1
            assert len(mine[band][1] & other[band][1]) >= 1
            assert len(mine[band][1] & other[band][1]) >= min(mine[band][0], other[band][0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in similarity.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 150, 200)}
    assert SCHEMA
