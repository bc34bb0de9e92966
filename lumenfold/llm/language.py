"""Language identification with spans.

A word is what stands between white space. Each letter of a word belongs to a script by its code point, and a script
admits only the languages that were seen to use it. A word's score for a language is the sum, over its letters, of the
log probabilities of the letter n-grams there (2, 3 and 4 letters, word edges included). A Viterbi pass over a text's
words, with a penalty for each switch, labels every word with a language, so that passages in another language come out
as spans. The text's language is the one with the most letters; its score is its share of them.

The n-gram counts are learned from a bounded sample of labelled documents (`train_docs`), chosen by a hash of the id.

Nulls and odd rows: a null text, or one without a letter, is `und` with score 0 and no spans. Rows without a language
teach nothing. Letters of a script that no learned language uses favour no language; if a text has no others, the most
frequent learned language is given with score 1/number of languages and no spans. Without any labelled row every text is
`und`. Languages that score a word equally, or share a text's letters equally, go in alphabetical order. Ids may repeat
or be null: there is one output row for each input row, and no rows give none. A very long text is labelled as a whole:
memory holds its words times the languages. A model has 0.8 MB for each learned language, of which any number may be.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns, give_back, held_out, map_arrow, slices, spread_sample

UNDETERMINED = "und"
BUCKETS = 1 << 16
#: Words whose scores a task remembers.
REMEMBERED = 100_000
#: Bytes of text labelled together, with up to LANGUAGES languages; with more, less.
LABELLED, LANGUAGES = 500_000, 16
REMEMBERED_LENGTH = 64

# First code points of script ranges; letters elsewhere count as "other".
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def letter_scripts() -> np.ndarray:
    """For each code point its script's number, or -1 if it is no letter."""
    points = np.arange(0x110000)
    starts = np.array([s for s, _ in SCRIPTS])
    script = np.array([NAMES.index(n) for _, n in SCRIPTS], np.int8)[np.searchsorted(starts, points, "right") - 1]
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, script, np.int8(-1))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of the words: the word's index, the letter's script, and three hashed n-grams ending around it."""
    flat = "\n\n" + "\n\n".join(w.lower() for w in words) + "\n\n"
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.cumsum((code == 10) & (np.r_[0, code[:-1]] == 10)) - 1
    script = letter_scripts()[code]
    at = np.flatnonzero(script >= 0)
    c = np.where(script >= 0, code, 1).astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    two = (c[at - 1] * np.uint64(0x100000001B3) + c[at]) * mix
    three = ((two ^ c[at + 1]) + np.uint64(0x632BE59BD9B4E019)) * mix
    four = ((three ^ c[at - 2]) + np.uint64(0x85157AF5)) * mix
    grams = np.stack([two, three, four], 1) >> np.uint64(48)
    return of[at], script[at], grams.astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # orders x buckets x languages
    uses: np.ndarray  # scripts x languages: whether the language uses the script
    commonest: int

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words x languages) and the number of letters of each word."""
        scores = np.zeros((len(words), len(self.languages)), np.float32)
        of, script, grams = features(words)
        if len(of):
            each = sum(self.logs[k][grams[:, k]] for k in range(3)) / np.float32(3)
            admitted = self.uses[script]
            each = np.where(admitted, each, np.float32(-14))
            each[~admitted.any(1)] = 0
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            scores[of[starts]] = np.add.reduceat(each, starts)
        return scores, np.bincount(of, minlength=len(words))


def learn(docs: DataFrame, train_docs: int = 20_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts n-grams by language in the tasks; what reaches the driver is bounded by languages x buckets."""
    rows = docs.where(~held_out(doc_id) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = spread_sample(rows.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")), train_docs)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for langs, texts in slices(batches, 1, LABELLED):
            for name in set(langs):
                seen: dict[str, int] = {}
                for one, t in zip(langs, texts, strict=True):
                    if one == name:
                        for w in t.split():
                            seen[w] = seen.get(w, 0) + 1
                if not seen:
                    continue
                of, script, grams = features(list(seen))
                times = np.fromiter(seen.values(), np.float64, len(seen))[of]
                total = held.setdefault(name, np.zeros((3, BUCKETS)))
                for k in range(3):
                    total[k] += np.bincount(grams[:, k], times, BUCKETS)
                scripts.setdefault(name, np.zeros(len(NAMES)))
                scripts[name] += np.bincount(script, times, len(NAMES))
        for name, total in held.items():
            flat = np.r_[total.ravel(), scripts[name]].astype(np.int64)
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(flat[at])], ["lang", "place", "n"])

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    langs, place, n = (counts.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "place", "n"))
    languages = sorted(set(langs))
    logs = np.zeros((3, BUCKETS, max(1, len(languages))), np.float32)
    uses = np.zeros((len(NAMES), max(1, len(languages))), bool)
    sizes = []
    for i, name in enumerate(languages):
        flat = np.zeros(3 * BUCKETS + len(NAMES))
        flat[place[langs == name]] = n[langs == name]
        grams = flat[: 3 * BUCKETS].reshape(3, BUCKETS)
        logs[:, :, i] = np.log((grams + 0.1) / (grams.sum(1, keepdims=True) + 0.1 * BUCKETS))
        by_script = flat[3 * BUCKETS :]
        uses[:, i] = by_script > 0.01 * max(1.0, by_script.sum())
        sizes.append(by_script.sum())
    return LanguageModel(languages, logs, uses, int(np.argmax(sizes)) if sizes else 0)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word. scores: all texts' words one after the other; lengths: words of each text, in
    descending order, none 0. All texts take a step together."""
    time = np.concatenate([np.arange(n) for n in lengths])
    order = np.argsort(time, kind="stable")
    by_time = scores[order]
    active = np.bincount(time)
    ends = np.cumsum(active)
    kind = np.int8 if scores.shape[1] < 128 else np.int32
    back = np.zeros(by_time.shape, kind)
    states = np.arange(scores.shape[1], dtype=kind)
    value = by_time[: active[0]].copy()
    finals = np.zeros(len(lengths), kind)
    for t in range(1, len(active)):
        n = active[t]
        finals[n : active[t - 1]] = value[n : active[t - 1]].argmax(1)
        value = value[:n]
        best = value.argmax(1)
        switched = value[np.arange(n), best][:, None] - penalty
        stay = value >= switched
        back[ends[t - 1] : ends[t]] = np.where(stay, states, best[:, None])
        value = np.where(stay, value, switched) + by_time[ends[t - 1] : ends[t]]
    finals[: active[-1]] = value.argmax(1)
    out = np.zeros(len(scores), kind)
    state = finals.copy()
    for t in range(len(active) - 1, -1, -1):
        n, begin = active[t], ends[t] - active[t]
        out[begin : begin + n] = state[:n]
        if t:
            state[:n] = back[begin + np.arange(n), state[:n]]
    labels = np.empty_like(out)
    labels[order] = out
    return labels


class Labeller:
    """Labels texts in a worker, remembering the scores of words."""

    def __init__(self, model: LanguageModel, penalty: float):
        self.model, self.penalty = model, penalty
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, max(1, len(self.model.languages))), np.float32)
        self.letters = np.zeros(0, np.int64)

    def label(self, texts: list[str]) -> list[tuple[str, float, str]]:
        """Language, score and spans (language:first word:end word, comma-joined) of each text."""
        out = [(UNDETERMINED, 0.0, "")] * len(texts)
        if not self.model.languages:
            return out
        if len(self.index) > REMEMBERED:
            self.forget()
        cut = [t.split() for t in texts]
        index = self.index
        new = [w for w in set().union(*cut) if w not in index]
        if new:
            scores, letters = self.model.word_scores(new)
            index |= zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True)
            self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])
        by_length = sorted((i for i, words in enumerate(cut) if words), key=lambda i: -len(cut[i]))
        if not by_length:
            return out
        lengths = np.array([len(cut[i]) for i in by_length])
        ids = np.fromiter((k for i in by_length for k in map(index.__getitem__, cut[i])), np.int64, lengths.sum())
        labels, letters, ends = viterbi(self.scores[ids], lengths, self.penalty), self.letters[ids], np.cumsum(lengths)
        names, n = self.model.languages, len(self.model.languages)
        of = np.repeat(np.arange(len(lengths)), lengths)
        share = np.bincount(of * n + labels, letters, len(lengths) * n).reshape(-1, n)
        known = np.bincount(of, np.abs(self.scores[ids]).sum(1), len(lengths))
        edges = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (of[1:] != of[:-1])])
        spans: list[list[str]] = [[] for _ in lengths]
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(labels)], strict=True):
            begin = ends[of[a]] - lengths[of[a]]
            spans[of[a]].append(f"{names[labels[a]]}:{a - begin}:{b - begin}")
        for k, i in enumerate(by_length):
            total = share[k].sum()
            if total and not known[k]:
                out[i] = (names[self.model.commonest], 1 / n, "")
            elif total:
                best = int(share[k].argmax())
                out[i] = (names[best], float(share[k][best] / total), ",".join(spans[k]))
        return out


def languages(docs: DataFrame, model: LanguageModel, penalty: float = 12.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, spans. A narrow map without a shuffle.

    penalty: what a switch costs, in nats. The model is bounded by languages x buckets and goes to each executor once.
    """
    check_columns(docs, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(shared.value, penalty)

        def each(columns):
            found = labeller.label([t or "" for t in columns[2]])
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string())))], ["doc_id", "held_out", "lang_pred", "score", "spans"])

        return each

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, spans string", text=2, chars=labelled_together(model))


def labelled_together(model: LanguageModel) -> int:
    return LABELLED * LANGUAGES // max(LANGUAGES, len(model.languages))


def determined(docs: DataFrame, model: LanguageModel, least: float = 0.5, accepted: Collection[str] | None = None, penalty: float = 12.0, text: str = "text") -> DataFrame:
    """The rows of docs in one of the `accepted` languages (any learned one by default); all columns stay.

    A text goes if it has no letter, if all its letters belong to scripts that no learned language uses, if less than
    `least` of its letters lie in spans of its language, or if that language isn't accepted. If nothing could be learned
    there is no ground to reject a text, and all rows stay."""
    check_columns(docs, text)
    if not model.languages:
        return docs
    wanted = frozenset(model.languages if accepted is None else accepted)
    at, chars = docs.columns.index(text), labelled_together(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shared.value, penalty)
        for batch in batches:
            begin = 0
            for columns in slices([batch.select([at])], 0, chars):
                found = labeller.label([t or "" for t in columns[0]])
                keep = pa.array([bool(spans) and name in wanted and score >= least for name, score, spans in found], pa.bool_())
                yield batch.slice(begin, len(found)).filter(keep)
                begin += len(found)
        del labeller
        give_back()

    return docs.mapInArrow(run, docs.schema)
