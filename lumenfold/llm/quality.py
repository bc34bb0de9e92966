"""A quality classifier.

Random indexing: a token is a word core (lower-cased), its shape and its trailing signs, each a unit with a sparse
random index vector drawn from its hash. A unit's context vector is the sum of the index vectors of the units around its
occurrences. A text's vector is the mean of its tokens' unit-length context vectors, with a few surface statistics
(length, repetition, shares of capitals, signs, digits). A two-layer network in numpy turns it into a probability, and a
temperature fitted on rows set aside calibrates that.

Everything is learned from a bounded sample of labelled rows (`train_docs`), chosen by a hash of the id among those that
are not held out; labels, language, source and id are no inputs of a score. All corpus rows are scored on whole texts.

Nulls and odd rows: a null or empty text is scored from its statistics (all 0). Rows without a label, or with a null
one, teach nothing; several labels of one document count as several rows. Without any labelled row, or with one class
only, every score is the share of label 1 (0.5 without rows). Ids may repeat or be null: one output row for each row,
and none for no rows. Equal texts have equal scores. A very long text is pooled as a whole; a long run without white
space is read in pieces of its letters.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns, held_out, map_arrow, slices, spread_sample, written

UNITS = 1 << 13
WIDTH = 48
NONZERO = 6
WINDOW = 2
STATISTICS = 9
#: Tokens that a task remembers.
REMEMBERED = 150_000

#: A longer run of signs without white space is cut into runs of letters, these into pieces, and what lies between.
LONG = 40
PIECES = re.compile(r"[^\W\d_]{1,4}|[\W\d_]+")
CORE = re.compile(r"[^\W\d_]+")
TRAIL = re.compile(r"[\W_]+\Z")


def shape(token: str) -> str:
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in token)
    return re.sub(r"(.)\1+", r"\1+", kinds)


@lru_cache(maxsize=50_000)
def unit(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "replace")) % UNITS


def tokens(text: str) -> list[str]:
    found = text.split()
    if found and max(map(len, found)) > LONG:
        return [p for t in found for p in ((t,) if len(t) <= LONG else PIECES.findall(t))]
    return found


def units(token: str) -> tuple[int, int, int]:
    """Core, shape and trailing signs of a token as unit numbers; parts that are missing share one unit each."""
    word = token[:-1] if token[-1] in ",." else token
    if word.isalpha() and word.islower() and word.isascii() and word:  # the common case, without patterns
        end = token[len(word) :]
        return zlib.crc32(b"c" + word.encode()) % UNITS, unit(("sx+" if len(word) > 1 else "sx") + end), unit("t" + end)
    core, trail = CORE.search(token), TRAIL.search(token)
    return unit("c" + core[0].lower() if core else "c"), unit("s" + shape(token)), unit("t" + trail[0] if trail else "t")


def token_statistics(token: str) -> tuple[int, ...]:
    if token.isalpha() and token.islower():
        return len(token), len(token), 0, 0, 0
    letters = sum(map(str.isalpha, token))
    digits = sum(map(str.isdigit, token))
    return len(token), letters, sum(map(str.isupper, token)), digits, len(token) - letters - digits


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, the same on every machine."""
    draw = np.random.Generator(np.random.PCG64(20_240_229))
    out = np.zeros((UNITS, WIDTH), np.float32)
    for row in out:
        row[draw.choice(WIDTH, NONZERO, replace=False)] = draw.choice([-1, 1], NONZERO)
    return out


class Reader:
    """Turns texts into unit numbers and statistics, remembering tokens."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.units = np.zeros((0, 3), np.int64)
        self.numbers = np.zeros((0, 5), np.float32)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Token ids of all texts in a row, tokens per text, distinct tokens per text; how many tokens were known."""
        if len(self.index) > REMEMBERED:
            self.forget()
        cut = [tokens(t) for t in texts]
        sets = [set(c) for c in cut]
        known = len(self.units)
        new = [w for w in set().union(*sets) if w not in self.index]
        if new:
            self.index |= zip(new, range(known, known + len(new)), strict=True)
            self.units = np.concatenate([self.units, np.array([units(w) for w in new], np.int64)])
            self.numbers = np.concatenate([self.numbers, np.array([token_statistics(w) for w in new], np.float32)])
        lengths = np.array([len(c) for c in cut], np.int64)
        ids = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, lengths.sum())
        return ids, lengths, np.array([len(s) for s in sets], np.int64), known


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, `lengths` of them each; 0 where there are none."""
    out = np.zeros((len(lengths), values.shape[1]), np.float64)
    some = lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values, np.r_[0, np.cumsum(lengths[some])[:-1]], axis=0, dtype=np.float64)
    return out


@dataclass
class QualityModel:
    contexts: np.ndarray  # units x width, unit length
    center: np.ndarray = None
    scale: np.ndarray = None
    layers: list = None
    temperature: float = 1.0
    base: float = 0.5

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(vectors), self.base)
        logits = network((vectors - self.center) / self.scale, self.layers)[0]
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -40, 40)))


class Pooler:
    """Text vectors in a worker: a token's row is the sum of its units' context vectors, with its statistics."""

    def __init__(self, model: QualityModel):
        self.model, self.reader = model, Reader()
        self.rows = np.zeros((0, WIDTH + 5), np.float32)

    def vectors(self, texts: list[str]) -> np.ndarray:
        ids, lengths, distinct, known = self.reader.read(texts)
        new = np.concatenate([self.model.contexts[self.reader.units[known:]].sum(1), self.reader.numbers[known:]], 1)
        self.rows = new if known == 0 else np.concatenate([self.rows, new])
        total = sums(self.rows[ids], lengths)
        n = np.maximum(lengths, 1)[:, None]
        size, letters, capitals, digits, signs = total[:, WIDTH:].T
        chars = np.maximum(size, 1)
        lines = np.array([t.count("\n") for t in texts])
        stats = [np.log1p(lengths), distinct / n[:, 0], size / n[:, 0], letters / chars, capitals / chars, digits / chars, signs / chars, np.log1p(lines), lines / n[:, 0]]
        return np.concatenate([total[:, :WIDTH] / n, np.stack(stats, 1)], 1)


def network(x: np.ndarray, layers: list) -> tuple[np.ndarray, np.ndarray]:
    (w1, b1), (w2, b2) = layers
    hidden = np.tanh(x @ w1 + b1)
    return (hidden @ w2 + b2)[:, 0], hidden


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> list:
    """Two layers, logistic loss, Adam; deterministic for the same rows in the same order."""
    draw = np.random.Generator(np.random.PCG64(7))
    params = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for begin in range(0, len(x), batch):
            rows = order[begin : begin + batch]
            logits, h = network(x[rows], [params[:2], params[2:]])
            wrong = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y[rows])[:, None] / len(rows)
            back = (wrong @ params[2].T) * (1 - h * h)
            step += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ wrong, wrong.sum(0))):
                g = g + decay * params[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return [params[:2], params[2:]]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t):
        z = logits / np.exp(log_t)
        return np.mean(np.logaddexp(0, z) - y * z)

    low, high, ratio = -0.7, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = 20_000, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> QualityModel:
    """labels: doc_id and quality (1 or 0). The sample of labels is bounded by train_docs, so it is broadcast to fetch
    its texts; context vectors are summed in the tasks, and the network is fitted on the driver from one vector for
    each sampled row."""
    wanted = labels.where(~held_out(doc_id) & F.col(quality).isin(0, 1)).select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("int").alias("quality"))
    wanted = F.broadcast(spread_sample(wanted, train_docs))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(wanted, "doc_id")
    rows = written(rows, "labelled")
    # A task for each 1000 rows of the bounded sample; each sends one sum of context vectors to the driver.
    rows = rows.coalesce(-(-train_docs // 1000))
    index = index_vectors()

    def count(batches):
        total, reader, drawn = np.zeros((UNITS, WIDTH), np.float32), Reader(), np.zeros((0, WIDTH), np.float32)
        for (texts,) in slices(batches, 0, 1_000_000):
            ids, lengths, _, known = reader.read([t or "" for t in texts])
            drawn = np.concatenate([drawn[:known], index[reader.units[known:]].sum(1)])
            around = drawn[ids]  # of each token: the index vectors of its units
            of = np.repeat(np.arange(len(lengths)), lengths)
            context = np.zeros_like(around)
            for d in range(1, WINDOW + 1):
                same = (of[d:] == of[:-d])[:, None]
                context[d:] += around[:-d] * same
                context[:-d] += around[d:] * same
            if len(ids):  # first for each distinct token, then for its units
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
                by_token, tokens = np.add.reduceat(context[order], first, axis=0), ids[order][first]
                for part in range(3):
                    np.add.at(total, reader.units[tokens, part], by_token)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = rows.select("text").mapInArrow(count, "total binary").collect()
    contexts = sum((np.frombuffer(p.total, np.float32).reshape(UNITS, WIDTH).astype(np.float64) for p in parts), np.zeros((UNITS, WIDTH)))
    model = QualityModel((contexts / np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-9)).astype(np.float32))

    def pool(batches):
        pooler = Pooler(model)
        for ids, y, texts in slices(batches, 2):
            vectors = pooler.vectors([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(y, pa.int32()), pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))], ["doc_id", "quality", "vector"])

    table = rows.select(F.col("doc_id").cast("long"), "quality", "text").mapInArrow(pool, "doc_id long, quality int, vector array<float>").toPandas()
    table = table.sort_values(["doc_id", "quality"], kind="stable")
    y = table.quality.to_numpy(np.float64)
    if not len(y):
        return model
    model.base = float(y.mean())
    if model.base in (0.0, 1.0):
        return model
    x = np.stack(table.vector.to_list()).astype(np.float64)
    model.center, model.scale = x.mean(0), x.std(0) + 1e-6
    x = (x - model.center) / model.scale
    aside = np.array([zlib.crc32(str(i).encode()) % 11 == 0 for i in table.doc_id])
    if aside.all() or not aside.any() or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    model.layers = fit_network(x[~aside], y[~aside])
    model.temperature = fit_temperature(network(x[aside], model.layers)[0], y[aside])
    return model


def scores(docs: DataFrame, model: QualityModel, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted. A narrow map without a shuffle."""
    check_columns(docs, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        pooler = Pooler(shared.value)

        def each(columns):
            p = pooler.model.probabilities(pooler.vectors([t or "" for t in columns[2]]))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

        return each

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, make, "doc_id long, held_out boolean, score double, predicted int", text=2, chars=1_000_000)
