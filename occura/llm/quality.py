"""Supervised subword embeddings: a linear classifier over averaged vectors of hashed words and character n-grams.

Every word, every pair of neighbouring words and every character n-gram inside a word (with its borders) is hashed
to a row of one embedding table.  A document is the mean of its rows, a softmax layer gives the classes, and both
are learned by stochastic gradient descent in numpy on a bounded sample.  As the output is linear in the mean,
scoring folds the output layer into the table: one number per row and class.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occura.llm.common import carried, materialize, schema_of, slices, task

BUCKET_BITS = 16
DIMENSION = 8
CHAR_NGRAMS = (3, 4)
#: Labelled rows to learn from at most, in the order of a hash of the row, and bytes of their texts after which no further row is taken.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 128 << 20
EPOCHS, RATE, SEED = 8, 1.0, 7

_SPACES = (9, 10, 11, 12, 13, 32)
_SHIFT = np.uint64(64 - BUCKET_BITS)
_ODD = np.random.default_rng(20).integers(1, 1 << 63, 72, dtype=np.uint64) | np.uint64(1)
_PLACE, _GRAM, _MIX, _PAIR = _ODD[:64], _ODD[64:70], _ODD[70], _ODD[71]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    return (h * _MIX) >> _SHIFT


def features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (text number, bucket) arrays that together hold every feature of the texts, whole."""
    decoded = [(x or b"").decode("utf-8", "replace") for x in texts]
    sizes = np.array([len(x) + 2 for x in decoded], np.int64)
    points = np.frombuffer(("\n" + "\n\n".join(decoded) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    space = np.isin(points, _SPACES) if len(points) < 64 else (points <= 32) & ((points == 32) | (points >= 9) & (points <= 13))
    code = np.where(space, np.uint32(32), points).astype(np.uint64)
    code = (code + np.uint64(1)) * _PAIR
    code ^= code >> np.uint64(29)
    begins = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if len(begins):
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        place = np.arange(len(points)) - np.repeat(begins, np.diff(np.r_[begins, len(points)])) if begins[0] == 0 else np.arange(len(points)) - np.r_[np.zeros(begins[0], np.int64), np.repeat(begins, np.diff(np.r_[begins, len(points)]))]
        weighed = np.where(space, np.uint64(0), code * _PLACE[place & 63])
        words = np.add.reduceat(weighed, begins)
        owner = text[begins]
        yield owner, _mix(words + _PAIR)
        together = owner[1:] == owner[:-1]
        yield owner[1:][together], _mix((words[1:] ^ words[:-1])[together] * _PLACE[1] + _PLACE[0])
        del place, weighed, ends
    for n, gram in zip(CHAR_NGRAMS, _GRAM, strict=False):
        h = np.zeros(len(code) - n + 1 if len(code) >= n else 0, np.uint64)
        inside = np.ones(len(h), bool)
        for k in range(n):
            h += code[k : k + len(h)] * _PLACE[k + 8 * n % 40]
            if 0 < k < n - 1:
                inside &= ~space[k : k + len(h)]
        at = np.flatnonzero(inside)
        yield text[at + 1], _mix(h[at] + gram)


@dataclass
class QualityModel:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    classes: list[int]

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        """Softmax output, a row per text and a column per class; a text without features has that of the bias."""
        folded = self.vectors @ self.weights
        sums = np.zeros((len(texts), len(self.classes)))
        count = np.zeros(len(texts))
        for owner, bucket in features(texts):
            count += np.bincount(owner, minlength=len(texts))
            for c in range(len(self.classes)):
                sums[:, c] += np.bincount(owner, weights=folded[:, c][bucket], minlength=len(texts))
        logits = sums / np.maximum(count, 1)[:, None] + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)

    def probability_of_one(self, texts: list[bytes | None]) -> np.ndarray:
        return self.probabilities(texts)[:, self.classes.index(1)]


def _sampled(rows: DataFrame) -> DataFrame:
    """The rows with the smallest values of ``h``: SAMPLE_ROWS of them at most, and no more after SAMPLE_BYTES of text."""
    first = rows.select("h", F.octet_length("body").alias("size")).distinct().orderBy("h").limit(SAMPLE_ROWS).collect()
    last, total = None, 0
    for r in first:
        if total >= SAMPLE_BYTES:
            break
        last, total = r["h"], total + r["size"]
    return rows.filter(F.col("h") <= F.lit(last))


def fit(labelled: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id") -> QualityModel:
    """Learn from the whole texts of a sample of SAMPLE_ROWS rows with a label and a text; repeated rows count once.

    Executors count the hashed features.  One task, bounded by the sample, learns from the counts; the driver gets the model
    only, which has a fixed size.  Without any labelled row the model has one answer: even odds.
    """
    rows = labelled.select(F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("string").cast("binary").alias("body"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.col(label_col)).alias("h")).filter(F.col("label").isNotNull() & F.col("body").isNotNull())
    kind = "<u2" if BUCKET_BITS <= 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=1 << 20):
            owners, buckets = (np.concatenate(x) for x in zip(*features(texts), strict=True))
            joint, times = np.unique(owners.astype(np.int64) << 32 | buckets.astype(np.int64), return_counts=True)
            cut = np.searchsorted(joint >> 32, np.arange(len(texts) + 1))
            pairs = [(joint[a:b] & 0xFFFFFFFF, times[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), pa.array([x.astype(kind).tobytes() for x, _ in pairs], pa.binary()), pa.array([y.astype("<u4").tobytes() for _, y in pairs], pa.binary())], ["h", "label", "buckets", "times"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            for h, label, buckets, times in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if buckets:
                    found[h, label] = label, np.frombuffer(buckets, kind), np.frombuffer(times, "<u4")
        model = train([found[k] for k in sorted(found)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = materialize(_sampled(rows).mapInArrow(task(count), "h bigint, label int, buckets binary, times binary"), "quality_sample")
    return pickle.loads(sample.coalesce(1).mapInArrow(task(learn), "model binary").first()["model"])


def train(data: list[tuple[int, np.ndarray, np.ndarray]]) -> QualityModel:
    """Stochastic gradient descent over (label, buckets, times) with a falling rate; rows weigh in so that each class counts the same to one half."""
    classes = sorted({label for label, _, _ in data} | {0, 1})
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSION)) / DIMENSION
    weights, bias = random.normal(0, 0.1, (DIMENSION, len(classes))), np.zeros(len(classes))
    data = [(classes.index(y), b, t) for y, b, t in data]
    seen = np.bincount([y for y, _, _ in data], minlength=len(classes)) if data else np.zeros(len(classes))
    weigh = np.sqrt(len(data) / np.maximum(seen, 1) / len(classes))
    steps, done = max(1, EPOCHS * len(data)), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(data)):
            label, buckets, times = data[k]
            share = times / times.sum()
            rate = RATE * (1 - done / steps)
            mean = share @ vectors[buckets]
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            p *= weigh[label] * rate
            back = weights @ p
            weights -= np.outer(mean, p)
            bias -= 0.05 * p
            vectors[buckets] -= share[:, None] * (back * 40)  # the mean spreads one step over very many rows
            done += 1
    return QualityModel(vectors.astype(np.float32), weights.astype(np.float32), bias, classes)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """One row per row of ``docs``: id, ``score`` (probability of class 1) and the columns named in ``more``.

    Whole texts.  A null or empty text has the score of no features, the bias alone.  Repeated rows and null ids give
    a row each; other columns are not read.  Columns in ``more`` may have any name but those of the result.  No shuffle; the
    model is a fixed-size table, broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = carried(docs, id_col, text_col, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("more"), pa.array(model.probability_of_one(texts))], ["id", "more", "score"])

    found = kept.mapInArrow(task(run), schema_of(kept, ["id", "more"], "score double"))
    return found.select(F.col("id").alias(id_col), *[F.col("more")[x].alias(x) for x in kept.schema["more"].dataType.names[1:]], "score")


def at_least(docs: DataFrame, model: QualityModel, threshold: float):
    """For ``common.keep_rows``: which texts score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda texts: shared.value.probability_of_one(texts) >= threshold
