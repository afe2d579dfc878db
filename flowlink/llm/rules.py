"""Quality rules (operator 9): counted rules, and a calibrated n-gram logistic regression.

The model sees a text as hashed words and hashed character 3-grams, each weighted by
``1 + log(count)`` and scaled to length one. It is fitted on a bounded sample of labelled
rows; a part of the sample held back for it sets the calibration. Texts are scored in Arrow
batches against a fixed threshold.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlink.llm import arrays as A
from flowlink.llm.labelled import Adam, sample, sigmoid

BUCKETS = 1 << 18
PER_CLASS = 1500  # labelled rows of each class that the model is fitted on, at most
EPOCHS = 60
THRESHOLD = 0.5
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,probability:double>"
)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def repeated(values: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Per row, how many of its words lie in a ``k``-word window found there twice or more."""
    n, rows = len(values), len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    every = A.windows(values, k)
    whole = row[: len(every)] == row[k - 1 :] if len(every) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    _, inverse, count = np.unique(A.mix(every[at] + A.mix(row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + k, -1)
    return A.counted(np.cumsum(cover)[:n] > 0, bounds)


def duplicate_lines(text: A.Text) -> np.ndarray:
    """Per row, how many of its lines hold a word and equal an earlier line."""
    spans = A.lines(text)
    worded = A.counted(~A.WHITE[text.data], np.stack([spans.starts, spans.ends], 1).ravel())[::2] > 0
    row = spans.row()[worded]
    key = A.mix(A.hashes(text, spans, fold=False)[worded] + A.mix(row.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row, minlength=text.rows) - np.bincount(row[first], minlength=text.rows)


def features(text: A.Text, spans: A.Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of every row's distinct words and character 3-grams."""
    row = spans.row()
    data = text.data.astype(np.uint64)
    grams = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:] if len(data) > 2 else data[:0]
    place = np.repeat(np.arange(text.rows), np.diff(text.bounds))
    inside = np.flatnonzero(place[: len(grams)] == place[2:]) if len(grams) else np.zeros(0, np.int64)
    rows = np.concatenate([row, place[inside]])
    bucket = np.concatenate([words, A.mix(grams[inside])]) >> np.uint64(64 - 18)
    key, count = np.unique((rows.astype(np.uint64) << np.uint64(18)) | bucket, return_counts=True)
    rows, bucket = (key >> np.uint64(18)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64)
    value = 1.0 + np.log(count)
    norm = np.sqrt(np.bincount(rows, value * value, minlength=text.rows))
    return rows, bucket, value / norm[rows]


def train(rows: pa.Table, epochs: int = EPOCHS) -> Model:
    """Logistic regression by full-batch descent, then a Platt scaling on every fifth row.

    Without rows, or with rows of one class only, the model gives their share, 0.5 if none.
    """
    y, weight = rows["label"].to_numpy(), rows["weight"].to_numpy()
    if len(y) < 10 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    parts = []
    for text in A.chunks(rows["text"].combine_chunks()):
        spans = A.words(text)
        row, bucket, value = features(text, spans, A.hashes(text, spans, fold=False))
        parts.append((row + text.first, bucket, value))
    row, bucket, value = (np.concatenate(x) for x in zip(*parts))
    fit = np.arange(len(y)) % 5 != 4
    used = fit[row]
    r, b, v = row[used], bucket[used], value[used]
    weights, bias = np.zeros(BUCKETS, np.float32), 0.0
    adam, total = Adam((BUCKETS,), 0.2), (weight * fit).sum()
    for _ in range(epochs):
        p = sigmoid(np.bincount(r, weights[b] * v, minlength=len(y)) + bias)
        gap = (p - y) * weight * fit / total
        weights -= adam.step((np.bincount(b, gap[r] * v, minlength=BUCKETS) + 1e-6 * weights).astype(np.float32))
        bias -= 5.0 * gap.sum()
    logit = np.bincount(row, weights[bucket] * value, minlength=len(y)) + bias
    slope, offset = platt(logit[~fit], y[~fit], weight[~fit])
    return Model(weights, float(bias), slope, offset)


def platt(logit: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset that make held-back logits into probabilities."""
    slope, offset = 1.0, 0.0
    if y.min() == y.max():
        return slope, offset
    # Targets a little off 0 and 1 keep the slope finite where the classes part cleanly.
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    scale = np.abs(logit).mean() + 1e-9
    x, a, c = logit / scale, scale, 0.0
    for _ in range(steps):
        gap = (sigmoid(a * x + c) - target) * weight
        h = sigmoid(a * x + c) * (1 - sigmoid(a * x + c)) * weight + 1e-6
        det = (h * x * x).sum() * h.sum() - (h * x).sum() ** 2
        if det <= 1e-12:
            break
        ga, gc = (gap * x).sum(), gap.sum()
        a -= 0.5 * (h.sum() * ga - (h * x).sum() * gc) / det
        c -= 0.5 * ((h * x * x).sum() * gc - (h * x).sum() * ga) / det
    return (float(a / scale), float(c)) if a > 0 and np.isfinite(a + c) else (slope, offset)


def measured(texts: pa.Array, model: Model) -> pa.StructArray:
    """The result struct of every text; null is empty."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    for text in A.chunks(texts):
        spans = A.words(text)
        words = A.hashes(text, spans, fold=False)
        row, bucket, value = features(text, spans, words)
        logit = np.bincount(row, model.weights[bucket] * value, minlength=text.rows) + model.bias
        letters = ((text.data & 0xC0) != 0x80) & ~A.WHITE[text.data]
        found = (
            np.diff(spans.bounds),
            A.counted(letters, text.bounds),
            A.counted(SYMBOLS[text.data], text.bounds),
            duplicate_lines(text),
            repeated(words, spans.bounds, WINDOW),
            sigmoid(model.slope * logit + model.offset),
        )
        for column, part in zip(columns, found):
            column.append(part)
    kinds = [pa.int64()] * 5 + [pa.float64()]
    whole = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds)]
    return pa.StructArray.from_arrays(
        whole, names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"]
    )


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", into: str = "rules", per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with a struct column ``into``: five counts and the probability of good quality.

    Null texts count as empty and have no words. All other columns stay; one named as
    ``into`` is replaced. An empty table stays empty, and repeated rows are judged alike.
    The model's size is fixed (``BUCKETS`` weights), so it goes to executors as a broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, "quality", per_class)))

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        return measured(texts, model.value)

    return docs.withColumn(into, run(F.col(text)))
