"""Quality classifier (operator 8): a generalised additive model with pairwise interactions.

Each feature of a text falls into one of a fixed number of bins. Boosting goes round the
features, each time fitting a tree of up to three leaves to the residual over one feature's
bins and adding a little of it to that feature's lookup table; then the pairs of features
that explain most of what is left get tables of their own in the same way. A score is a sum
of table entries: vectorised additions, no trees at run time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlink.llm import arrays as A
from flowlink.llm.labelled import sample, sigmoid

PER_CLASS = 3000  # labelled rows of each class that the model is fitted on, at most
BINS = 32
ROUNDS = 60
PAIRS = 6
PAIR_ROUNDS = 20
RATE = 0.2
THRESHOLD = 0.3

NAMES = (
    "words", "chars", "word_length", "line_length", "upper", "digits", "symbols", "marks", "bars", "stops", "capitals",
    "unlike_words", "repeated_words", "repeated_lines", "long_words", "short_words", "white", "other_bytes",
)


class Model(NamedTuple):
    cuts: list[np.ndarray]
    single: np.ndarray  # feature, bin
    pairs: list[tuple[int, int]]
    double: np.ndarray  # pair, bin, bin
    bias: float


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


UPPER, DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
SYMBOL, MARK, BAR, STOP = _class(b"#*$%&<>{}[]\\^~@+="), _class(b"!?"), _class(b"|"), _class(b".,;:")
OTHER = _class(bytes(range(128, 256)))


def features(text: A.Text) -> np.ndarray:
    """Rows by features, all from whole texts; shares of an empty text are 0."""
    spans = A.words(text)
    row, n = spans.row(), np.diff(spans.bounds).astype(np.float64)
    size = np.diff(text.bounds).astype(np.float64)
    length = (spans.ends - spans.starts).astype(np.float64)
    broken = A.lines(text)
    lines = np.diff(broken.bounds).astype(np.float64)
    words = A.hashes(text, spans)
    of_row = A.mix(row.astype(np.uint64))

    def share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
        return count / np.maximum(of, 1)

    def sums(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row, mask, minlength=text.rows)

    def unlike(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        _, first = np.unique(keys, return_index=True)
        return np.bincount(rows[first], minlength=text.rows).astype(np.float64)

    kept = unlike(A.mix(words + of_row), row)
    pairs = A.windows(words, 3)
    inside = np.flatnonzero(row[: len(pairs)] == row[2:]) if len(pairs) else np.zeros(0, np.int64)
    runs = unlike(A.mix(pairs[inside] + of_row[inside]), row[inside])
    line_row = broken.row()
    distinct_lines = unlike(A.mix(A.hashes(text, broken, fold=False) + A.mix(line_row.astype(np.uint64))), line_row)
    of = {name: A.counted(mask[text.data], text.bounds).astype(np.float64) for name, mask in (
        ("upper", UPPER), ("digits", DIGIT), ("symbols", SYMBOL), ("marks", MARK), ("bars", BAR), ("stops", STOP),
        ("white", A.WHITE), ("other", OTHER),
    )}
    capital = sums(UPPER[text.data[spans.starts]]) if len(spans.starts) else np.zeros(text.rows)
    return np.stack([
        np.log1p(n), np.log1p(size), share(size - of["white"], n), share(size, lines),
        share(of["upper"], size), share(of["digits"], size), share(of["symbols"], size), share(of["marks"], size),
        share(of["bars"], size), share(of["stops"], n), share(capital, n),
        share(kept, n), 1 - share(runs, np.maximum(n - 2, 1)), 1 - share(distinct_lines, lines),
        share(sums(length > 12), n), share(sums(length <= 3), n), share(of["white"], size), share(of["other"], size),
    ], 1)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], 1)


def _leaves(grad: np.ndarray, hess: np.ndarray, cut: int = 2) -> np.ndarray:
    """The leaf value of each bin under a tree of up to ``cut`` splits over ordered bins."""
    edges = [0, len(grad)]
    for _ in range(cut):
        best, place = 1e-9, None
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
            left = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
            i = int(np.argmax(left))
            if left[i] > best:
                best, place = left[i], a + i + 1
        if place is None:
            break
        edges = sorted([*edges, place])
    out = np.zeros(len(grad))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each axis: its leaf values over the grid, and its gain."""

    def corners(x: np.ndarray) -> np.ndarray:
        s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        s[1:, 1:] = x.cumsum(0).cumsum(1)
        return s

    g, h = corners(grad), corners(hess)
    i, j = np.arange(1, grad.shape[0])[:, None], np.arange(1, grad.shape[1])[None, :]

    def four(s: np.ndarray) -> list[np.ndarray]:
        a = s[i, j]
        b, c = s[i, -1] - a, s[-1, j] - a
        return [a, b, c, s[-1, -1] - a - b - c]

    parts = list(zip(four(g), four(h), strict=True))
    gain = sum(x * x / (y + 1) for x, y in parts) - g[-1, -1] ** 2 / (h[-1, -1] + 1)
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(grad)
    p, q = at[0] + 1, at[1] + 1
    values = [x[at] / (y[at] + 1) for x, y in parts]
    out[:p, :q], out[:p, q:], out[p:, :q], out[p:, q:] = values
    return out, float(gain[at])


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Cyclic boosting of single tables, then of the pairs with the highest gain.

    Without rows, or with rows of one class only, the model gives their share, 0.5 if none.
    """
    width = len(NAMES)
    if len(y) < 10 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        none = [np.zeros(0)] * width
        return Model(none, np.zeros((width, BINS)), [], np.zeros((0, BINS, BINS)), float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = binned(x, cuts)
    prior = np.clip(np.average(y, weights=weight), 0.01, 0.99)
    bias = float(np.log(prior / (1 - prior)))
    single = np.zeros((width, BINS))
    logit = np.full(len(y), bias)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(logit)
        return (y - p) * weight, p * (1 - p) * weight

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = residual()
            step = RATE * _leaves(np.bincount(bins[:, j], g, BINS), np.bincount(bins[:, j], h, BINS))
            single[j] += step
            logit += step[bins[:, j]]
    g, h = residual()

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(bins[:, a] * BINS + bins[:, b], values, BINS * BINS).reshape(BINS, BINS)

    gains = {(a, b): _quadrants(grid(a, b, g), grid(a, b, h))[1] for a in range(width) for b in range(a + 1, width)}
    pairs = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
    double = np.zeros((len(pairs), BINS, BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            g, h = residual()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[0]
            double[k] += step
            logit += step[bins[:, a], bins[:, b]]
    return Model(cuts, single, pairs, double, bias)


def fit(rows: pa.Table) -> Model:
    found = [features(t) for t in A.chunks(rows["text"].combine_chunks())]
    x = np.concatenate(found) if found else np.zeros((0, len(NAMES)))
    return train(x, rows["label"].to_numpy(), rows["weight"].to_numpy())


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities: one table entry per feature and pair, added up."""
    bins = binned(x, model.cuts)
    logit = np.full(len(x), model.bias)
    for j, table in enumerate(model.single):
        logit += table[bins[:, j]]
    for (a, b), table in zip(model.pairs, model.double, strict=True):
        logit += table[bins[:, a], bins[:, b]]
    return sigmoid(logit)


def scored(texts: pa.Array, model: Model) -> pa.Array:
    parts = [predict(model, features(t)) for t in A.chunks(texts)]
    return pa.array(np.concatenate(parts) if parts else [], pa.float64())


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", into: str = "score", per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with a column ``into``: the probability that a text's quality label is 1.

    Null texts are scored as empty ones. All other columns stay; one named as ``into`` is
    replaced. An empty table stays empty, repeated rows score alike, and without usable
    labels every score is the labels' share. Only the text is an input of the score. The
    model's size is fixed, so it goes to executors as a broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, "quality", per_class)))

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return scored(texts, model.value)

    return docs.withColumn(into, run(F.col(text)))
