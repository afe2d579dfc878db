"""Toxicity (operator 6): averaged subword embeddings and a linear softmax, trained jointly.

A word is the bag of its hashed character n-grams, so an unseen misspelling shares most of
its vector with the word it comes from. A passage is the average of its words' vectors, and
a softmax over it gives the class. A text is cut into passages of ``PASSAGE`` words; its
score is that of its most toxic passage, so a long text doesn't dilute one bad sentence.
Embeddings and softmax are fitted together by descent through each text's top passage.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlink.llm import arrays as A
from flowlink.llm.labelled import Adam, sample, sigmoid

BITS = 18
BUCKETS = 1 << BITS
WIDTH = 8
SIZES = (3, 4, 5, 6)
PASSAGE = 4
PER_CLASS = 1500  # labelled rows of each class that the model is fitted on, at most
FEWEST = 20  # texts, counted once per word, that an n-gram is learned from with ``PER_CLASS`` rows of each class
EPOCHS = 40
THRESHOLD = 0.5

# Words are runs of letters, digits and bytes past ASCII: marks part them.
PARTS = np.ones(256, bool)
PARTS[48:58] = PARTS[65:91] = PARTS[97:123] = PARTS[128:] = False
FOLD = np.arange(256, dtype=np.uint64)
FOLD[65:91] += 32


class Model(NamedTuple):
    """Of a trained softmax over averages only each bucket's share of the logit matters."""

    weights: np.ndarray
    bias: float


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of words given by byte ranges, with edges ``<`` and ``>``.

    A word too short for an n-gram is one n-gram by itself.
    """
    length = ends - starts
    size = length + 2
    at = np.concatenate([[0], np.cumsum(size)])
    marked = np.empty(at[-1], np.uint64)
    marked[at[:-1]] = 60
    marked[at[1:] - 1] = 62
    offset = np.arange(at[-1]) - np.repeat(at[:-1], size)
    inner = (offset > 0) & (offset < np.repeat(size, size) - 1)
    marked[inner] = FOLD[data[(np.repeat(starts, size) + offset - 1)[inner]]]
    left = np.repeat(at[1:], size) - np.arange(at[-1])
    word = np.repeat(np.arange(len(starts)), size)
    found, buckets = [], []
    rolling = marked.copy()
    for n in range(2, max(SIZES) + 1):
        rolling = rolling[: max(0, len(marked) - n + 1)] * np.uint64(1099511628211) + marked[n - 1 :]
        fits = left[: len(rolling)] >= n
        if n not in SIZES:
            continue
        keep = np.flatnonzero(fits)
        found.append(word[keep])
        buckets.append((A.mix(rolling[keep] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found), np.concatenate(buckets)


def unlike(text: A.Text) -> tuple[A.Words, np.ndarray, np.ndarray]:
    """The words, the first place of each distinct one, and which of those each word is."""
    spans = A.words(text, PARTS)
    _, first, inverse = np.unique(A.hashes(text, spans), return_index=True, return_inverse=True)
    return spans, first, inverse


def passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, row) of every passage: windows of PASSAGE words, each half over the last."""
    step = PASSAGE // 2
    count = np.diff(bounds)
    many = np.where(count <= PASSAGE, np.minimum(count, 1), (count - PASSAGE + step - 1) // step + 1)
    row = np.repeat(np.arange(len(count)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return bounds[row] + nth * step, row


def _top(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the place of its highest value; -1 without any."""
    order = np.lexsort((-value, row))
    out = np.full(rows, -1)
    first = np.ones(len(order), bool)
    first[1:] = row[order][1:] != row[order][:-1]
    out[row[order][first]] = order[first]
    return out


def _summed(index: np.ndarray, source: np.ndarray, place: np.ndarray, size: int, step: int = 1 << 20) -> np.ndarray:
    """Per index, the sum of ``source[place]``, column by column and a slice at a time."""
    out = np.zeros((size, source.shape[1]))
    for at in range(0, len(index), step):
        i, p = index[at : at + step], place[at : at + step]
        for d in range(source.shape[1]):
            out[:, d] += np.bincount(i, source[:, d][p], size)
    return out


def train(rows: pa.Table, epochs: int = EPOCHS) -> Model:
    """Fits embeddings and softmax together.

    Without rows, or with rows of one class only, the model gives their share, 0.5 if none.
    """
    y, weight = rows["label"].to_numpy(), rows["weight"].to_numpy()
    share = np.clip(np.average(y, weights=weight) if len(y) else 0.5, 0.01, 0.99)
    bias = float(np.log(share / (1 - share)))
    if len(y) < 10 or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), bias)
    # The sample's distinct words, their n-grams, and the texts as sequences of them.
    seen: dict[int, int] = {}
    gram_word, gram_bucket, sequence, bounds, counts, n_words = [], [], [], [np.zeros(1, np.int64)], [], 0
    for text in A.chunks(rows["text"].combine_chunks()):
        spans, first, inverse = unlike(text)
        keys = A.hashes(text, spans)[first]
        number = np.array([seen.setdefault(k, len(seen)) for k in keys.tolist()], np.int64)
        new = number >= n_words
        w, b = grams(text.data, spans.starts[first[new]], spans.ends[first[new]])
        gram_word.append(number[new][w].astype(np.int32))
        gram_bucket.append(b)
        sequence.append(number[inverse].astype(np.int32))
        held = np.unique(spans.row() * len(first) + inverse) % max(1, len(first))
        counts.append((number, np.bincount(held, minlength=len(first))))
        bounds.append(spans.bounds[1:] + bounds[-1][-1])
        n_words = len(seen)
    gram_word, gram_bucket, sequence = (np.concatenate(x) for x in (gram_word, gram_bucket, sequence))
    per_word = np.bincount(gram_word, minlength=n_words)
    # N-grams of few texts teach nothing that holds elsewhere: their vectors stay zero. What
    # few means is a share of the smaller class, two texts at least.
    fewest = max(2, int(min((y == 1).sum(), (y == 0).sum())) * FEWEST // PER_CLASS)
    texts_with = np.bincount(np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts]), n_words)
    usual = np.bincount(gram_bucket, texts_with[gram_word], BUCKETS) >= fewest
    kept = usual[gram_bucket]
    gram_word, gram_bucket = gram_word[kept], gram_bucket[kept]
    del kept, counts, texts_with, seen
    bounds = np.concatenate(bounds)
    begin, row = passages(bounds)
    end = np.minimum(begin + PASSAGE, bounds[row + 1])
    random = np.random.default_rng(7)
    vectors = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32) * usual[:, None]
    soft = random.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    base = np.array([0.0, bias], np.float32)
    # Where word vectors start from and the softmax's scale keep averages of a few words apart.
    steps = Adam(vectors.shape, 0.1), Adam(soft.shape, 0.1), Adam(base.shape, 0.05)
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(epochs):
        word = _summed(gram_word, vectors, gram_bucket, n_words) / per_word[:, None]
        margin = word @ (soft[:, 1] - soft[:, 0])
        total = np.concatenate([[0.0], np.cumsum(margin[sequence], dtype=np.float64)])
        top = _top((total[end] - total[begin]) / (end - begin), row, len(y))
        have = top[top >= 0]
        of = row[have]
        size = end[have] - begin[have]
        place = np.repeat(begin[have], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text_of = np.repeat(np.arange(len(have)), size)
        mean = np.stack([np.bincount(text_of, word[sequence[place], d], len(have)) for d in range(WIDTH)], 1) / size[:, None]
        logits = mean @ soft + base
        p = sigmoid(logits[:, 1] - logits[:, 0])
        gap = (p - y[of]) * balance[of]
        both = np.stack([-gap, gap], 1)
        back = (both @ soft.T) / size[:, None]
        by_word = np.stack([np.bincount(sequence[place], back[text_of, d], n_words) for d in range(WIDTH)], 1) / per_word[:, None]
        touched = np.flatnonzero(by_word.any(1)[gram_word])
        hit, mine = gram_bucket[touched], by_word[gram_word[touched]]
        pull = np.stack([np.bincount(hit, mine[:, d], BUCKETS) for d in range(WIDTH)], 1).astype(np.float32)
        vectors -= steps[0].step(pull + 1e-7 * vectors) * (pull != 0)
        soft -= steps[1].step((mean.T @ both).astype(np.float32))
        base -= steps[2].step(both.sum(0).astype(np.float32))
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(base[1] - base[0]))


def scored(texts: pa.Array, model: Model) -> pa.Array:
    """The score of every text; one without words, null too, has the score of the bias."""
    out = []
    for text in A.chunks(texts):
        spans, first, inverse = unlike(text)
        word, bucket = grams(text.data, spans.starts[first], spans.ends[first])
        value = np.bincount(word, model.weights[bucket], len(first)) / np.maximum(np.bincount(word, minlength=len(first)), 1)
        total = np.concatenate([[0.0], np.cumsum(value[inverse])])
        begin, row = passages(spans.bounds)
        end = np.minimum(begin + PASSAGE, spans.bounds[row + 1])
        logit = np.full(text.rows, -np.inf)
        np.maximum.at(logit, row, (total[end] - total[begin]) / np.maximum(end - begin, 1))
        out.append(sigmoid(np.where(np.isinf(logit), 0.0, logit) + model.bias))
    return pa.array(np.concatenate(out) if out else [], pa.float64())


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", into: str = "score", per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with a column ``into``: the probability that a text's toxic label is 1.

    Null and wordless texts have the score that no evidence gives. All other columns stay;
    one named as ``into`` is replaced. An empty table stays empty, repeated rows score
    alike, and without usable labels every score is the labels' share. Only the text is an
    input of the score. The model's size is fixed, so it goes to executors as a broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, "toxic", per_class)))

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return scored(texts, model.value)

    return docs.withColumn(into, run(F.col(text)))
