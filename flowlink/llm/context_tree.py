"""LM scoring (operator 3): context-tree weighting over bytes, and a unigram base.

A byte is eight binary decisions, each at a node of the byte's binary tree; every context
(the last 0 to ``DEPTH`` bytes) keeps how often each node's decision was 0 and 1. The
Krichevsky-Trofimov estimate of those counts, and the weighted probability of the context's
own children, are mixed half and half from the deepest contexts up: that is the tree's
weighted probability, which depends on counts only, not on their order. A frozen tree codes
a new bit by following the context from the root, each context giving its estimate the share
that its own evidence has in its weighted probability. The sum of the bits' code lengths is
the text's score.

Counting is a distributed sum of byte-gram counts. Deep contexts are weighted where their
counts are, per pair of last bytes; what is above them has at most 65,280 nodes. Texts are
scored against blocks of contexts of bounded size, one after the other, so no worker ever
holds more than one block of a tree that grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlink.llm import arrays as A
from flowlink.llm.labelled import held_out
from flowlink.llm.shared import stored

DEPTH = 4
BLOCK = 1_000_000  # byte-grams of a scoring block, at most (and those of one pair of last bytes)
HEAD = 400_000  # words whose counts are broadcast, at most; the others are joined
KEEP = 1 << 20  # distinct grams or words that a counting task holds before it hands them on
END = 255  # never a byte of UTF-8: begins and ends every text

HALF = float(np.log(0.5))


# --- Numbers ----------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, past 8 by the recurrence."""
    x = np.asarray(x, np.float64)
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        low[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts under the KT estimate."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - 2 * log_gamma(np.array([0.5]))[0] - log_gamma(zeros + ones + 1.0)


class Nodes(NamedTuple):
    """Decisions at one depth: ``key`` is context * 256 + node of the byte's tree, sorted."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray


def decisions(context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> Nodes:
    """Counts of the eight decisions that code each byte after its context."""
    keys, zeros, ones = [], [], []
    for bit in range(8):
        node = (1 << bit) | (byte >> (8 - bit))
        one = (byte >> (7 - bit)) & 1
        keys.append(context * 256 + node)
        zeros.append(np.where(one == 0, count, 0))
        ones.append(np.where(one == 1, count, 0))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return Nodes(key, np.bincount(at, np.concatenate(zeros), len(key)), np.bincount(at, np.concatenate(ones), len(key)))


def shorter(key: np.ndarray, depth: int) -> np.ndarray:
    """The keys of the same nodes after the last ``depth`` bytes only."""
    return (key >> 8) % (1 << (8 * depth)) * 256 + (key & 255)


def weighted(nodes: Nodes, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, share of the own estimate) of each node."""
    own = log_kt(nodes.zeros, nodes.ones)
    if children is None:
        return own, np.ones(len(own))
    whole = HALF + np.logaddexp(own, children)
    return whole, np.exp(HALF + own - whole)


class Level(NamedTuple):
    """One depth of a frozen tree: estimates of a one, and the estimates' shares."""

    key: np.ndarray
    one: np.ndarray
    share: np.ndarray


def levels(context: np.ndarray, byte: np.ndarray, count: np.ndarray, deepest: int, least: int) -> tuple[list[Level], Nodes, np.ndarray]:
    """Depths ``least`` to ``deepest`` of the tree of these grams, and the top's probabilities."""
    out, below = [], None
    for depth in range(deepest, least - 1, -1):
        nodes = decisions(context % (1 << (8 * depth)), byte, count)
        children = None
        if below is not None:
            parent = np.searchsorted(nodes.key, shorter(below[0], depth))
            children = np.bincount(parent, below[1], len(nodes.key))
        whole, share = weighted(nodes, children)
        out.insert(0, Level(nodes.key, (nodes.ones + 0.5) / (nodes.zeros + nodes.ones + 1), share))
        below = nodes.key, whole
    return out, nodes, whole


# --- Counting ---------------------------------------------------------------------------


def framed(text: A.Text, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bytes, A-Z lower-cased, after ``depth`` end marks and before one; where rows begin."""
    size = np.diff(text.bounds) + depth + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], END, np.int64)
    place = np.arange(len(text.data)) + np.repeat(at[:-1] + depth - text.bounds[:-1], np.diff(text.bounds))
    low = text.data.astype(np.int64)
    low[(low >= 65) & (low <= 90)] += 32
    out[place] = low
    return out, at


def grams(text: A.Text, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every coded byte with the ``depth`` before it, as one number each, and the row it is of."""
    data, at = framed(text, depth)
    key = data[: len(data) - depth].copy()
    for i in range(1, depth + 1):
        key = (key << 8) | data[i : len(data) - depth + i]
    row = np.repeat(np.arange(text.rows), np.diff(at))[depth:]
    inside = np.ones(len(key), bool)
    for i in range(1, depth + 1):  # windows that would run over a row's beginning
        begin = at[1:-1] - depth + i - 1
        inside[begin[(begin >= 0) & (begin < len(key))]] = False
    return key[inside], row[inside]


class Tally:
    """Counts of numbers, handed on as batches whenever many are held."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.held = kind, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > KEEP:
            self.merge()
            if self.held > KEEP // 2:
                yield from self.flush()

    def merge(self) -> None:
        keys, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([p[1] for p in self.parts]), len(keys)).astype(np.int64)
        self.parts, self.held = [(keys, counts)], len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            keys, counts = self.parts[0]
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), self.kind, np.int8)), pa.array(part.view(np.int64)), pa.array(counts[i : i + (1 << 16)])],
                    names=["kind", "key", "n"],
                )
        self.parts, self.held = [], 0


GRAM, WORD, TOTAL = 0, 1, 2  # kinds of counts


def count_corpus(docs: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n): byte-grams, words by hash, and the number of tokens, over all ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_gram, by_word, tokens = Tally(GRAM), Tally(WORD), 0
        for batch in batches:
            for text in A.chunks(batch.column(0)):
                yield from by_gram.add(*np.unique(grams(text, depth)[0], return_counts=True))
                spans = A.words(text)
                yield from by_word.add(*np.unique(A.hashes(text, spans), return_counts=True))
                tokens += len(spans.starts) + text.rows
        yield from by_gram.flush()
        yield from by_word.flush()
        total = Tally(TOTAL)
        yield from total.add(np.zeros(1, np.int64), np.array([tokens]))
        yield from total.flush()

    found = docs.select("text").mapInArrow(count, "kind tinyint, key bigint, n bigint")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- The tree ---------------------------------------------------------------------------


class Block(NamedTuple):
    """A frozen tree for contexts that end in given pairs of bytes.

    ``levels`` has all depths; ``seen`` the grams met in learning with their log10
    probabilities, so that most bytes are coded by one look-up; ``mine`` the pairs.
    """

    depth: int
    levels: list[Level]
    seen: np.ndarray
    logs: np.ndarray
    mine: np.ndarray


def code(tree: list[Level], context: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Log10 probability of each byte after its context."""
    total = np.zeros(len(byte))
    for bit in range(8):
        node = (1 << bit) | (byte >> (8 - bit))
        one = (byte >> (7 - bit)) & 1
        p = np.full(len(byte), 0.5)
        for depth in range(len(tree) - 1, -1, -1):
            level = tree[depth]
            if not len(level.key):
                continue
            key = context % (1 << (8 * depth)) * 256 + node
            at = np.minimum(np.searchsorted(level.key, key), len(level.key) - 1)
            known = level.key[at] == key
            # Without evidence a context and all below it say one half.
            p = np.where(known, level.share[at] * level.one[at] + (1 - level.share[at]) * p, 0.5)
        total += np.log10(np.where(one == 1, p, 1 - p))
    return total


def top_of(counts: DataFrame, depth: int) -> list[Level]:
    """Depths 0 and 1: what lies below is weighted per pair of last bytes, where its counts are."""
    schema = "key bigint, zeros double, ones double, whole double"

    def below(rows: pa.Table) -> pa.Table:
        gram, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        _, nodes, whole = levels(gram >> 8, gram & 255, n, depth, 2)
        return pa.table({"key": shorter(nodes.key, 1), "zeros": nodes.zeros, "ones": nodes.ones, "whole": whole})

    pairs = counts.filter(F.col("kind") == GRAM).withColumn("pair", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
    sums = pairs.groupBy("pair").applyInArrow(below, schema).groupBy("key").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("whole").alias("whole")
    )
    got = sums.toArrow().sort_by("key")  # one row per last byte and node: at most 65,280
    key, zeros, ones, children = (got[c].to_numpy() for c in ("key", "zeros", "ones", "whole"))
    first = Nodes(key, zeros, ones)
    whole, share = weighted(first, children)
    root_key, at = np.unique(key & 255, return_inverse=True)
    root = Nodes(root_key, np.bincount(at, zeros, len(root_key)), np.bincount(at, ones, len(root_key)))
    _, root_share = weighted(root, np.bincount(at, whole, len(root_key)))
    return [
        Level(root.key, (root.ones + 0.5) / (root.zeros + root.ones + 1), root_share),
        Level(first.key, (first.ones + 0.5) / (first.zeros + first.ones + 1), share),
    ]


def blocks(counts: DataFrame, depth: int, most: int) -> Iterator[Block]:
    """The tree block by block: pairs of last bytes with at most ``most`` grams together."""
    top = top_of(counts, depth)
    found = counts.filter(F.col("kind") == GRAM)
    pair = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).cast("int")
    sizes = found.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("pair")
    block_of, held, ranges = np.zeros(1 << 16, np.int32), 0, [[0, -1]]
    for p, n in zip(sizes["pair"].to_pylist(), sizes["n"].to_pylist(), strict=True):
        if held and held + n > most:
            ranges.append([p, p])
            held = 0
        block_of[p] = len(ranges) - 1
        ranges[-1][1] = p
        held += n
    for b, (low, high) in enumerate(ranges):
        got = found.filter(pair.between(low, high)).select("key", "n").toArrow().sort_by("key")
        gram, n = got["key"].to_numpy(), got["n"].to_numpy()
        deep, _, _ = levels(gram >> 8, gram & 255, n, depth, 2)
        tree = [*top, *deep]
        # Pairs never met are the first block's.
        yield Block(depth, tree, gram, code(tree, gram >> 8, gram & 255).astype(np.float32), block_of == b)


# --- Scoring ----------------------------------------------------------------------------


def tree_scores(text: A.Text, block: Block, seen: A.Lookup) -> np.ndarray:
    """Per row, the sum of log10 probabilities of the bytes that this block codes."""
    key, row = grams(text, block.depth)
    if not block.mine.all():
        inside = block.mine[(key >> 8) & 0xFFFF]
        key, row = key[inside], row[inside]
    at = seen.find(key.view(np.uint64))
    value = np.zeros(len(key))
    known = at >= 0
    value[known] = block.logs[at[known]]
    new, place = np.unique(key[~known], return_inverse=True)
    value[~known] = code(block.levels, new >> 8, new & 255)[place]
    return np.bincount(row, value, minlength=text.rows)


def _scored(docs: DataFrame, block: Broadcast, base: Broadcast | None) -> DataFrame:
    """(doc_id, fp, n_tokens, score, known, base, tail, tail_n), a row per document.

    ``tail`` are words that the broadcast counts don't have, with their number in the text.
    """
    schema = (
        "doc_id bigint, fp bigint, n_tokens bigint, score double, known bigint, base double, "
        "tail array<bigint>, tail_n array<int>"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = block.value
        seen = A.Lookup(tree.seen.view(np.uint64))
        head = A.Lookup(base.value[0]) if base is not None else None
        for batch in batches:
            ids = batch.column(0)
            for text in A.chunks(batch.column(1)):
                n = text.rows
                sums = A.prefix_sums(text.data, False)
                fp = A.range_hashes(sums, text.bounds[:-1], text.bounds[1:])
                spans = A.words(text)
                columns = [
                    ids.slice(text.first, n), pa.array(fp.view(np.int64)),
                    pa.array(np.diff(spans.bounds) + 1, pa.int64()), pa.array(tree_scores(text, tree, seen), pa.float64()),
                ]
                if head is None:
                    none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
                    columns += none
                else:
                    columns += _base_columns(text, spans, head, base.value[1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "n_tokens", "score", "known", "base", "tail", "tail_n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, schema)


def _base_columns(text: A.Text, spans: A.Words, head: A.Lookup, logs: np.ndarray) -> list[pa.Array]:
    row, key = spans.row(), A.hashes(text, spans)
    at = head.find(key)
    known = at >= 0
    value = np.bincount(row[known], logs[at[known]], minlength=text.rows)
    rest_row, rest = row[~known], key[~known]
    order = np.lexsort((rest, rest_row))
    rest_row, rest = rest_row[order], rest[order]
    first = np.ones(len(rest), bool)
    first[1:] = (rest[1:] != rest[:-1]) | (rest_row[1:] != rest_row[:-1])
    begin = np.flatnonzero(first)
    many = np.diff(np.append(begin, len(rest))).astype(np.int32)
    bounds = pa.array(np.searchsorted(rest_row[begin], np.arange(text.rows + 1)).astype(np.int32))
    return [
        pa.array(np.bincount(row[known], minlength=text.rows), pa.int64()), pa.array(value, pa.float64()),
        pa.ListArray.from_arrays(bounds, pa.array(rest[begin].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(many)),
    ]


def _head(counts: DataFrame, most: int, tokens: int, distinct: int, ends: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most ``most``, by hash, with their base log10 probabilities.

    The lowest count that still fits is found from how many words have each count.
    """
    words = counts.filter(F.col("kind") == WORD)
    spread = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).toArrow()
    room = np.cumsum(spread["words"].to_numpy()) <= most
    if not room.any():
        return np.zeros(0, np.uint64), np.zeros(0)
    least = int(spread["n"].to_numpy()[room][-1])
    got = words.filter(F.col("n") >= least).select("key", "n").toArrow()
    logs = np.log10((got["n"].to_numpy() + 1) / (tokens + distinct + 1))
    return got["key"].to_numpy().view(np.uint64), logs


def score_texts(
    docs: DataFrame, learn: Column | None = None, depth: int = DEPTH, block: int = BLOCK, head: int = HEAD
) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` says which rows are learned from (by default those whose crc32(doc_id) modulo 7
    is not 2). Null texts are empty: their one token is the end. Null ids are learned from
    and score like any other; repeated rows count each time and all come back; other columns
    are not looked at. An empty table gives an empty one; with nothing to learn from, every
    bit costs one bit.

    Words outside the broadcast head are joined with their counts by word, after each text's
    repeats were added up, and summed per text: exact, however many there are.
    """
    if depth < 2:
        raise ValueError("a tree has at least depth 2")
    learned = ~held_out("doc_id", 7, 2) if learn is None else learn
    texts = docs.select("doc_id", "text")
    counts = stored(count_corpus(texts.filter(learned), depth), "context-counts")
    # The end token: one per learned text; its count is that of learned rows.
    ends = texts.filter(learned).count()
    totals = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()
    of = {r["kind"]: r for r in totals}
    tokens = of[TOTAL]["n"] if TOTAL in of else 0
    distinct = (of[WORD]["distinct"] if WORD in of else 0) + (1 if ends else 0)
    spark = docs.sparkSession
    base = spark.sparkContext.broadcast(_head(counts, head, tokens, distinct, ends))
    parts = [
        _scored(texts, spark.sparkContext.broadcast(b), base if i == 0 else None) for i, b in enumerate(blocks(counts, depth, block))
    ]
    rows = stored(reduce(DataFrame.unionByName, parts), "context-scores")
    key = ["doc_id", "fp"]
    once = rows.groupBy(*key).agg(
        F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("rows"), F.sum("score").alias("score"),
        F.max("known").alias("known"), F.max("base").alias("base"),
    )
    tail = rows.filter(F.size("tail") > 0).groupBy(*key).agg(F.first("tail").alias("tail"), F.first("tail_n").alias("tail_n"))
    flat = tail.select(*key, F.inline(F.arrays_zip(F.col("tail").alias("key"), F.col("tail_n").alias("times"))))
    words = counts.filter(F.col("kind") == WORD).select("key", F.col("n").alias("count"))
    scale = float(tokens + distinct + 1)
    got = F.coalesce("count", F.lit(0))
    rest = flat.join(words, "key", "left").groupBy(*key).agg(
        F.sum(F.when(got > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * F.log10((got + 1) / F.lit(scale))).alias("tail_base"),
    )
    left, right = once.alias("l"), rest.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.fp") == F.col("r.fp"))
    end_log = float(np.log10((ends + 1) / scale))
    copies = F.col("rows") / F.lit(len(parts))
    return left.join(right, same, "left").select(
        F.col("l.doc_id").alias("doc_id"),
        held_out("l.doc_id", 7, 2).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) + F.lit(end_log)).alias("base_score"),
        (F.col("score") / copies).alias("score"),
        F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("_copy"),
    ).drop("_copy")
