"""Phrase collocations, mined with mergeable Misra-Gries summaries (operator 12).

First pass: every n-gram of every piece of text is dealt by its hash to one of the summaries;
tasks count their own n-grams exactly before that, so summaries merge counts. A summary
holds more n-grams than its mass divided by the threshold, so what is taken from any n-gram
stays below the threshold: one as frequent as the threshold always survives, whatever else
there is. Second pass: the n-grams of the survivors are counted exactly, as text. What only
seemed frequent goes, and scores follow from exact counts alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlink.llm import arrays as A
from flowlink.llm.shared import bitmap_of, stored, wanted

CHUNK = 1 << 21  # bytes of text counted at a time
HELD = 1 << 20  # counts a task gathers before it puts them together, or hands them on
PHRASES = 1 << 18  # of those that come with their text
ROWS = 1 << 10  # texts of a batch looked at together
MASS = 1 << 26  # occurrences a summary is meant for; the number of summaries grows with the text
LEAST_BITS, MOST_BITS = 16, 27  # of the bitmap of survivors: 8 KB to 16 MB
SALTS = 32  # first rounds of the tournament for the best phrases of a language

_ENDS = np.zeros(256, bool)  # what ends a piece: [.,;:!?\x0A-\x0D]
_ENDS[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 10, 11, 12, 13]] = True
_PARTS = _ENDS.copy()  # what parts words: that, and spaces and tabs
_PARTS[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Grams(NamedTuple):
    """Distinct n-grams of one size: the group of rows, the words by number, how often."""

    group: np.ndarray
    words: np.ndarray
    count: np.ndarray


class Counted(NamedTuple):
    """All n-grams of a run of rows, size by size, and the words they are made of."""

    vocabulary: pa.Array
    hashes: np.ndarray
    sizes: list[Grams]


def ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct codes, how often each occurs, and each code's place among them."""
    order = np.argsort(codes)
    ran = codes[order]
    new = np.ones(len(ran), bool)
    new[1:] = ran[1:] != ran[:-1]
    place = np.empty(len(codes), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return ran[at], np.diff(np.append(at, len(codes))), place


def strings(text: A.Text, words: A.Words) -> pa.Array:
    """The words as an Arrow array: they and what stands between them take turns over the same bytes."""
    n = len(words.starts)
    if not n:
        return pa.array([], pa.large_string())
    offsets = np.ascontiguousarray(np.stack([words.starts, words.ends], 1).ravel().astype(np.int64))
    turns = pa.LargeStringArray.from_buffers(2 * n - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text.data)))
    return turns.take(pa.array(np.arange(0, 2 * n, 2)))


def count_grams(text: A.Text, group: np.ndarray, longest: int) -> Counted:
    """All n-grams of up to ``longest`` words within pieces, counted per group of rows.

    An n-gram's number is that of the n-gram without its last word, and that word's: exact
    for any number of words.
    """
    text = text._replace(data=_FOLD[text.data])
    words = A.words(text, _PARTS)
    n = len(words.starts)
    coded = strings(text, words).dictionary_encode()
    which, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    first = np.zeros(len(coded.dictionary), np.int64)
    first[which[::-1]] = np.arange(n)[::-1]
    hashes = A.range_hashes(A.prefix_sums(text.data, False), words.starts[first], words.ends[first])
    row = words.row()
    # Two words are in one piece when neither a break nor a row's end stands between them.
    piece = np.concatenate([[0], np.cumsum(_ENDS[text.data])])[words.starts] + row
    at, head, sizes = np.arange(n), group[row], []
    groups = spelled = place = None
    for k in range(1, longest + 1):
        if k > 1:
            inside = at + k - 1 < n
            inside[inside] = piece[at[inside]] == piece[at[inside] + k - 1]
            at, head = at[inside], place[inside]
        found, many, place = ranked(head * size + which[at + k - 1])
        heads, last = np.divmod(found, size)
        groups = heads if k == 1 else groups[heads]
        spelled = last[:, None] if k == 1 else np.concatenate([spelled[heads], last[:, None]], 1)
        sizes.append(Grams(groups, spelled, many))
    return Counted(coded.dictionary, hashes, sizes)


def gram_hashes(counted: Counted, grams: Grams, seeds: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, each in its group. They choose what is counted, no more."""
    out = seeds[grams.group]
    for k in range(grams.words.shape[1]):
        out = A.mix(out * A._BASE + counted.hashes[grams.words[:, k]])
    return out


def seeds_of(groups: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") for g in groups], np.uint64)


def reduced(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


class Summary:
    """A Misra-Gries summary of weighted keys; two of them merge by adding their counts.

    When it holds more than ``capacity`` keys, the count of the first one too many is taken
    from all, and those left with nothing go: a mass of more than ``capacity`` times that
    count disappears, so all that is ever taken from a key is less than mass / capacity.
    ``taken`` adds it up. A take that would reach ``threshold`` isn't made: the mass is more
    than was thought, and the capacity grows instead.
    """

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken = max(1, capacity), threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = reduced(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        while len(self.keys) > self.capacity:
            take = int(-np.partition(-self.counts, self.capacity)[self.capacity])
            if self.taken + take >= self.threshold:
                self.capacity *= 2
                continue
            self.taken += take
            left = self.counts - take
            stays = left > 0
            self.keys, self.counts = self.keys[stays], left[stays]


def _texts(docs: DataFrame, text: str, group: str, missing: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(group).cast("string"), F.lit(missing)).alias("g"), F.col(text).alias("t"))


def _parts(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Counted, list[str]]]:
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        groups, of = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        for at in range(0, batch.num_rows, ROWS):
            for part in A.chunks(batch.column(1).slice(at, ROWS), CHUNK):
                yield count_grams(part, of[at + part.first : at + part.first + part.rows], longest), groups


def survivors(texts: DataFrame, longest: int, threshold: int) -> DataFrame:
    """First pass: hashes ``h`` of n-grams, all those that occur ``threshold`` times among them."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, many = [], []

        def given() -> pa.RecordBatch:
            k, n = reduced(np.concatenate(keys), np.concatenate(many))
            keys.clear(), many.clear()
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["h", "n"])

        for counted, groups in _parts(batches, longest):
            seeds = seeds_of(groups)
            for grams in counted.sizes:
                keys.append(gram_hashes(counted, grams, seeds))
                many.append(grams.count)
            if sum(map(len, keys)) > HELD:
                keys[:], many[:] = ([x] for x in reduced(np.concatenate(keys), np.concatenate(many)))
                if len(keys[0]) > HELD // 2:
                    yield given()
        if keys:
            yield given()

    size = texts.agg(F.sum(F.octet_length("t")).alias("b")).collect()[0]["b"] or 0
    # A word and what parts it take two bytes at least, five or more as a rule.
    summaries = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), size * longest // 4 // MASS + 1)
    capacity = MASS // threshold + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity, threshold)
        waiting: list[pa.RecordBatch] = []

        def merge() -> None:
            rows = pa.Table.from_batches(waiting)
            waiting.clear()
            summary.add(rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy())

        for batch in batches:
            waiting.append(batch)
            # As many as it holds already, so that all its keys are sorted a few times only.
            if sum(map(len, waiting)) > max(HELD, len(summary.keys)):
                merge()
        if waiting:
            merge()
        # What is taken from an n-gram is known: less cannot have been the threshold.
        stays = summary.counts + summary.taken >= threshold
        yield pa.RecordBatch.from_arrays([pa.array(summary.keys[stays].view(np.int64))], names=["h"])

    return texts.mapInArrow(counts, "h bigint, n bigint").repartition(summaries, "h").mapInArrow(summed, "h bigint")


def _merged(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["g", "phrase", "size"]).aggregate([("n", "sum")]).rename_columns(["g", "phrase", "size", "n"])


def exact_counts(texts: DataFrame, hashes: DataFrame, longest: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Second pass: (g, phrase, size, n) of n-grams with ``threshold`` occurrences, and (g, n) words.

    A bitmap of bounded size tells tasks what survived; what it lets through by chance is
    counted as well, and found to be too rare.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * hashes.count()).bit_length()))
    bitmap = texts.sparkSession.sparkContext.broadcast(bitmap_of(hashes, bits))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.Table] = []
        for counted, groups in _parts(batches, longest):
            seeds, names = seeds_of(groups), pa.array(groups, pa.string())
            for k, grams in enumerate(counted.sizes, 1):
                if k == 1:  # all words, known by an empty phrase
                    total = np.bincount(grams.group, grams.count, len(groups)).astype(np.int64)
                    empty, none = pa.array([""] * len(groups)), np.zeros(len(groups), np.int32)
                    tables.append(pa.table({"g": names, "phrase": empty, "size": none, "n": total}))
                held = np.flatnonzero(wanted(bitmap.value, gram_hashes(counted, grams, seeds)))
                parts = [counted.vocabulary.take(pa.array(grams.words[held, i])) for i in range(k)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())
                size = np.full(len(held), k, np.int32)
                tables.append(pa.table({"g": names.take(pa.array(grams.group[held])), "phrase": phrase, "size": size, "n": grams.count[held]}))
            if sum(map(len, tables)) > PHRASES:
                tables = [_merged(tables)]
                pa.default_memory_pool().release_unused()
                if len(tables[0]) > PHRASES // 2:
                    yield from tables.pop().to_batches(1 << 14)
        if tables:
            yield from _merged(tables).to_batches(1 << 14)

    rows = texts.mapInArrow(counts, "g string, phrase string, size int, n bigint")
    # Words are never empty, so size 0 is the totals'.
    found = stored(rows.groupBy("g", "phrase", "size").agg(F.sum("n").alias("n")).filter((F.col("size") == 0) | (F.col("n") >= threshold)), "phrases")
    return found.filter("size > 0"), found.filter("size = 0").select("g", "n")


def _joined(words: Column, start: Column | int, many: Column | int) -> Column:
    return F.array_join(F.slice(words, start, many), " ")


def collocations(
    docs: DataFrame, longest: int = 3, threshold: int = 10, inside: int = 50, best: int = 2000,
    text: str = "text", group: str = "lang", missing: str = "und",
) -> DataFrame:
    """The best phrases of each group: (``group``, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into
    words ``[^\\x20\\x09]+``. Candidates are phrases of 2 to ``longest`` words of one piece
    that occur ``threshold`` times or more (``a``, overlaps included). Cut after its first k
    words, a phrase has l and r, the occurrences of its two parts, and the score
    floor(1000000 * a * a / (l * r)); the lowest of its cuts counts, of equal ones that with
    the smallest k. A candidate is dropped if a longer one holds its words and has
    ``inside`` percent of its occurrences. ``n`` counts all words of the group. Phrases are
    ranked by score, a (both descending) and their bytes, and the first ``best`` are given.

    Null and empty texts have no words; a null group counts as ``missing``; repeated rows
    count again; ids play no part, and other columns, whatever their names, are not read.
    An empty table gives an empty result. Counts are exact; arithmetic is in decimals, which
    hold it as long as a count is below 10^15.
    """
    if longest < 2 or threshold < 2:
        raise ValueError("phrases have two words, and a summary needs a threshold of two")
    texts = _texts(docs, text, group, missing)
    counts, totals = exact_counts(texts, stored(survivors(texts, longest, threshold), "survivors"), longest, threshold)
    words = F.split("phrase", " ")
    candidates = counts.filter("size > 1").select("g", "phrase", "size", F.col("n").alias("a"), words.alias("w"))
    parts = candidates.filter("size > 2").withColumn("s", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("i", F.explode(F.expr("sequence(1, size - s + 1)")))
    around = parts.select("g", _joined(F.col("w"), F.col("i"), F.col("s")).alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("g", "phrase").agg(F.max("longer").alias("longer"))
    held = candidates.join(around, ["g", "phrase"], "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {int(inside)} * a"))
    cuts = held.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "g", "phrase", "a", "k", _joined(F.col("w"), 1, F.col("k")).alias("left"), _joined(F.col("w"), F.col("k") + 1, F.col("size")).alias("right")
    )
    by = counts.select("g", "phrase", "n")
    scored = cuts.join(by.select("g", F.col("phrase").alias("left"), F.col("n").alias("l")), ["g", "left"])
    scored = scored.join(by.select("g", F.col("phrase").alias("right"), F.col("n").alias("r")), ["g", "right"])
    exact = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    scored = scored.select("g", "phrase", "a", "k", "l", "r", (exact["a"] * exact["a"] * F.lit(1000000)).alias("above"), (exact["l"] * exact["r"]).alias("below"))
    lowest = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut")
    judged = scored.groupBy("g", "phrase", "a").agg(lowest).select("g", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = judged.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))
    final = F.row_number().over(Window.partitionBy("g").orderBy(*order))
    ahead = salted.withColumn("rank", rank).filter(F.col("rank") <= best).withColumn("rank", final).filter(F.col("rank") <= best)
    return ahead.join(totals, "g").select(
        F.col("g").alias(group), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
