"""N-gram Jaccard join (operator 4): a size-aware heavy-light join of shingle sets.

Two sets that link share so many shingles that the first few of each, in any common order,
must have some in common: at least one among the first ``n - o + 1`` and at least two among
the first ``n - o + 2``, where ``o`` is the least overlap a set of size ``n`` can link with.
Shingles are ordered by a sketch of how common they are, rarest first.

- *Small* sets enumerate the subsets of two of their prefix; linked small sets share one.
- *Large* sets scan the inverted lists of their prefix shingles, in which the small sets
  just below the boundary are entered too.

The boundary is where subsets of small sets and scans of large ones move the least rows
together, counted over all sets. Equal sets are one set; a key (a subset or a shingle) with
a very long list, as groups of copies make them, is not expanded into pairs: the sets that
such keys connect are compared in blocks, by matrix products (``pairing``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlink.llm import arrays as A
from flowlink.llm.pairing import Fits, dense_links, resolve, sizes_fit
from flowlink.llm.shared import bitmap_of, stored, wanted

WORDS = 3
PERCENT = 90
SKETCH_BITS = 20  # counters of the commonness sketch: 4 MB, whatever the corpus
WINDOW = 1 << 21  # shingles looked at together for the sketch
PROFILE_BITS = 6  # of the hash ranges whose shingles are counted
STEPS = 3  # size classes are so many times as wide as linked sizes can be apart
LARGEST = 32  # sets of a key that are compared by a join where components remain; more are by blocks
LARGEST_SMALL = 512  # sizes up to which subsets are ever considered


def least_overlap(n: Column | np.ndarray | int, percent: int):
    """Shingles that a set of ``n`` shares with any set it links with."""
    if isinstance(n, Column):
        return F.ceil(n * percent / 100).cast("int")
    return -(-n * percent // 100)


def distinct_shingles(text: A.Text, k: int) -> Iterator[np.ndarray]:
    """Per row, its sorted distinct shingle hashes."""
    spans = A.words(text)
    for row in A.shingles(A.hashes(text, spans), spans.bounds, k):
        yield np.unique(row)


def sketch_of(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles of each hash range are met again, roughly: any order is a right one.

    Within runs of documents, shingles of two or more of them are counted; the counters of
    all runs are added up. Shingles that a great many documents have stand out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        held, size = [], 0

        def add() -> None:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            again = n > 1
            np.add.at(total, (found[again] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), n[again])

        for batch in batches:
            for text in A.chunks(batch.column(0)):
                for row in distinct_shingles(text, k):
                    held.append(row)
                    size += len(row)
                if size > WINDOW:
                    add()
                    held, size = [], 0
        if held:
            add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    rows = docs.select("text").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    out[rows["at"].to_numpy()] = np.minimum(rows["n"].to_numpy(), 2**31 - 1)
    return out


def describe(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, profile, prefix, met): a row per document.

    The set's size, a 128-bit name of it, how many of its shingles fall into each of some
    hash ranges, its prefix, and which share of that is common.

    Sets that can link with equal ones only have no prefix.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(sketch_of(docs, k))
    alone = percent // (100 - percent) if percent < 100 else 1 << 62
    alone += percent % (100 - percent) > 0 if percent < 100 else 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sketch.value
        for batch in batches:
            for text in A.chunks(batch.column(1)):
                sizes, first, second, shares, prefixes, profiles = [], [], [], [], [], []
                for row in distinct_shingles(text, k):
                    n = len(row)
                    sizes.append(n)
                    profiles.append(np.minimum(np.bincount((row >> np.uint64(64 - PROFILE_BITS)).astype(np.int64), minlength=1 << PROFILE_BITS), 32767))
                    first.append(int(A.mix(row).sum(dtype=np.uint64)) if n else 0)
                    second.append(int(A.mix(row ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) if n else 0)
                    if n < alone:
                        prefixes.append(row[:0])
                        shares.append(0.0)
                        continue
                    met = common[(row >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    head = np.argsort(met, kind="stable")[: n - least_overlap(n, percent) + 2]
                    prefixes.append(row[head])
                    shares.append(float((met[head] > 0).mean()))
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(text.first, text.rows), pa.array(sizes, pa.int32()),
                        pa.array(np.array(first, np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, (len(sizes) + 1) << PROFILE_BITS, 1 << PROFILE_BITS, dtype=np.int32)),
                            pa.array(np.concatenate(profiles).astype(np.int16)),
                        ),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(prefixes).view(np.int64))),
                        pa.array(shares, pa.float64()),
                    ],
                    names=["doc_id", "n", "h1", "h2", "profile", "prefix", "met"],
                )

    schema = "doc_id bigint, n int, h1 bigint, h2 bigint, profile array<smallint>, prefix array<bigint>, met double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def boundary(sets: DataFrame, percent: int) -> int:
    """The largest small size: up to it subsets and beyond it scans move the least rows.

    A set has a row for each subset, or for each prefix shingle; and where those are met by
    others' (a shingle by its share of common ones, a subset by that share squared) it is
    itself moved to be compared, its size counting as rows. Sums per size, over all sets.
    """
    size, n, met = F.size("prefix"), F.col("n"), F.col("met")
    subsets, scan = size * (size - 1) / 2 + n * met * met, size - 1 + n * met
    costs = (
        sets.filter((size > 0) & (n <= LARGEST_SMALL)).groupBy("n").agg(F.sum(subsets).alias("subsets"), F.sum(scan).alias("scan"))
        .orderBy("n").collect()
    )
    best, here, at = 0.0, 0.0, 0
    for r in costs:
        here += r["subsets"] - r["scan"]
        if here < best:
            best, at = here, r["n"]
    return at


def keyed(sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """(key, id, n): the subsets of small sets, and the list entries of large and nearly large ones."""
    n = F.col("n")
    pairs = least_overlap(n, percent) >= 2
    small = sets.filter(pairs & (n <= limit))
    subsets = small.select(
        F.col("doc_id").alias("id"), "n", F.posexplode("prefix").alias("i", "a"), "prefix"
    ).select("id", "n", "a", F.explode(F.slice("prefix", F.col("i") + 2, F.size("prefix"))).alias("b"))
    least, most = F.least("a", "b"), F.greatest("a", "b")
    by_subset = subsets.select(F.struct(least.alias("a"), most.alias("b")).alias("key"), "id", "n")
    listed = sets.filter(~pairs | (n >= -(-(limit + 1) * percent // 100)))
    by_list = listed.select(F.explode(F.slice("prefix", F.lit(1), n - least_overlap(n, percent) + 1)).alias("a"), F.col("doc_id").alias("id"), "n")
    by_list = by_list.select(F.struct("a", F.lit(0).cast("bigint").alias("b")).alias("key"), "id", "n")
    # Sets link only if their sizes are close: keys of other size classes never meet. A set
    # that may link with one of the next class is entered there too.
    wide = STEPS * float(np.log(100 / percent)) if percent < 100 else 1e-9
    own, last = F.floor(F.log("n") / wide), F.floor(F.log(n * 100 / percent) / wide)
    classes = F.array_distinct(F.array(own, last))
    every = by_subset.unionByName(by_list).select("key", "id", "n", F.explode(classes).alias("class"))
    return every.select(F.xxhash64("key.a", "key.b", "class").alias("key"), "id", "n")


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, tokens) of the documents whose ids are given; by chance of a few others too.

    A bitmap of fixed size tells which texts to look at, so none has to be shuffled.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.select(F.xxhash64("id").alias("h"))))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = pa.array(wanted(bitmap.value, batch.column(2).to_numpy().view(np.uint64)))
            found, texts = batch.column(0).filter(asked), batch.column(1).filter(asked)
            for text in A.chunks(texts):
                rows = list(distinct_shingles(text, k))
                bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.concatenate(rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [found.slice(text.first, text.rows), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=["id", "tokens"]
                )

    named = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    return named.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(tokens, "id bigint, tokens array<bigint>")


def profiles_fit(percent: int) -> Fits:
    """Whether two sides' profiles differ by no more than linked sets of their sizes do."""

    def fits(a: str, b: str) -> Column:
        gaps = F.zip_with(f"{a}.detail", f"{b}.detail", lambda x, y: F.abs(x - y))
        apart = F.aggregate(gaps, F.lit(0), lambda total, x: total + x)
        return (100 + percent) * apart <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))

    return fits


def linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets truly link.

    Where sets link, their profiles differ by no more than the sets do: that leaves few
    pairs that don't link, and only those left are compared shingle by shingle.
    """
    known = sets.filter(F.size("prefix") > 0).select("doc_id", "n", "profile")
    left = known.select(F.col("doc_id").alias("u"), F.col("n"), F.col("profile").alias("detail")).alias("l")
    right = known.select(F.col("doc_id").alias("v"), F.col("n"), F.col("profile").alias("detail")).alias("r")
    close = pairs.join(left, "u").join(right, "v").filter(profiles_fit(percent)("l", "r"))
    close = stored(close.select("u", "v").distinct(), "jaccard-close")
    ids = close.select(F.explode(F.array("u", "v")).alias("id"))
    tokens = stored(shingle_sets(docs, ids, k), "jaccard-tokens")
    a = tokens.select(F.col("id").alias("u"), F.col("tokens").alias("a"))
    b = tokens.select(F.col("id").alias("v"), F.col("tokens").alias("b"))
    both = close.join(a, "u").join(b, "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v")


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of a column of shingle sets."""
    many = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), many), column.flatten().to_numpy()


def link_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their ``k``-word
    shingle sets (a text of fewer words is one shingle; A-Z lower-cased). ``component_id``
    is the lowest ``doc_id`` reachable by links. Null and wordless texts have no shingles
    and link with nothing, so each is its own component. Rows that share a ``doc_id`` are
    one document as far as links go. A row with a null ``doc_id`` comes back with a null
    component and takes no part. Other columns are not looked at; an empty table gives an
    empty one. Shingles are 64-bit hashes; set overlaps are counted exactly.
    """
    sets = stored(describe(docs, k, percent), "jaccard-sets")
    names = ["n", "h1", "h2"]
    equal = stored(
        sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy(*names).agg(F.min("doc_id").alias("first")), "jaccard-equal"
    )
    firsts = sets.filter(F.size("prefix") > 0).join(
        equal.select(F.col("first").alias("doc_id"), "n"), ["doc_id", "n"], "left_semi"
    )

    entries = keyed(firsts, boundary(sets, percent), percent)
    details = firsts.select(F.col("doc_id").alias("id"), F.col("profile").alias("detail")).dropDuplicates(["id"])

    def dense(families: DataFrame) -> DataFrame:
        tokens = shingle_sets(docs, families.select("id"), k).distinct()
        content = tokens.select("id", F.col("tokens").alias("content"), F.size("tokens").alias("weight"))
        return dense_links(families.select("id", "component", "family", F.lit(0).alias("n")).distinct().join(content, "id"), tokens_of, percent)

    whole = resolve(
        entries, lambda _: lambda pairs: linked(pairs, sets, docs, k, percent), sizes_fit(percent), "jaccard",
        LARGEST, details=details, near=profiles_fit(percent), dense=dense,
    )
    rows = sets.alias("s").join(equal.alias("e"), [F.col(f"s.{c}") == F.col(f"e.{c}") for c in names], "left").select(
        "s.doc_id", "s.n", "e.first"
    )
    out = rows.join(whole, F.col("first") == F.col("node"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the lowest ``doc_id``.

    Rows with a null ``doc_id`` stay; every column stays as it is.
    """
    gone = link_components(docs, k, percent).filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
