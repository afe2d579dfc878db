"""Components of things that share keys, without expanding a key into all its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlink.llm.components import components
from flowlink.llm.shared import bitmap_of, filter_bits, stored, wanted

Check = Callable[[DataFrame], DataFrame]
Fits = Callable[[str, str], Column]

CHUNK = 1 << 10  # things on one side of a block whose sets are compared by a matrix product
WEIGHT = 1 << 20  # elements of their sets, roughly
WIDE, ACROSS = 1 << 12, 1 << 9  # elements and columns of a product


def sizes_fit(percent: int) -> Fits:
    """Whether sets of these sizes can have that Jaccard similarity at all."""
    return lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _lowest(entries: DataFrame) -> DataFrame:
    """(key, low) of the keys that several ids share."""
    return entries.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("key", "low")


def _held(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """The entries whose keys are listed, and by chance a few others: a bitmap of bounded size tells."""
    bitmap = entries.sparkSession.sparkContext.broadcast(bitmap_of(lists.select(F.col("key").alias("h")), filter_bits(lists.count())))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted(bitmap.value, batch.column(0).to_numpy().view(np.uint64))))

    return entries.mapInArrow(rows, entries.schema)


def forest(
    row: np.ndarray, hashed: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int,
    close: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> list[tuple[int, int]]:
    """Pairs of a thing on the left and one on the right that link, enough to join what links joins.

    (row, hashed) are the distinct elements of the things' sets. Overlaps are counted by matrix
    products, for pairs in different components only: what a link joins is compared no more.
    """
    size = np.bincount(row, minlength=len(component))
    _, token, times = np.unique(hashed, return_inverse=True, return_counts=True)
    met = times > 1
    row, token = row[met[token]], (np.cumsum(met) - 1)[token[met[token]]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    cuts = np.searchsorted(token, np.arange(0, int(met.sum()) + WIDE, WIDE))
    _, of = np.unique(component, return_inverse=True)
    right = right[np.argsort(of[right], kind="stable")]
    out = []
    for at in range(0, len(right), ACROSS):
        across = right[at : at + ACROSS]
        down = left if (of[across] != of[across[0]]).any() else left[of[left] != of[across[0]]]
        if not len(down):
            continue
        common = np.zeros((len(down), len(across)), np.float32)
        for i, (a, b) in enumerate(pairwise(cuts)):
            held = np.zeros((len(component), WIDE), np.float32)
            held[row[a:b], token[a:b] - i * WIDE] = 1
            common += held[down] @ held[across].T
        shared = common.astype(np.int64)
        linked = (shared > 0) & (100 * shared >= percent * (size[down][:, None] + size[across] - shared))
        linked &= of[down][:, None] != of[across]
        if close is not None:
            linked &= close(down[:, None], across)
        x, y = np.nonzero(linked)
        x, y = down[x], across[y]
        _, first = np.unique(of[x] * len(of) + of[y], return_index=True)
        for u, v in zip(x[first].tolist(), y[first].tolist()):
            if of[u] != of[v]:
                out.append((u, v))
                of[of == of[u]] = of[v]
    return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block (the first column), which come one after the other."""
    held = []
    for batch in batches:
        block = batch.column(0).to_numpy()
        for a, b in pairwise([0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]):
            if held and a < b and held[-1].column(0)[0].as_py() != block[a]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def dense_links(
    members: DataFrame, elements: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], percent: int,
    close: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(u, v) that join the things of a family whose sets have that Jaccard similarity.

    ``members`` is (id, n, component, family, content, weight); ``elements`` gives the (row,
    element) of the contents' sets, each once, and ``close`` tells from the ``n`` of two
    things whether they may link. A family is dealt in chunks, and every two chunks are a
    block of bounded size: all its things meet, but no task holds a whole family, and no
    more rows leave than there are things.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("weight") / WEIGHT), F.lit(1))
    dealt = members.join(members.groupBy("family").agg(most.cast("int").alias("chunks")), "family")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id", "content"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other"))
    each = dealt.select(
        block.alias("block"), "id", "n", "component", (F.col("own") <= F.col("other")).alias("left"),
        (F.col("own") >= F.col("other")).alias("right"), "content",
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_block(batches):
            ids, n, component, left, right = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            row, element = elements(batch.column(6))
            near = None if close is None else lambda a, b, n=n: close(n[a], n[b])
            found = forest(row, element, component, np.flatnonzero(left), np.flatnonzero(right), percent, near)
            u, v = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64())], names=["u", "v"])

    return each.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(rows, "u bigint, v bigint")


def resolve(
    entries: DataFrame, prepare: Callable[[DataFrame], Check], fits: Fits, name: str, largest: int | None = None,
    details: DataFrame | None = None, near: Fits | None = None, held: Callable[[DataFrame], DataFrame] | None = None,
    split: Callable[[DataFrame], DataFrame] | None = None, dense: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, component) of the ids that some verified link touches.

    ``entries`` is (key, id, n): things that share a key may link if what is known of them,
    ``n``, fits. ``prepare`` gets the ids (id) that may take part and returns what verifies
    pairs (u, v) of them, giving back those that link.

    First each thing is compared with the lowest of each of its keys: as many pairs as
    entries, and enough to join groups of copies. Then things of one key that are in
    different components still are compared, all of them; inside a component no link is
    needed. So no link between components is missed, and a key that one group of copies
    fills costs its length, not its square.

    ``details`` (id, detail), one row per id, and ``near`` may tell more closely which things
    of one key can link; only those leave the join that compares a key's things.

    ``held`` may give the entries of listed keys (key) more directly than from ``entries``,
    which then need no ``n``.

    ``largest`` is the number of things in a key up to which its things are compared by a
    join. Those of longer keys form families, the things that such keys connect; ``dense``
    compares all things of a family, given as (id, n, component, family), and gives back
    links (u, v) that join them.

    Where keys are a hash's chance meetings, things of long keys get further keys (key, id)
    from ``split``, given their ids (id): any two that link share one of those, so comparing
    what shares one and is of two families misses no link.
    """
    # Most keys have one id only; they go before anything is kept, most of them unshuffled.
    lists = stored(_lowest(entries), f"{name}-lists")
    found = _held(entries.select("key", "id", "n"), lists) if held is None else held(lists)
    shared = stored(found.join(lists, "key").distinct(), f"{name}-entries")
    known = stored(shared.select("id", "n").distinct(), f"{name}-known")
    check = prepare(known.select("id").distinct())

    def starred(members: DataFrame) -> DataFrame:
        """(u, v): members and the lowest of their key, where that fits."""
        pairs = members.filter("id <> low").select("id", "n", "low").distinct()
        lows = known.select(F.col("id").alias("low"), F.col("n").alias("low_n"))
        return pairs.join(lows, "low").filter(fits("n", "low_n")).select(F.col("id").alias("u"), F.col("low").alias("v")).distinct()

    done = stored(starred(shared), f"{name}-stars")
    links = stored(check(done), f"{name}-links")
    groups = stored(components(links), f"{name}-groups")
    of = groups.select(F.col("node").alias("id"), "component")
    placed = stored(
        shared.join(of, "id", "left").withColumn("component", F.coalesce("component", "id")), f"{name}-placed"
    )
    mixed = stored(
        placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("many"))
        .filter("a <> b").select("key", "many"),
        f"{name}-mixed",
    )
    short = mixed if largest is None else mixed.filter(F.col("many") <= largest)
    undecided = placed.join(short.select("key"), "key", "left_semi")
    if details is not None:
        undecided = undecided.join(details, "id")
    undecided = stored(undecided, f"{name}-undecided")
    apart = (F.col("l.key") == F.col("r.key")) & (F.col("l.component") < F.col("r.component")) & fits("l.n", "r.n")

    def crossed(members: DataFrame, close: Column) -> DataFrame:
        """(u, v): members of one key in different components, where that fits."""
        return members.alias("l").join(members.alias("r"), close).select(
            F.greatest("l.id", "r.id").alias("u"), F.least("l.id", "r.id").alias("v")
        )

    rest, fresh = crossed(undecided, apart if near is None else apart & near("l", "r")).distinct(), None
    if largest is not None:
        # A key's things hang together by its lowest: no pairs are needed to find families.
        long = stored(placed.join(mixed.filter(F.col("many") > largest).select("key"), "key", "left_semi"), f"{name}-long")
        families = components(long.select(F.col("id").alias("u"), F.col("low").alias("v"))).toDF("id", "family")
        families = stored(long.select("id", "n", "component").distinct().join(families, "id"), f"{name}-families")
        fresh = stored(dense(families), f"{name}-dense")
    if split is not None:
        finer = stored(split(families.select("id")).join(families, "id"), f"{name}-finer")
        several = finer.groupBy("key").agg(F.min("family").alias("a"), F.max("family").alias("b")).filter("a <> b").select("key")
        finer = stored(finer.join(several, "key", "left_semi"), f"{name}-finer-mixed")
        rest = rest.unionByName(crossed(finer, apart & (F.col("l.family") != F.col("r.family")))).distinct()
    rest = rest.join(done, ["u", "v"], "left_anti")  # a star's centre is its lower end
    more = stored(check(rest), f"{name}-more")
    fresh = more if fresh is None else fresh.unionByName(more)
    # What is joined already counts as one: few edges are left.
    at_u, at_v = (of.select(F.col("id").alias(c), F.col("component").alias(f"at_{c}")) for c in "uv")
    edges = fresh.join(at_u, "u", "left").join(at_v, "v", "left").select(F.coalesce("at_u", "u").alias("u"), F.coalesce("at_v", "v").alias("v"))
    roots = stored(components(edges), f"{name}-roots").select(F.col("node").alias("was"), F.col("component").alias("root"))
    placed_anew = groups.join(roots, F.col("component") == F.col("was"), "left").select("node", F.coalesce("root", "component").alias("component"))
    alone = roots.join(groups, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("root").alias("component"))
    return stored(placed_anew.unionByName(alone), f"{name}-whole")
