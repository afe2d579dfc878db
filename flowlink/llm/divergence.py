"""Source divergence audit by sorted token pointers (operator 13).

Each task builds, over the bytes of an Arrow buffer, one pointer per token: where its word
begins. A multikey quicksort over slices of eight bytes puts the pointers in the order of
their tokens: pointers are sorted by their first slice, those whose slices are equal and
whose tokens go on by the next one, and so on. A run of equal tokens then tells, by the rows
and sources that its pointers lie in, how many documents hold the term and how often each
source does. Spark adds up the runs of all shards; everything after that is exact
arithmetic on counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlink.llm import arrays as A
from flowlink.llm.shared import stored

CHUNK = 1 << 23  # bytes of text sorted at a time
HELD = 1 << 20  # counts a task gathers before it hands them on
SLICE = 8  # bytes compared at a time
TILE, BLOCK = 64, 4096  # sources and terms that one comparison of sources holds

_OTHER = np.ones(256, bool)  # what isn't part of a term
_OTHER[65:91] = _OTHER[97:123] = _OTHER[128:] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def slices(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of tokens as big-endian numbers; past a token's end they are 0."""
    rows = data[at[:, None] + np.arange(SLICE)]
    rows[np.arange(SLICE) >= left[:, None]] = 0
    return rows.view(">u8").ravel().astype(np.uint64)


def sorted_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their tokens' bytes, and the number of each one's run of equals.

    ``data`` has ``SLICE`` bytes more than the tokens; no token holds a byte 0.
    """
    order = np.arange(len(starts))
    begins = np.zeros(len(starts), bool)
    begins[:1] = True
    open_ = np.arange(len(starts))  # places in the order that the next slice has to tell apart
    depth = 0
    while len(open_):
        here = order[open_]
        at = starts[here] + depth
        keys = slices(data, np.minimum(at, len(data) - SLICE), np.maximum(ends[here] - at, 0))
        run = np.cumsum(begins)[open_]
        by = np.argsort(keys) if depth == 0 else np.lexsort((keys, run))
        here, keys = here[by], keys[by]
        order[open_] = here
        new = np.ones(len(open_), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (run[1:] != run[:-1])
        begins[open_] |= new
        depth += SLICE
        # Equal slices are equal tokens unless a token of the run goes on.
        bounds = np.append(np.flatnonzero(new), len(new))
        going = (ends[here] - starts[here]) > depth
        longer = np.add.reduceat(going, bounds[:-1]) > 0
        open_ = open_[np.repeat(longer & (np.diff(bounds) > 1), np.diff(bounds))]
    return order, np.cumsum(begins) - 1


def term_runs(text: A.Text, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, number of the term, group, occurrences, rows) for every term and group of rows."""
    data = np.concatenate([_FOLD[text.data], np.zeros(SLICE, np.uint8)])
    words = A.words(text, _OTHER)
    order, run = sorted_pointers(data, words.starts, words.ends)
    row = words.row()[order]
    rows = max(1, text.rows)
    # Within a run: its pointers row by row, then the rows of one group after another.
    found, many = np.unique(run * rows + row, return_counts=True)
    term, row = np.divmod(found, rows)
    many_groups = int(group.max(initial=0)) + 1
    codes = term * many_groups + group[row]
    by = np.argsort(codes, kind="stable")
    codes, many = codes[by], many[by]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    term, of = np.divmod(codes[at], many_groups)
    occurrences = np.add.reduceat(many, at) if len(at) else many
    first = order[np.flatnonzero(np.diff(run, prepend=-1))]
    offsets = np.ascontiguousarray(np.stack([words.starts[first], words.ends[first]], 1))
    raw = data.tobytes()
    terms = pa.array([raw[a:b].decode() for a, b in offsets.tolist()], pa.string())
    return terms, term, of, occurrences, np.diff(np.append(at, len(codes)))


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, per source."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.col(text).alias("t"))

    def merged(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return out.rename_columns(["lang", "source", "term", "n", "docs"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.Table] = []
        for batch in batches:
            coded = [batch.column(i).dictionary_encode() for i in (0, 1)]
            langs, sources = ([c.dictionary, c.indices.to_numpy().astype(np.int64)] for c in coded)
            width = max(1, len(sources[0]))
            group = langs[1] * width + sources[1]
            for part in A.chunks(batch.column(2), CHUNK):
                terms, term, of, n, held = term_runs(part, group[part.first : part.first + part.rows])
                names = [x.take(pa.array(i)).cast(pa.string()) for x, i in zip((langs[0], sources[0]), np.divmod(of, width))]
                columns = dict(zip(("lang", "source"), names)) | {"term": terms.take(pa.array(term)), "n": n, "docs": held}
                tables.append(pa.table(columns))
                if sum(map(len, tables)) > HELD:
                    tables = [merged(tables)]
                    if len(tables[0]) > HELD // 2:
                        yield from tables.pop().to_batches(1 << 16)
        if tables:
            yield from merged(tables).to_batches(1 << 16)

    rows = texts.mapInArrow(counts, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)), in decimals."""
    above = (count.cast("decimal(18,0)") + 2) * F.lit(1000000000).cast("decimal(10,0)")
    below = total.cast("decimal(18,0)") + kept.cast("decimal(18,0)") * 2
    return F.when(kept > 0, F.call_function("div", above, below) + 1)


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of one block of terms over the pairs of the sources of two tiles.

    ``right`` has every source's share of a term it lacks; ``left`` the shares of those it has.
    """
    lang, _, a, b = (k.as_py() for k in key)
    sources, tile, absent = right["source"].to_pylist(), right["tile"].to_numpy(), right["p0"].to_numpy()
    number = {s: i for i, s in enumerate(sources)}
    coded = left["term"].combine_chunks().dictionary_encode() if left.num_rows else None
    width = len(coded.dictionary) if coded is not None else 0
    shares = np.tile(absent[:, None], (1, width))
    if width:
        shares[[number[s] for s in left["source"].to_pylist()], coded.indices.to_numpy()] = left["p"].to_numpy()
    first, second, value = [], [], []
    for i in range(len(sources)):
        for j in range(i + 1, len(sources)):
            if a == b or tile[i] != tile[j]:
                p, q = shares[i], shares[j]
                low, high = sorted((sources[i], sources[j]), key=str.encode)
                first.append(low), second.append(high)
                value.append(int(((p - q) * (p - q) // (p + q)).sum()))
    n = len(first)
    return pa.table({
        "lang": pa.array([lang] * n, pa.string()), "s": pa.array(first, pa.string()), "t": pa.array(second, pa.string()),
        "value": pa.array(value, pa.int64()), "terms": pa.array([width] * n, pa.int64()),
    })


def audit(docs: DataFrame, least: int = 10, best: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """How far the sources of each language are apart: (lang, source, part, item, value, rank).

    Terms are the matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased; each
    language keeps the V terms that ``least`` of its documents hold. A group, (lang, source)
    or a whole language, with N occurrences of kept terms gives one with ``count`` of them
    the share 1 + floor(10^9 * (count + 2) / (N + 2 * V)); two shares p and q are
    floor((p - q)^2 / (p + q)) apart. Part ``pair``: every other source of the language and
    the sum over all kept terms (0 if V is 0). Part ``term``: the ``best`` kept terms that
    the group has and that stand out in it, its share being greater than the language's.
    Ranks go by value descending, then the item's bytes.

    Null text, lang and source are ''. A group occurs by its rows, be they without any term.
    Ids play no part: repeated rows are documents of their own; other columns, whatever
    their names, are not read. An empty table gives an empty result. All arithmetic is
    exact. Sources are compared tile by tile, so no task holds all sources or all terms; the
    pairs of sources are as many as the result has.
    """
    counts = stored(term_counts(docs, text, lang, source), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("all_n")).filter(F.col("d") >= least).select("lang", "term", "all_n")
    held = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    groups = named.join(held.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
    groups = groups.join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("group_n", F.lit(0)).alias("group_n"), F.coalesce("v", F.lit(0)).alias("v"), "lang_n"
    )
    groups = groups.withColumn("p0", _share(F.lit(0), F.col("group_n"), F.col("v")))
    # How many tiles of sources and blocks of terms a language is cut into.
    cut = groups.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.max("v") / BLOCK)).cast("int").alias("blocks")
    )
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    groups = stored(groups.join(cut, "lang").withColumn("tile", tile), "groups")
    shares = held.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"),
        _share(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q"), "tile", "tiles",
        F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"),
    )
    shares = stored(shares, "shares")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    shape = ["lang", "source", "part", "item", "value", rank.alias("rank")]
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    terms = above.select(*shape).filter(F.col("rank") <= best)

    def paired(df: DataFrame) -> DataFrame:
        other = df.withColumn("_other", F.explode(F.expr("sequence(0, tiles - 1)")))
        return other.withColumn("a", F.least("tile", "_other")).withColumn("b", F.greatest("tile", "_other"))

    keys = ["lang", "block", "a", "b"]
    left = paired(shares).select(*keys, "source", "term", "p")
    right = paired(groups.filter("v > 0").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))).select(*keys, "source", "tile", "p0")
    schema = "lang string, s string, t string, value bigint, terms bigint"
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pair_sums, schema)
    sums = sums.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    # Terms that neither of two tiles has are as many as the rest.
    one = groups.select("lang", F.col("source").alias("s"), F.col("p0").alias("p"), "v")
    two = groups.select("lang", F.col("source").alias("t"), F.col("p0").alias("q"))
    rest = (F.col("v") - F.coalesce("terms", F.lit(0))) * _apart(F.col("p"), F.col("q"))
    whole = F.coalesce(F.coalesce("value", F.lit(0)) + rest, F.lit(0))
    pairs = one.join(two, "lang").filter("s < t").join(sums, ["lang", "s", "t"], "left").select("lang", "s", "t", whole.alias("value"))
    there = pairs.select("lang", F.col("s").alias("source"), F.lit("pair").alias("part"), F.col("t").alias("item"), "value")
    back = pairs.select("lang", F.col("t").alias("source"), F.lit("pair").alias("part"), F.col("s").alias("item"), "value")
    return there.unionByName(back).select(*shape).unionByName(terms)
