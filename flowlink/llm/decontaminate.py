"""Benchmark decontamination (operator 10): a prefix-filtered join on word windows.

A document is contaminated by whole windows of a benchmark item. Every window has all its
shingles (pairs of neighbouring words) to be found, so the rarest one, by its count over all
documents, is a prefix that no occurrence can lack. Documents are joined on those shingles
only; where one is met, its offset in the window says where the window would begin, length
and position rule out what doesn't fit, and the words themselves are compared. DataFrame
functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlink.llm.shared import stored

WINDOW = 13
BLOCK = 50_000  # rows of benchmark windows or shingles that are broadcast at once, at most

PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    # lower() is far quicker but changes other letters too: only where there are none.
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(plain, PARTS), ""), F.array().cast("array<string>"))


def _shingles(words: Column) -> Column:
    """Each word with the next one; the last word's next is null."""
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("b"))


def _token(pair: Column) -> Column:
    return F.when(pair["b"].isNotNull(), F.xxhash64(pair["a"], pair["b"]))


def item_windows(items: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(item_id, words) of every window; an item of fewer words, but not none, is one window."""
    listed = items.select("item_id", word_list(F.col(text)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return listed.select("item_id", "all", F.explode(starts).alias("at")).select(
        "item_id", F.expr(f"slice(all, at, {int(window)})").alias("words")
    ).distinct()


def _blocks(df: DataFrame, key: str, rows: int, most: int) -> list[DataFrame]:
    """A table in parts of about ``most`` rows by a hash of a key, each small enough to broadcast."""
    n = max(1, -(-rows // most))
    if n == 1:
        return [df]
    return [df.filter(F.pmod(F.xxhash64(F.lit(n), key), F.lit(n)) == i) for i in range(n)]


def _exploded(docs: DataFrame, text: str, single: bool) -> DataFrame:
    """(doc_id, fp, words, pos, token): one row per word of each document, one without words.

    The words stay beside each position; Spark's generated code copies them only into rows
    that the join behind it lets pass.
    """
    listed = docs.select("doc_id", F.xxhash64(F.col(text)).alias("fp"), word_list(F.col(text)).alias("words"))
    rows = listed.select("doc_id", "fp", "words", F.posexplode_outer(_shingles(F.col("words"))).alias("pos", "pair"))
    pair = _token(F.col("pair"))
    found = rows.select("doc_id", "fp", "words", F.coalesce("pos", F.lit(0)).alias("pos"), pair.alias("token"))
    if not single:
        return found
    alone = rows.filter(F.col("pair").isNotNull()).select(
        "doc_id", "fp", "words", F.col("pos"), F.xxhash64(F.col("pair")["a"]).alias("token")
    )
    return found.unionByName(alone.withColumn("pos", F.col("pos") + (1 << 30)))


def prefix_windows(docs: DataFrame, items: DataFrame, window: int, text: str, block: int) -> tuple[DataFrame, DataFrame, bool]:
    """Distinct windows with their rarest shingle and its offset; which items hold them.

    Windows with a shingle that no document has can't occur and go. The flag says whether
    there are windows of a single word, whose shingle is that word.
    """
    every = stored(item_windows(items, window), "benchmark-windows")
    alone = F.transform(F.filter("words", lambda w: F.size("words") == 1), lambda w: F.xxhash64(w))
    pairs = F.transform(F.filter(_shingles(F.col("words")), lambda p: p["b"].isNotNull()), _token)
    unlike = every.select("words").distinct().withColumn("tokens", F.concat(pairs, alone))
    vocabulary = stored(unlike.select(F.explode("tokens").alias("token")).distinct(), "benchmark-shingles")
    single = not every.filter(F.size("words") == 1).isEmpty()
    met = [
        _exploded(docs, text, single).select("token").join(F.broadcast(part), "token")
        for part in _blocks(vocabulary, "token", vocabulary.count(), block)
    ]
    counts = reduce(DataFrame.unionByName, met).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    placed = unlike.select("words", F.size("tokens").alias("size"), F.posexplode("tokens").alias("offset", "token"))
    rarest = placed.join(counts, "token").groupBy("words", "size").agg(
        F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "token", "offset")).alias("best")
    )
    prefix = rarest.filter(F.col("known") == F.col("size")).select(
        F.col("best.token").alias("token"), F.col("best.offset").alias("offset"), "words", F.xxhash64("words").alias("wid")
    )
    return stored(prefix, "benchmark-prefixes"), every, single


def occurrences(docs: DataFrame, prefix: DataFrame, single: bool, text: str, block: int) -> DataFrame:
    """(doc_id, fp, n_words, start, window): a row per occurrence, and one without per document row."""
    named = prefix.withColumnRenamed("words", "window")
    parts = []
    for i, part in enumerate(_blocks(named, "token", named.count(), block)):
        rows = _exploded(docs, text, single).join(F.broadcast(part), "token", "left")
        first = (F.col("pos") == 0) if i == 0 else F.lit(False)
        start = F.col("pos") % (1 << 30) - F.col("offset")
        fits = (start >= 0) & (start + F.size("window") <= F.size("words"))
        same = F.when(fits, F.slice("words", F.when(fits, start + 1).otherwise(1), F.size("window")) == F.col("window"))
        hit = F.coalesce(same, F.lit(False))
        # A position that several windows share is one document row still: only one counts it.
        parts.append(
            rows.select(
                "doc_id", "fp", F.size("words").cast("long").alias("n_words"), hit.alias("hit"), first.alias("first"),
                F.when(hit, start).alias("start"), F.when(hit, F.col("window")).alias("window"),
            ).filter(F.col("hit") | F.col("first"))
        )
    return reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per (doc_id, text): doc_id, fp, n_words, n_hit, items (sorted as strings).

    ``n_hit`` counts the document's words inside any occurrence of any window of an item.
    Null and wordless texts have no words and no hits; a null ``doc_id`` is an id like any
    other; items without words match nothing. Repeated rows are one row here, ``fp`` being
    a hash of the text; other columns are not looked at. An empty table gives an empty one.
    """
    prefix, every, single = prefix_windows(docs, items, window, text, block)
    found = stored(occurrences(docs, prefix, single, text, block), "benchmark-occurrences")
    key = ["doc_id", "fp"]
    met = found.filter("hit")
    unlike = met.select(*key, "n_words", "start", F.size("window").alias("size")).distinct()
    before = Window.partitionBy(*key).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    gained = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    covered = unlike.select(*key, gained.alias("gained")).groupBy(*key).agg(F.sum("gained").alias("n_hit"))
    held = (
        met.select(*key, "window").distinct().join(every.withColumnRenamed("words", "window"), "window")
        .groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    rows = found.groupBy(*key).agg(F.max("n_words").alias("n_words"))

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.fp").eqNullSafe(F.col(f"{b}.fp"))

    joined = rows.alias("r").join(covered.alias("c"), same("r", "c"), "left").join(held.alias("h"), same("r", "h"), "left")
    return joined.select(
        "r.doc_id", "r.fp", "r.n_words", F.coalesce("c.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("h.items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated() -> Column:
    """The rule: a hit, and at least one word in twenty hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; every column and every repeated row stays."""
    bad = contamination(docs, items, window, text).filter(contaminated()).select("doc_id", "fp")
    left, right = docs.alias("l"), bad.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.xxhash64(F.col(f"l.{text}")).eqNullSafe(F.col("r.fp"))
    return left.join(right, same, "left_anti")
