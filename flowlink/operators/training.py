"""Training the match model on linked records, and judging it on masters held out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlink.operators import matching as M
from flowlink.operators.linking import link_digest
from flowlink.session import stored

RECORDS_PER_MASTER = 50
MAX_NON_MATCHING = 200_000
STRENGTH = 20.0
HOLDOUT = 0.3
THRESHOLD = 0.95
# Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619


def fnv1a_32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as a non-negative bigint."""
    digits = F.hex(F.encode(text, "UTF-8"))
    count = F.length(digits) / 2
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    return F.aggregate(
        places,
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)) % F.lit(1 << 32),
    )


def held_out(master: Column, share: float = HOLDOUT) -> Column:
    """Whether a master is kept out of training."""
    return (fnv1a_32(master) % 1000).cast("double") < F.lit(share * 1000)


def _side(df: DataFrame, p: str) -> list[Column]:
    return [F.col(c).alias(p + c) for c in M.ATTRIBUTES]


def usable(records: DataFrame, per_master: int = RECORDS_PER_MASTER) -> DataFrame:
    """Records with attributes, the first ``per_master`` of each master, numbered in it."""
    order = Window.partitionBy("master_id").orderBy("source_id")
    return records.filter(M.comparable()).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_master)


def matching_pairs(records: DataFrame) -> DataFrame:
    """All pairs within each master, from the output of ``usable``."""
    a = records.select("master_id", F.col("_n").alias("_i"), F.col("source_id").alias("a_id"), *_side(records, "a_"))
    b = records.select("master_id", F.col("_n").alias("_j"), F.col("source_id").alias("b_id"), *_side(records, "b_"))
    return a.join(b, "master_id").filter(F.col("_i") < F.col("_j")).drop("_i", "_j", "master_id")


def non_matching_pairs(records: DataFrame, most: int = MAX_NON_MATCHING, seed: int = 1) -> DataFrame:
    """Pairs of different masters: all of them where there are few, else a fixed sample.

    A pair is a number; its two records are looked up by index, so no records are crossed.
    The index covers the records the sample can use, at most a little more than ``most``.
    """
    spark = records.sparkSession
    n = records.count()
    total = n * (n - 1) // 2
    pool = records
    if total > most and n > most:
        share = min(1.0, 1.2 * most / n)
        pool = records.filter(F.pmod(F.xxhash64("master_id", "source_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # The pool is bounded by the sample's size, so one task may number it.
    numbered = pool.withColumn("_index", F.row_number().over(Window.orderBy("master_id", "source_id")) - 1)
    if total <= most:
        k = spark.range(max(total, 0)).withColumnRenamed("id", "k")
        i = F.floor((F.lit(1) + F.sqrt(F.lit(1) + F.col("k") * 8)) / 2).cast("int")
        drawn = k.withColumn("_i", i).withColumn("_j", (F.col("k") - F.col("_i") * (F.col("_i") - 1) / 2).cast("int"))
    else:
        size = pool.count() if pool is not records else n
        draw = lambda salt: F.pmod(F.xxhash64("k", F.lit(seed), F.lit(salt)), F.lit(size)).cast("int")
        drawn = spark.range(most).withColumnRenamed("id", "k").withColumns({"_i": draw(1), "_j": draw(2)})
    a = numbered.select(F.col("_index").alias("_i"), F.col("master_id").alias("a_master"), F.col("source_id").alias("a_id"), *_side(records, "a_"))
    b = numbered.select(F.col("_index").alias("_j"), F.col("master_id").alias("b_master"), F.col("source_id").alias("b_id"), *_side(records, "b_"))
    pairs = drawn.join(a, "_i").join(b, "_j").filter(F.col("a_master") != F.col("b_master"))
    return pairs.drop("_i", "_j", "k", "a_master", "b_master")


def labelled_pairs(records: DataFrame, most: int = MAX_NON_MATCHING, seed: int = 1) -> DataFrame:
    """Matching and non-matching pairs with ``match``."""
    kept = usable(records)
    yes = matching_pairs(kept).withColumn("match", F.lit(True))
    no = non_matching_pairs(kept, most, seed).withColumn("match", F.lit(False))
    return yes.unionByName(no)


def level_counts(pairs: DataFrame) -> DataFrame:
    """Per level: matching and non-matching pairs at it, and pairs its kind compared.

    A level counts each time it occurs, a kind once per pair (two exact fields compare).
    """
    known = pairs.withColumn("_similarity", M.name_similarity())
    levels = M.compare(similarity=F.col("_similarity"))
    return class_level_counts(known.select("match", *[v.alias(k) for k, v in levels.items()], F.lit(1).alias("pairs")))


def class_level_counts(classes: DataFrame) -> DataFrame:
    """``level_counts`` over classes of pairs: (match, email, domain, name, exact, pairs)."""
    listed = F.concat(F.array_compact(F.array("email", "domain", "name")), F.transform("exact", lambda e: e["level"]))
    found = classes.select("match", "pairs", listed.alias("levels")).withColumn(
        "kinds", F.array_distinct(F.transform("levels", lambda l: F.substring_index(l, ".", 1)))
    )

    def counted(column: str, name: str, yes: str, no: str) -> DataFrame:
        rows = found.select("match", "pairs", F.explode(column).alias(name))
        total = lambda which: F.coalesce(F.sum(F.when(which, F.col("pairs"))), F.lit(0)).cast("bigint")
        return rows.groupBy(name).agg(total(F.col("match")).alias(yes), total(~F.col("match")).alias(no))

    by_level = counted("levels", "level", "matching", "non_matching")
    by_kind = counted("kinds", "kind", "kind_matching", "kind_non_matching")
    return by_level.withColumn("kind", F.substring_index("level", ".", 1)).join(by_kind, "kind")


def _clamp(p: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def train(pairs: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """The trained model next to the default one, level by level (nine rows).

    Estimates are drawn towards the default by ``strength`` pairs, so a level seen a few
    times cannot swing to an extreme.
    """
    return _estimated(level_counts(pairs), strength)


def train_all(classes: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """``train`` over classes of pairs (see ``labelled_classes``)."""
    return _estimated(class_level_counts(classes), strength)


def _estimated(counts: DataFrame, strength: float) -> DataFrame:
    default = M.model_table(counts.sparkSession, M.DEFAULT_MODEL).withColumnsRenamed({"m": "default_m", "u": "default_u"})
    kinds = counts.select("kind", "kind_matching", "kind_non_matching").distinct()
    per_level = counts.select("level", "matching", "non_matching")
    joined = default.withColumn("kind", F.substring_index("level", ".", 1)).join(per_level, "level", "left").join(kinds, "kind", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    estimate = lambda count, kind, start: _clamp(
        (n(count) + F.lit(strength) * F.col(start)) / (n(kind) + F.lit(strength))
    )
    return joined.select(
        "level", "default_m", "default_u",
        estimate("matching", "kind_matching", "default_m").alias("m"),
        estimate("non_matching", "kind_non_matching", "default_u").alias("u"),
        n("matching").alias("matching"), n("non_matching").alias("non_matching"),
    )


def evaluate(pairs: DataFrame, model: M.Model, threshold: float = THRESHOLD) -> DataFrame:
    """Precision, recall and false matches of a model on labelled pairs (one row)."""
    scored = M.score_pairs(pairs, model)
    above = F.col("score") >= threshold
    counts = scored.agg(
        F.count_if(above & F.col("match")).alias("tp"),
        F.count_if(above & ~F.col("match")).alias("fp"),
        F.count_if(~above & F.col("match")).alias("fn"),
    )
    return _quality(counts)


def _quality(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(F.lit(0.0))
    return counts.select(
        share(F.col("tp"), F.col("fp")).alias("precision"),
        share(F.col("tp"), F.col("fn")).alias("recall"),
        F.col("fp").alias("false_matches"),
    )


# --- Every pair, counted without being formed -------------------------------------------

MOST_FIELDS = 6  # exact identifiers of an entity; each doubles the ways a pair can agree
COUNT = "decimal(38,0)"


def _agreements(spread: DataFrame, keys: list[str], attributes: list[str], n: str) -> DataFrame:
    """(keys..., s, a values array, mask, n): rows counted by every set ``s`` of attributes they have."""
    present = [i for i, c in enumerate(attributes)]
    values = F.array(*[F.col(c) for c in attributes])
    inside = lambda s: F.transform(values, lambda v, i: F.when(F.shiftright(s, i).bitwiseAND(F.lit(1)) == 1, v))
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << len(present)) - 1)), lambda s: s.bitwiseAND(F.col("mask")) == s)
    rows = spread.select(*keys, "mask", F.explode(sets).alias("s"), values.alias("_v"), F.col(n).alias("_n"))
    named = {c: F.when(F.col("s").bitwiseAND(F.lit(1 << i)) != 0, F.get("_v", F.lit(i))) for i, c in enumerate(attributes)}
    return rows.select(*keys, "s", F.array(*named.values()).alias("a"), "mask", "_n").groupBy(*keys, "s", "a", "mask").agg(F.sum("_n").alias("n"))


def _exactly(met: DataFrame, by: list[str], attributes: int) -> DataFrame:
    """From pairs that agree on ``s`` at least to pairs that agree on ``s`` and nothing else.

    By inclusion and exclusion: a pair that agrees on s counts for each subset of s, with
    the sign of what the subset lacks.
    """
    parts = F.filter(F.sequence(F.lit(0), F.lit((1 << attributes) - 1)), lambda x: x.bitwiseAND(F.col("s")) == x)
    lacks = met.withColumn("x", F.explode(parts))
    sign = F.when(F.bit_count(F.col("s") - F.col("x")) % 2 == 0, F.col("pairs")).otherwise(-F.col("pairs"))
    return lacks.groupBy(*by, F.col("x").alias("s"), "p", "q").agg(F.sum(sign).cast(COUNT).alias("pairs")).filter("pairs <> 0")


def _paired(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(s, p, q, pairs) of rows with equal keys, s and values; a key has few masks, so few rows."""
    held = counts.groupBy(*keys, "s", "a").agg(F.array_sort(F.collect_list(F.struct("mask", F.col("n").cast(COUNT).alias("n")))).alias("m"))
    one = held.select("s", "m", F.posexplode("m").alias("i", "x"))
    two = one.select("s", F.col("i"), F.col("x"), F.posexplode("m").alias("j", "y")).filter("i <= j")
    same = F.col("x.n") * (F.col("x.n") - 1) / 2
    pairs = F.when(F.col("i") == F.col("j"), same.cast(COUNT)).otherwise((F.col("x.n") * F.col("y.n")).cast(COUNT))
    return two.select("s", F.col("x.mask").alias("p"), F.col("y.mask").alias("q"), pairs.alias("pairs")).groupBy("s", "p", "q").agg(F.sum("pairs").cast(COUNT).alias("pairs"))


def pair_classes(records: DataFrame) -> DataFrame:
    """All pairs of records by how they compare: (match, email, domain, name, exact, pairs).

    A pair's levels follow from what both records have, what they agree on, and whether
    unequal names are close. How many pairs agree on a set of attributes is a count per
    value of that set; inclusion and exclusion give how many agree on just that set. Only
    close names are looked up, in an index or chunk by chunk, and then counted by name. No pair of records is
    formed, so no block is too large, no master has too many records and nothing is sampled.
    Without attributes a record isn't compared. Counts are exact (38 digits).
    """
    usable = records.filter(M.comparable())
    fields = sorted(r[0] for r in usable.select(F.explode("exact.field")).distinct().limit(MOST_FIELDS + 1).collect())
    if len(fields) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} exact identifiers are compared")
    attributes = ["email", "domain", "name", *[f"x{i}" for i in range(len(fields))]]
    known = F.map_from_entries("exact")
    spread = usable.select("master_id", "email", "domain", "name", *[F.try_element_at(known, F.lit(f)).alias(f"x{i}") for i, f in enumerate(fields)])
    mask = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(attributes)), F.lit(0))
    spread = stored(spread.groupBy("master_id", *attributes).agg(F.count(F.lit(1)).alias("n")).withColumn("mask", mask), "profiles")
    name_bit = 1 << attributes.index("name")
    others = [c for c in attributes if c != "name"]

    names = spread.filter(F.col("name").isNotNull()).select("name").distinct()
    near = M.close_names(names, names, once=True)
    level = F.when(M.jaro_winkler("a_name", "b_name") >= M.SAME, "name.same").otherwise("name.close")
    near = stored(near.withColumn("level", level), "close-names")

    def classes(keys: list[str]) -> DataFrame:
        """Pairs with equal keys, by (level, s, p, q); the level is that of unequal close names."""
        every = _exactly(_paired(_agreements(spread, keys, attributes, "n"), keys), [], len(attributes))
        by_name = _agreements(spread.filter(F.col("name").isNotNull()).withColumn("name_", F.col("name")).withColumn("name", F.lit(None).cast("string")).withColumn(
            "mask", F.col("mask") - name_bit), [*keys, "name_"], attributes, "n")
        on = [*keys, "s", "a"]
        first = near.join(by_name.withColumnRenamed("name_", "a_name"), "a_name").select(*on, "b_name", "level", F.col("mask").alias("p"), F.col("n").alias("n1"))
        second = by_name.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("name_").alias("_name"), F.col("mask").alias("q"), F.col("n").alias("n2"))
        same = F.col("b_name") == F.col("_name")
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        both = first.join(second, same).select(
            "level", "s", (F.least("p", "q") + name_bit).alias("p"), (F.greatest("p", "q") + name_bit).alias("q"), (F.col("n1").cast(COUNT) * F.col("n2")).cast(COUNT).alias("pairs")
        )
        close = _exactly(both.groupBy("level", "s", "p", "q").agg(F.sum("pairs").cast(COUNT).alias("pairs")), ["level"], len(attributes))
        ordered = every.select(F.lit(None).cast("string").alias("level"), "s", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "pairs")
        # Close names are among the unequal ones: what is close is no longer different.
        less = close.select(F.lit(None).cast("string").alias("level"), "s", "p", "q", (-F.col("pairs")).alias("pairs"))
        return close.select("level", "s", "p", "q", "pairs").unionByName(ordered).unionByName(less)

    matching = classes(["master_id"]).withColumn("match", F.lit(True))
    rest = classes([]).withColumn("match", F.lit(False)).unionByName(matching.withColumn("pairs", -F.col("pairs")).withColumn("match", F.lit(False)))
    found = matching.unionByName(rest).groupBy("match", "level", "s", "p", "q").agg(F.sum("pairs").cast(COUNT).alias("pairs")).filter("pairs > 0")
    bit = lambda c, i: F.col(c).bitwiseAND(F.lit(1 << i)) != 0
    both = lambda i: bit("p", i) & bit("q", i)
    agree = lambda i, kind: F.when(both(i), F.when(bit("s", i), f"{kind}.same").otherwise(f"{kind}.differs"))
    exact = F.array_compact(F.array(*[
        F.when(both(3 + i), F.struct(agree(3 + i, "exact").alias("level"), F.lit(f).alias("field"))) for i, f in enumerate(fields)
    ])) if fields else F.array().cast("array<struct<level:string,field:string>>")
    return found.select(
        "match", agree(0, "email").alias("email"), F.when(~bit("s", 0), agree(1, "domain")).alias("domain"),
        F.when(both(2), F.when(bit("s", 2), "name.same").otherwise(F.coalesce("level", F.lit("name.differs")))).alias("name"), exact.alias("exact"), "pairs",
    )


def labelled_classes(records: DataFrame) -> DataFrame:
    """The classes of all pairs of records whose masters are known, none left out."""
    return stored(pair_classes(records.filter(F.col("master_id").isNotNull())), "classes")


def evaluate_all(classes: DataFrame, model: M.Model, threshold: float = THRESHOLD) -> DataFrame:
    """``evaluate`` over the classes of all pairs (one row)."""
    above = M.probability({k: F.col(k) for k in ("email", "domain", "name", "exact")}, model) >= threshold
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("pairs"))), F.lit(0)).cast("bigint")
    counts = classes.withColumn("_above", above).agg(
        total(F.col("_above") & F.col("match")).alias("tp"), total(F.col("_above") & ~F.col("match")).alias("fp"), total(~F.col("_above") & F.col("match")).alias("fn")
    )
    return _quality(counts)


class Training(NamedTuple):
    """The model to use, the level report, and the quality of both models on held-out pairs."""

    model: M.Model
    levels: DataFrame
    quality: DataFrame


def fit(records: DataFrame, holdout: float = HOLDOUT, threshold: float = THRESHOLD, most: int | None = None) -> Training:
    """Trains on some masters, judges on the others; the trained model is used only if it
    is at least as precise as the default. It is fitted and judged on all pairs of either
    part; only where the caller gives ``most`` is it fitted on ``RECORDS_PER_MASTER`` records
    of a master and so many pairs of different ones. The nine levels, two quality rows, the
    names of exact identifiers and what the index of close names needs are brought to the
    driver."""
    marked = records.withColumn("_held", held_out(F.col("master_id"), holdout))
    known = marked.filter(~F.col("_held")).drop("_held")
    levels = train_all(labelled_classes(known)) if most is None else train(labelled_pairs(known, most, seed=1))
    trained = M.read_model(levels)
    held = labelled_classes(marked.filter("_held").drop("_held"))
    quality = evaluate_all(held, M.DEFAULT_MODEL, threshold).withColumn("model", F.lit("default")).unionByName(
        evaluate_all(held, trained, threshold).withColumn("model", F.lit("trained"))
    )
    by_model = {r["model"]: r["precision"] for r in quality.select("model", "precision").collect()}
    better = by_model["trained"] >= by_model["default"]
    return Training(trained if better else M.DEFAULT_MODEL, levels, quality)


def entity_digests(xref: DataFrame) -> DataFrame:
    """A digest of each entity's links, whatever their order."""
    entries = F.array_sort(F.map_entries("attributes"))
    text = F.concat_ws(
        "\x1f", "system", "source_id", "master_id",
        F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ","),
    )
    return xref.groupBy("entity").agg(link_digest(text).alias("digest"), F.count(F.lit(1)).alias("links"))


def to_retrain(xref: DataFrame, last: DataFrame) -> DataFrame:
    """Entities whose links changed since the digests of the last training."""
    now = entity_digests(xref)
    return now.join(last.select("entity", "digest"), ["entity", "digest"], "left_anti")
