"""Record linkage: identifying attributes, comparison levels, scores, suggestions, decisions.

A Fellegi-Sunter model weighs how each compared attribute of two records agrees. Records
are compared only within blocks: pairs sharing an email, a domain, the first letters of a
name, or an exact identifier.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import product
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlink.functions.similarity import CLOSE, SAME, index_keys, jaro_winkler, letters, similar_in_blocks, similarity_bound
from flowlink.session import stored

# Mail providers whose domain says nothing about an employer, and the
# levels with their default m and u probabilities, in order.
FREE_MAIL = (
    "gmail.com googlemail.com outlook.com hotmail.com live.com msn.com yahoo.com yahoo.de yahoo.co.uk "
    "icloud.com me.com mac.com aol.com gmx.de gmx.net gmx.at web.de t-online.de proton.me protonmail.com "
    "mail.com yandex.com zoho.com libero.it virgilio.it orange.fr free.fr laposte.net wanadoo.fr hey.com "
    "fastmail.com"
).split()
DEFAULT_LEVELS = {
    "email.same": (0.95, 0.0001),
    "email.differs": (0.30, 0.9999),
    "domain.same": (0.90, 0.002),
    "domain.differs": (0.10, 0.998),
    "name.same": (0.85, 0.02),
    "name.close": (0.10, 0.05),
    "name.differs": (0.05, 0.93),
    "exact.same": (0.95, 0.001),
    "exact.differs": (0.05, 0.999),
}
DEFAULT_PRIOR = 0.05
RUNNER_UP = 0.5
BLOCK_LETTERS = 3

ATTRIBUTES = ("email", "domain", "name", "exact")
EXACT_TYPE = "array<struct<field:string,value:string>>"


class Model(NamedTuple):
    """Nine levels' (m, u) and the prior probability that two records are the same entity."""

    levels: Mapping[str, tuple[float, float]]
    prior: float = DEFAULT_PRIOR

    def weight(self, level: str) -> float:
        m, u = self.levels.get(level, DEFAULT_LEVELS[level])
        return math.log(m / u)

    def score(self, pairs: DataFrame) -> DataFrame:
        return score_pairs(pairs, self)

    def prior_odds(self) -> float:
        prior = self.prior if 0 < self.prior < 1 else DEFAULT_PRIOR
        return prior / (1 - prior)

    def monotone(self) -> bool:
        """Whether agreeing on more never lowers a score, for whatever attributes are present."""
        w = self.weight
        return (
            w("name.same") >= w("name.close") >= w("name.differs")
            and w("exact.same") >= w("exact.differs")
            and w("domain.same") >= w("domain.differs")
            and w("email.same") >= max(w("email.differs"), w("email.differs") + w("domain.same"))
        )


DEFAULT_MODEL = Model(DEFAULT_LEVELS)


def model_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(level, *model.levels.get(level, DEFAULT_LEVELS[level])) for level in DEFAULT_LEVELS]
    return spark.createDataFrame(rows, "level string, m double, u double")


def read_model(table: DataFrame, prior: float = DEFAULT_PRIOR) -> Model:
    """The model of a nine-row table (level, m, u)."""
    rows = table.filter(F.col("level").isin(*DEFAULT_LEVELS)).select("level", "m", "u").limit(len(DEFAULT_LEVELS)).collect()
    return Model({r["level"]: (r["m"], r["u"]) for r in rows}, prior)


# --- Attributes -------------------------------------------------------------------------


def _email(value: Column) -> Column:
    """Lower-case text with an @ that is neither first nor last; NULL otherwise."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(value)), r"(?s)^(.+@[^@]+)$", 1), F.lit(""))


def _domain(value: Column) -> Column:
    domain = F.nullif(F.regexp_extract(F.lower(F.trim(value)), r"(?s)^.+@([^@]+)$", 1), F.lit(""))
    return F.when(~domain.isin(*FREE_MAIL), domain)


def _name(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{Nd}]+", " "))


def _exact(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"\s+", ""))


def extract_attributes(df: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds email, domain, name and exact from (column, kind) match fields.

    Kinds: email, domain, name, exact. Several columns of a kind: the last usable wins.
    """
    found: dict[str, list[Column]] = {"email": [], "domain": [], "name": []}
    exact: list[Column] = []
    for column, kind in fields:
        value = F.col(column).cast("string")
        if kind == "exact":
            code = _exact(value)
            exact.append(F.when(code != "", F.struct(F.lit(column).alias("field"), code.alias("value"))))
        else:
            read = {"email": _email, "domain": _domain, "name": _name}[kind](value)
            found[kind].insert(0, F.nullif(read, F.lit("")) if kind == "name" else read)
    empty = F.array().cast(EXACT_TYPE)
    listed = F.array_sort(F.array_compact(F.array(*exact))).cast(EXACT_TYPE) if exact else empty
    none = F.lit(None).cast("string")
    return df.withColumns(
        {**{k: F.coalesce(*v) if v else none for k, v in found.items()}, "exact": listed}
    )


def attributes_map(prefix: str = "") -> Column:
    """The attributes as stored with a link: a map keyed email, domain, name, exact:<field>."""
    c = lambda n: F.col(prefix + n)
    plain = F.array(*[F.struct(F.lit(k).alias("key"), c(k).alias("value")) for k in ("email", "domain", "name")])
    coded = F.transform(
        c("exact"), lambda e: F.struct(F.concat(F.lit("exact:"), e["field"]).alias("key"), e["value"].alias("value"))
    )
    return F.map_from_entries(F.filter(F.concat(plain, coded), lambda e: e["value"].isNotNull()))


def with_attributes(df: DataFrame, stored: str = "attributes") -> DataFrame:
    """Email, domain, name and exact of a stored attribute map."""
    m = F.col(stored)
    coded = F.filter(F.map_entries(m), lambda e: e["key"].startswith("exact:") & (e["value"] != ""))
    exact = F.transform(coded, lambda e: F.struct(F.substr(e["key"], F.lit(7)).alias("field"), e["value"].alias("value")))
    empty = F.array().cast(EXACT_TYPE)
    return df.withColumns(
        {
            **{k: F.when(m[k] != "", m[k]) for k in ("email", "domain", "name")},
            "exact": F.coalesce(F.array_sort(exact).cast(EXACT_TYPE), empty),
        }
    )


# --- Comparison -------------------------------------------------------------------------


def compare(a: str = "a_", b: str = "b_", similarity: Column | None = None) -> dict[str, Column]:
    """Comparison levels of a pair: email, domain, name (text or NULL) and exact (array).

    Attributes either side lacks are not compared, and the domain only counts where the
    addresses do not already agree. ``similarity`` is the names' Jaro-Winkler similarity,
    needed where they are not equal.
    """
    c = F.col

    def both(k: str) -> Column:
        return c(a + k).isNotNull() & c(b + k).isNotNull()

    email = F.when(both("email"), F.when(c(a + "email") == c(b + "email"), "email.same").otherwise("email.differs"))
    mail_agrees = F.coalesce(c(a + "email") == c(b + "email"), F.lit(False))
    domain = F.when(
        both("domain") & ~mail_agrees,
        F.when(c(a + "domain") == c(b + "domain"), "domain.same").otherwise("domain.differs"),
    )
    alike = F.when(c(a + "name") == c(b + "name"), F.lit(1.0)).otherwise(
        similarity if similarity is not None else F.lit(0.0)
    )
    name = F.when(
        both("name"), F.when(alike >= SAME, "name.same").when(alike >= CLOSE, "name.close").otherwise("name.differs")
    )
    other = F.map_from_entries(c(b + "exact"))
    shared = F.filter(c(a + "exact"), lambda e: F.map_contains_key(other, e["field"]))
    coded = F.transform(
        shared,
        lambda e: F.struct(
            F.when(e["value"] == other[e["field"]], "exact.same").otherwise("exact.differs").alias("level"),
            e["field"].alias("field"),
        ),
    )
    # Most pairs have nothing to look up: that is told without a map per pair.
    none = (F.size(a + "exact") == 0) | (F.size(b + "exact") == 0)
    exact = F.when(none, F.array().cast("array<struct<level:string,field:string>>")).otherwise(coded)
    return {"email": email, "domain": domain, "name": name, "exact": exact}


def name_similarity(a: str = "a_", b: str = "b_", bounded: bool = False, close: bool = False) -> Column:
    """Jaro-Winkler of the names of a pair; only unequal present names are sent to Python.

    With ``close``, the pair has the close names of its left one (see ``candidate_pairs``):
    they are looked up, and other unequal names count as unlike.
    With ``bounded``, the pair has the names' ``letters`` as well, and names that can't be
    close by those are not compared: their similarity is NULL.
    """
    x, y = F.col(a + "name"), F.col(b + "name")
    if close:
        return F.coalesce(F.col(a + "close")[y], F.lit(0.0))
    compared = x.isNotNull() & y.isNotNull() & (x != y)
    if bounded:
        bound = similarity_bound(x, y, F.col(a + "letters"), F.col(b + "letters"))
        compared = compared & (F.coalesce(bound, F.lit(1.0)) >= CLOSE - 1e-9)
    return jaro_winkler(F.when(compared, x), F.when(compared, y))


def pair_similarity(pairs: DataFrame) -> Column:
    """``name_similarity`` by the columns that the pairs have."""
    return name_similarity(bounded={"a_letters", "b_letters"} <= set(pairs.columns), close="a_close" in pairs.columns)


def log_odds(levels: Mapping[str, Column], model: Model) -> Column:
    """Sum of ln(m/u) over the compared levels."""

    def weigh(level: Column, names: Sequence[str]) -> Column:
        out = F.lit(0.0)
        for n in names:
            out = F.when(level == n, F.lit(model.weight(n))).otherwise(out)
        return out

    by_kind = {
        k: weigh(levels[k], [n for n in DEFAULT_LEVELS if n.startswith(k + ".")]) for k in ("email", "domain", "name")
    }
    exact = F.when(F.size(levels["exact"]) == 0, F.lit(0.0)).otherwise(
        F.aggregate(levels["exact"], F.lit(0.0), lambda acc, e: acc + weigh(e["level"], ["exact.same", "exact.differs"]))
    )
    return by_kind["email"] + by_kind["domain"] + by_kind["name"] + exact


def probability(levels: Mapping[str, Column], model: Model) -> Column:
    odds = F.lit(model.prior_odds()) * F.exp(log_odds(levels, model))
    return odds / (1 + odds)


def reasons(levels: Mapping[str, Column]) -> Column:
    """Why a pair may be the same: one text per agreeing attribute, in a fixed order."""
    none = F.array().cast("array<string>")
    one = lambda text: F.array(F.lit(text))
    codes = F.transform(
        F.filter(levels["exact"], lambda e: e["level"] == "exact.same"), lambda e: F.concat(F.lit("same "), e["field"])
    )
    return F.concat(
        F.when(levels["email"] == "email.same", one("same email address")).otherwise(none),
        F.when(levels["domain"] == "domain.same", one("same company email domain")).otherwise(none),
        F.when(levels["name"] == "name.same", one("same name")).when(levels["name"] == "name.close", one("similar name")).otherwise(none),
        F.when(F.size(levels["exact"]) == 0, none).otherwise(codes),
    )


def _told(model: Model, spark: SparkSession) -> DataFrame:
    """Score and reasons of all ways in which address, domain and name can compare, without exact identifiers."""
    kinds = {k: [None, *[n for n in DEFAULT_LEVELS if n.startswith(k + ".")]] for k in ("email", "domain", "name")}
    rows = [(i, *way) for i, way in enumerate(product(*kinds.values()))]
    ways = spark.createDataFrame(rows, "code int, email string, domain string, name string").coalesce(1)
    levels = {k: F.col(k) for k in kinds} | {"exact": F.array().cast("array<struct<level:string,field:string>>")}
    return ways.select("code", *kinds, probability(levels, model).alias("score"), reasons(levels).alias("reasons"))


def score_pairs(pairs: DataFrame, model: Model = DEFAULT_MODEL, decimals: int | None = None) -> DataFrame:
    """Adds score (unrounded, unless ``decimals`` are given) and reasons to pairs of a_ and b_ attributes.

    Pairs with the ``letters`` of both names are compared by those first. Most pairs compare
    no exact identifier: their score and reasons are one of 36, computed once and looked up.
    """
    rounded = lambda score: score if decimals is None else F.round(score, decimals)
    told = _told(model, pairs.sparkSession).select("*", rounded(F.col("score")).alias("shown")).orderBy("code").limit(36).collect()
    known = pairs.withColumn("_similarity", pair_similarity(pairs))
    levels = compare(similarity=F.col("_similarity"))
    named = known.withColumns({f"_{k}": v for k, v in levels.items()}).drop("_similarity")
    read = {k: F.col(f"_{k}") for k in levels}
    code = F.lit(0)
    for k in ("email", "domain", "name"):
        seen = [r[k] for r in told if r[k] is not None]
        names = sorted(set(seen), key=seen.index)
        place = F.lit(0)
        for i, n in enumerate(names, 1):
            place = F.when(read[k] == n, i).otherwise(place)
        code = code * (len(names) + 1) + place
    scores = F.array(*[F.lit(r["shown"]) for r in told])
    texts = F.array(*[F.array(*map(F.lit, r["reasons"])).cast("array<string>") for r in told])
    plain = F.size("_exact") == 0
    return named.withColumn("_code", code).withColumns({
        "score": F.when(plain, F.get(scores, F.col("_code"))).otherwise(rounded(probability(read, model))),
        "reasons": F.when(plain, F.get(texts, F.col("_code"))).otherwise(reasons(read)),
    }).drop("_code", *[f"_{k}" for k in levels])


# --- Blocking ---------------------------------------------------------------------------


def block_keys(prefix: str = "") -> Column:
    """array<struct<rule, key>> a record may share with another."""
    c = lambda n: F.col(prefix + n)

    def rule(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("rule"), value.alias("key")))

    plain = F.array_compact(
        F.array(
            rule("email", c("email")),
            rule("domain", c("domain")),
            rule("name", F.substring(c("name"), 1, BLOCK_LETTERS)),
        )
    )
    coded = F.transform(
        c("exact"), lambda e: F.struct(F.concat(F.lit("exact:"), e["field"]).alias("rule"), e["value"].alias("key"))
    )
    return F.concat(plain, coded)


def comparable() -> Column:
    """Whether a record has any attribute at all."""
    return comparable_of("")


def comparable_of(prefix: str) -> Column:
    plain = F.col(prefix + "email").isNotNull() | F.col(prefix + "domain").isNotNull() | F.col(prefix + "name").isNotNull()
    return plain | (F.size(prefix + "exact") > 0)


def profiles(df: DataFrame) -> DataFrame:
    """Adds ``profile``: one value for records with equal attributes."""
    return df.withColumn("profile", F.md5(F.to_json(F.struct(*ATTRIBUTES))))


def linked_profiles(linked: DataFrame, limit: int) -> DataFrame:
    """Distinct attributes of linked records with their ``limit`` lowest masters.

    Records with equal attributes score the same, so no other of their masters can be
    among the ``limit`` best: copies of one record collapse without a loss.
    """
    usable = profiles(linked.filter(comparable()))
    per_master = usable.groupBy("entity", "profile", "master_id").agg(
        *[F.any_value(a).alias(a) for a in ATTRIBUTES], F.min("source_id").alias("source_id")
    )
    lowest = Window.partitionBy("entity", "profile").orderBy("master_id")
    return per_master.withColumn("_n", F.row_number().over(lowest)).filter(F.col("_n") <= limit).drop("_n")


def blocks(df: DataFrame, *ids: str) -> DataFrame:
    """(entity, rule, key, ids...) rows of records or profiles."""
    return df.select("entity", *ids, F.inline(block_keys()))


def block_sizes(linked: DataFrame) -> DataFrame:
    """Distinct profiles per block: the report of what a shared domain costs."""
    return blocks(profiles(linked).select("entity", "profile", *ATTRIBUTES).dropDuplicates(["entity", "profile"]), "profile").groupBy(
        "entity", "rule", "key"
    ).agg(F.count(F.lit(1)).alias("size"))


def _listed(df: DataFrame, *ids: str, into: str) -> DataFrame:
    """``blocks`` with one text per block, each row with all texts of its record, in order."""
    keys = F.array_distinct(F.transform(block_keys(), lambda k: F.concat_ws("\x1f", k["rule"], k["key"])))
    return df.select("entity", *ids, keys.alias(into)).select("*", F.posexplode(into).alias(f"{into}_at", "block"))


def _met(left: DataFrame, right: DataFrame, on: Sequence[str] = ("entity", "block")) -> DataFrame:
    """Joined rows of two ``_listed`` tables, each pair once: at the first block it shares."""
    at = F.col("_a_at")
    # Few blocks come first on the left: most pairs need one look, no set of all that is shared.
    repeated = F.when(at == 0, False).when(at == 1, F.array_contains("_b", F.get("_a", F.lit(0)))).otherwise(F.arrays_overlap(F.slice("_a", F.lit(1), at), "_b"))
    return left.join(right, list(on)).filter(~repeated).drop("block", "_a", "_b", "_a_at", "_b_at")


SIDE = 1 << 12  # rows on one side of a block that one task joins with as many of the other
CLOSE_NAMES = 32  # close names per name, on average, up to which they go along with the records


def _in_cells(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of blocks, large ones cut into parts of ``SIDE`` rows; every two parts are a cell (i, j).

    A cell's pairs are one task's work, so a block that very many records share is spread over
    all tasks; a row is repeated once for every ``SIDE`` rows that it meets.
    """
    key = ["entity", "block"]
    counted = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias(name))
    cells = stored(counted(left, "_p").join(counted(right, "_q"), key), "block-cells")
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, row: list[str], own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        placed = df.join(cells, key).withColumn(own, F.pmod(F.xxhash64(*row), own_parts).cast("int"))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)))
        return placed.drop("_p", "_q").repartition(parts, *key, "_i", "_j")

    plain = lambda df: [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return dealt(left, plain(left), "_i", "_p", "_j", "_q"), dealt(right, plain(right), "_j", "_q", "_i", "_p")


def _close_in_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """(entity, a_name, b_name, similarity) of the unequal but close names that share a block.

    Both sides are (entity, block, name). Names of small blocks are joined, those of larger
    ones compared chunk by chunk: work of some 16 ns a pair of names, in bounded memory.
    """
    key = ["entity", "block"]
    a, b = (df.filter(F.col("name").isNotNull()).select(*key, "name").distinct() for df in (left, right))
    counted = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    sizes = stored(counted(a, "na").join(counted(b, "nb"), key), "name-blocks")
    few = F.col("na") * F.col("nb") <= HOT_PAIRS
    side = lambda df, p: df.select(*key, F.col("name").alias(p + "name"), letters(F.col("name")).alias(p + "letters"))
    met = side(a.join(sizes.filter(few), key, "left_semi"), "a_").join(side(b, "b_"), key).filter("a_name <> b_name")
    bound = similarity_bound(F.col("a_name"), F.col("b_name"), F.col("a_letters"), F.col("b_letters"))
    able = met.filter(F.coalesce(bound, F.lit(1.0)) >= CLOSE - 1e-9).select("entity", "a_name", "b_name")
    chunked = _compared_chunks(a, b, sizes.filter(~few), NAME_CHUNK).select("entity", "a_name", "b_name")
    near = able.unionByName(chunked).distinct().withColumn("similarity", jaro_winkler("a_name", "b_name"))
    return near.filter(F.col("similarity") >= CLOSE)


def candidate_pairs(records: DataFrame, linked: DataFrame, attributes: bool = False) -> DataFrame:
    """(entity, record_id, source_id) of linked records sharing any block, each pair once.

    One equi-join on exploded keys; an OR of four conditions would be a nested loop. A pair
    that shares several blocks is given out at the first of them only, so pairs needn't be
    shuffled again to be made distinct. The result grows with the product of a block's
    sides: to find masters, use ``suggest``. Keys of a record may be repeated in the tables;
    then so are its pairs.

    With ``attributes`` a pair has those of both its sides (``a_``, ``b_``) and its master:
    they go along with the records, as the pairs are far too many to be joined to them. So do
    the close names of the left one (``a_close``); where these are very many, the ``letters``
    of both names instead.
    """
    ids = ["source_id", "system"] if "system" in linked.columns else ["source_id"]
    left, right = stored(_listed(records, "record_id", into="_a"), "records-listed"), stored(_listed(linked, *ids, into="_b"), "linked-listed")
    if attributes:
        left, right = _with_attributes(records, linked, left, right)
    return _met(*_in_cells(left, right), ["entity", "block", "_i", "_j"]).drop("_i", "_j")


def _with_attributes(records: DataFrame, linked: DataFrame, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listed sides with the attributes of the records that have their ids."""
    named = lambda df, p: [F.col(c).alias(p + c) for c in ATTRIBUTES]
    a = stored(left.join(records.select("record_id", *named(records, "a_")), "record_id"), "records-wide")
    b = stored(right.join(linked.select("source_id", "master_id", *named(linked, "b_")), "source_id"), "linked-wide")
    names = lambda df, p: df.select("entity", "block", F.col(p + "name").alias("name"))
    near = stored(_close_in_blocks(names(a, "a_"), names(b, "b_")), "close-names")
    if near.count() > CLOSE_NAMES * a.select("entity", "a_name").distinct().count():
        return a.withColumn("a_letters", letters(F.col("a_name"))), b.withColumn("b_letters", letters(F.col("b_name")))
    by_name = near.groupBy("entity", "a_name").agg(F.map_from_entries(F.collect_list(F.struct("b_name", "similarity"))).alias("a_close"))
    return a.join(by_name, ["entity", "a_name"], "left"), b


# --- Suggestions ------------------------------------------------------------------------

HOT_BLOCK = 2000
HOT_PAIRS = 1 << 11  # pairs of records and linked records of a block that are compared one by one
NAME_CHUNK = 2000


def _ordinary_pairs(left: DataFrame, right: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(entity, a_profile, b_profile) that share a block that isn't hot; with hot ones, some twice."""
    if hot is None:
        a = _listed(left.withColumnRenamed("profile", "a_profile"), "a_profile", into="_a")
        return _met(a, _listed(right.withColumnRenamed("profile", "b_profile"), "b_profile", into="_b"))
    key = ["entity", "rule", "key"]
    a = blocks(left, "profile").withColumnRenamed("profile", "a_profile").join(hot, key, "left_anti")
    b = blocks(right, "profile").withColumnRenamed("profile", "b_profile").join(hot, key, "left_anti")
    return a.join(b, key).select("entity", "a_profile", "b_profile")


def _subsets(hot_keys: Column) -> Column:
    """All non-empty subsets of a sorted array, each as one text."""
    grown = F.aggregate(
        hot_keys,
        F.array(F.lit("")),
        lambda acc, k: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.lit("\x1f"), k))),
    )
    return F.filter(grown, lambda s: s != "")


def _hot_keys(df: DataFrame, hot: DataFrame, profile: str = "profile") -> DataFrame:
    """Per profile: its hot evidence keys, sorted, and whether its name block is hot."""
    held = blocks(df, profile).join(hot, ["entity", "rule", "key"], "left_semi")
    text = F.concat(F.col("rule"), F.lit("="), F.col("key"))
    return held.groupBy("entity", profile).agg(
        F.array_sort(F.collect_set(F.when(F.col("rule") != "name", text))).alias("hot_keys"),
        F.max(F.when(F.col("rule") == "name", text)).alias("hot_name"),
    )


DIRECT = 1 << 25  # pairs of names of a block that are compared rather than searched


def similar_names(left: DataFrame, right: DataFrame, chunk: int, direct: int = DIRECT, once: bool = False) -> DataFrame:
    """(entity, block, a_name, b_name) of unequal but close names sharing a hot block.

    Names are made distinct per block. Blocks of up to ``direct`` pairs are cut into chunks,
    and each pair of chunks is one task's work; in larger ones names meet by the keys of an
    index (``index_keys``), which every two close names share, and only those are compared.
    Either way the close pairs alone are given out, and none is missing. With ``once`` both
    sides are one table, and a pair is given out with its lower name first only.
    """

    def named(df: DataFrame) -> DataFrame:
        keys = F.concat(F.col("hot_keys"), F.array_compact(F.array("hot_name")))
        return df.filter(F.col("name").isNotNull()).select("entity", F.explode(keys).alias("block"), "name").distinct()

    a, b = named(left), named(right)
    block = ["entity", "block"]

    def counted(df: DataFrame, count: str) -> DataFrame:
        return df.groupBy(*block).agg(F.count(F.lit(1)).alias(count))

    sizes = stored(counted(a, "na").join(counted(b, "nb"), block), "blocks")
    few = F.col("na") * F.col("nb") <= direct
    close = _compared_chunks(a, b, sizes.filter(few), chunk, once=once)
    large = sizes.filter(~few)
    return close if large.isEmpty() else close.unionByName(_searched(a, b, large.select(*block), once))


def _compared_chunks(a: DataFrame, b: DataFrame, sizes: DataFrame, chunk: int, keys: Sequence[str] = ("entity", "block"), once: bool = False) -> DataFrame:
    """(keys..., a_name, b_name) of unequal close names with equal keys: each pair of chunks is a group's work.

    ``sizes`` is (keys, na, nb). With ``once`` both sides are one table, and a pair is found with
    its lower name first only. Large tables have larger chunks, as each chunk is sent to all others.
    """
    keys = list(keys)
    parts = sizes.select(*keys, *[
        F.ceil(F.greatest(F.least(F.col(c) / chunk, F.lit(MOST_CHUNKS)), F.col(c) / (4 * chunk))).cast("int").alias(c) for c in ("na", "nb")
    ])
    i, j = F.pmod(F.xxhash64("name"), "na").cast("int"), F.pmod(F.xxhash64("name"), "nb").cast("int")
    a = a.join(parts, keys).select(*keys, "name", i.alias("i"), "nb").select(
        *keys, "name", "i", F.explode(F.sequence(F.col("i") if once else F.lit(0), F.col("nb") - 1)).alias("j")
    )
    # Both sides may be the same table: new names keep their columns apart.
    b = b.join(parts, keys).select(*[F.col(c).alias(c) for c in (*keys, "name")], j.alias("j"), "na").select(
        *keys, "name", F.explode(F.sequence(F.lit(0), F.col("j") if once else F.col("na") - 1)).alias("i"), "j"
    )

    def close(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        left_names, right_names = x["name"].to_pylist(), y["name"].to_pylist()
        i, j, _ = similar_in_blocks(left_names, right_names, ordered=once)
        found = [(left_names[m], right_names[n]) for m, n in zip(i, j) if left_names[m] != right_names[n]]
        if once:
            alone = key[-2].as_py() == key[-1].as_py()
            found = [(m, n) if m < n else (n, m) for m, n in found if m < n or not alone]
        told = {c: pa.array([key[at].as_py()] * len(found), pa.string()) for at, c in enumerate(keys)}
        return pa.table({**told, "a_name": pa.array([m for m, _ in found], pa.string()), "b_name": pa.array([n for _, n in found], pa.string())})

    slots = [*keys, "i", "j"]
    return a.groupBy(*slots).cogroup(b.groupBy(*slots)).applyInArrow(close, ", ".join(f"{c} string" for c in (*keys, "a_name", "b_name")))


MOST_CHUNKS = 32  # of a side, before chunks get larger
TRIED = 20_000  # names from whose keys it is told what an index would cost
DENSE = 100  # pairs compared in chunks in the time of one met in the index
MOST_LETTERS = 4096  # whose frequency is known; all others count as rare


def close_names(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), once: bool = False, dense: int = DENSE) -> DataFrame:
    """(keys..., a_name, b_name) of the unequal but close ``name``s of two tables with equal keys (text).

    Names meet by the keys of an index that every two close names share; names that can't be
    close by their letters are not compared. Where names are so alike in letters that one in
    ``dense`` of all pairs would meet, as a few names tell, all are compared chunk by chunk
    instead, with the same result. With ``once`` both tables are the same, and a pair is given
    out with its lower name first only. The driver sees how often letters occur (at most
    ``MOST_LETTERS``), the lengths of names and those numbers of pairs.
    """
    keys = list(keys)
    if not keys:
        a, b = a.withColumn("_all", F.lit("")), b.withColumn("_all", F.lit(""))
        return close_names(a, b, ["_all"], once, dense).drop("_all")
    chars = b.select(F.explode(F.split("name", "")).alias("c")).filter(F.col("c") != "").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r["c"]: float(r["n"]) for r in chars.orderBy(F.desc("n"), "c").limit(MOST_LETTERS).collect()}
    lengths = [sorted(r[0] for r in df.select(F.length("name")).distinct().collect()) for df in (a, b)]

    def indexed(df: DataFrame, other: list[int], left: bool, p: str) -> DataFrame:
        # Names whose keys are equal by their hash alone are told apart when they are compared.
        @F.pandas_udf("array<string>")
        def found(names: pd.Series) -> pd.Series:
            return names.map(lambda n: sorted({"\x1f".join(map(str, k)) for k in index_keys(n, other, frequency, left)}))

        named = df.select(*keys, F.col("name").alias(p + "name"), letters(F.col("name")).alias(p + "letters"), found("name").alias("_keys"))
        return named.select(*keys, p + "name", p + "letters", F.explode(F.transform("_keys", lambda k: F.xxhash64(k))).alias("_key"))

    def counted(df: DataFrame, by: list[str], count: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(count))

    sizes = counted(a, keys, "na").join(counted(b, keys, "nb"), keys)
    total = sizes.agg(F.sum("na").alias("a"), F.sum("nb").alias("b"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("pairs")).first()
    share = max(1, max(total["a"] or 0, total["b"] or 0) // TRIED)
    tried = F.pmod(F.xxhash64("name", F.lit(7)), F.lit(share)) == 0
    by = [*keys, "_key"]
    meet = counted(indexed(a.filter(tried), lengths[1], True, "a_"), by, "na").join(counted(indexed(b.filter(tried), lengths[0], False, "b_"), by, "nb"), by)
    met_pairs = meet.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0.0
    if dense * met_pairs * share * share > (total["pairs"] or 0.0):
        return _compared_chunks(a, b, sizes, NAME_CHUNK, keys, once).distinct()
    met = indexed(a, lengths[1], True, "a_").join(indexed(b, lengths[0], False, "b_"), by)
    met = met.filter(F.col("a_name") < F.col("b_name") if once else F.col("a_name") != F.col("b_name"))
    bound = similarity_bound(F.col("a_name"), F.col("b_name"), F.col("a_letters"), F.col("b_letters"))
    able = met.filter(F.coalesce(bound, F.lit(1.0)) >= CLOSE - 1e-9).select(*keys, "a_name", "b_name").distinct()
    return able.filter(jaro_winkler("a_name", "b_name") >= CLOSE)


def _searched(a: DataFrame, b: DataFrame, large: DataFrame, once: bool) -> DataFrame:
    block = ["entity", "block"]
    return close_names(a.join(large, block, "left_semi"), b.join(large, block, "left_semi"), block, once).select(*block, "a_name", "b_name")


def _hot_pairs(left: DataFrame, right: DataFrame, hot: DataFrame, limit: int, chunk: int, direct: int) -> DataFrame:
    """Pairs to score in blocks too large to compare pair by pair, without losing a result.

    Linked profiles agreeing on the same hot keys, with the same attributes present, score
    alike for any record whose name they do not resemble: the ``limit`` lowest masters of
    each such group stand for all of it. Those with one and the same name score alike also
    where the name matters, so equal and close names are looked up in groups by name. Since
    agreeing on more never lowers a score, a group's other members cannot pass its
    representatives.
    """
    a_keys, b_keys = _hot_keys(left, hot), _hot_keys(right, hot)
    a = left.select("entity", "profile", "name").join(a_keys, ["entity", "profile"])
    b = right.select("entity", "profile", "master_id", "source_id", *ATTRIBUTES).join(b_keys, ["entity", "profile"])
    present = F.concat_ws(
        ",", F.col("email").isNotNull().cast("string"), F.col("domain").isNotNull().cast("string"),
        F.col("name").isNotNull().cast("string"), F.transform("exact", lambda e: e["field"]),
    )
    # With evidence: groups per subset of hot keys. Without any: the hot name block itself.
    agreed = F.when(F.col("hot_name").isNull(), _subsets(F.col("hot_keys"))).otherwise(
        F.concat(F.array("hot_name"), _subsets(F.col("hot_keys")))
    )
    b_groups = b.select("entity", "profile", "master_id", "source_id", "name", present.alias("present"), F.explode(agreed).alias("agreed"))

    def lowest(keys: list[str]) -> DataFrame:
        # Of a master's records that score alike the lowest source id speaks, as in small blocks.
        per_master = b_groups.groupBy(*keys, "master_id").agg(F.min(F.struct("source_id", "profile"))["profile"].alias("b_profile"))
        order = Window.partitionBy(*keys).orderBy("master_id")
        return per_master.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n", "master_id")

    a_groups = a.select("entity", F.col("profile").alias("a_profile"), "name", F.explode(agreed).alias("agreed"))
    any_name = lowest(["entity", "agreed", "present"])
    # A shared name block alone is no evidence: only equal and close names count there.
    evident = a_groups.filter(~F.col("agreed").startswith("name="))
    by_evidence = evident.join(any_name, ["entity", "agreed"]).select("entity", "a_profile", "b_profile")
    by_name = lowest(["entity", "agreed", "present", "name"])
    same = a_groups.join(by_name, ["entity", "agreed", "name"]).select("entity", "a_profile", "b_profile")
    alike = similar_names(a, b, chunk, direct).select("entity", "a_name", "b_name").distinct()
    close = (
        a_groups.withColumnRenamed("name", "a_name")
        .join(alike, ["entity", "a_name"])
        .join(by_name.withColumnRenamed("name", "b_name"), ["entity", "agreed", "b_name"])
        .select("entity", "a_profile", "b_profile")
    )
    return by_evidence.unionByName(same).unionByName(close)


SPARE = 3  # of a group's lowest masters, besides as many as are asked for, that are looked at


def _hot_pairs_of_any_model(left: DataFrame, right: DataFrame, hot: DataFrame, limit: int, chunk: int, direct: int) -> DataFrame:
    """``_hot_pairs`` for models under which agreeing on more can lower a score.

    Linked records of a group (hot keys that agree, attributes present, name where it is equal
    or close) that share no other key with a record score alike for it, under any model. Others
    share a key that isn't hot, or more hot keys, and so are found elsewhere. The ``limit`` lowest
    masters of those that share just the group's keys stand for them; they are looked for among
    a few of the group's lowest masters, and where these don't tell, the record is compared
    with the whole group.
    """
    evidence = F.filter(F.array_distinct(F.transform(block_keys(), lambda k: F.when(k["rule"] != "name", F.concat(k["rule"], F.lit("="), k["key"])))), lambda k: k.isNotNull())
    a = left.select("entity", "profile", "name", evidence.alias("held")).join(_hot_keys(left, hot), ["entity", "profile"])
    b = right.select("entity", "profile", "master_id", "source_id", *ATTRIBUTES, evidence.alias("held")).join(_hot_keys(right, hot), ["entity", "profile"])
    present = F.concat_ws(
        ",", F.col("email").isNotNull().cast("string"), F.col("domain").isNotNull().cast("string"),
        F.col("name").isNotNull().cast("string"), F.transform("exact", lambda e: e["field"]),
    )
    subset = lambda agreed, size: F.struct(agreed.alias("agreed"), size.alias("size"))
    grown = F.aggregate(
        "hot_keys", F.array(subset(F.lit(""), F.lit(0))),
        lambda acc, k: F.concat(acc, F.transform(acc, lambda s: subset(F.concat(s["agreed"], F.lit("\x1f"), k), s["size"] + 1))),
    )
    subsets = F.filter(grown, lambda s: s["size"] > 0)
    agreed = F.when(F.col("hot_name").isNull(), subsets).otherwise(F.concat(F.array(subset(F.col("hot_name"), F.lit(0))), subsets))
    b_groups = stored(b.select("entity", "profile", "master_id", "source_id", "name", "held", present.alias("present"), F.inline(agreed)).drop("size"), "groups")
    alike = stored(similar_names(a, b, chunk, direct).select("entity", "a_name", "b_name").distinct(), "alike")
    near = alike.groupBy("entity", F.col("a_name").alias("name")).agg(F.collect_set("b_name").alias("near"))
    a_groups = stored(
        a.join(near, ["entity", "name"], "left").select("entity", F.col("profile").alias("a_profile"), F.col("name").alias("a_name"), F.col("held").alias("a_held"), "near", F.inline(agreed)), "asked-groups"
    )

    def lowest(keys: list[str]) -> DataFrame:
        """(keys..., firsts): the lowest masters of each group, one more than are looked at."""
        row = F.struct("source_id", "profile", "name", "held")
        per_master = b_groups.groupBy(*keys, "master_id").agg(F.min(row).alias("low"), F.count(F.lit(1)).alias("many"))
        few = per_master.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("master_id"))).filter(F.col("_n") <= limit + SPARE + 1)
        first = F.struct("_n", F.col("low.profile").alias("profile"), F.col("low.name").alias("name"), F.col("low.held").alias("held"), (F.col("many") > 1).alias("others"))
        return few.groupBy(*keys).agg(F.array_sort(F.collect_list(first)).alias("firsts"))

    def told(met: DataFrame, keys: list[str], named: bool) -> DataFrame:
        """Pairs of a record with the lowest masters that share just the group's keys; with all of the group where that isn't clear."""

        def just(r: Column) -> Column:
            alone = F.size(F.array_intersect("a_held", r["held"])) == F.col("size")
            unlike = F.coalesce((r["name"] != F.col("a_name")) & ~F.coalesce(F.array_contains("near", r["name"]), F.lit(False)), F.lit(True))
            return alone if named else alone & unlike

        seen = met.withColumn("_more", F.size("firsts") > limit + SPARE).withColumn(
            "_seen", F.transform(F.slice("firsts", 1, limit + SPARE), lambda r: F.struct(r["profile"].alias("profile"), just(r).alias("just"), r["others"].alias("others")))
        )
        # A master whose lowest record shares more may have another that doesn't: what follows it is not clear.
        unclear = F.array_position(F.transform("_seen", lambda r: ~r["just"] & r["others"]), True)
        seen = seen.withColumn("_unclear", unclear).withColumn("_clear", F.when(F.col("_unclear") == 0, F.col("_seen")).otherwise(F.slice("_seen", F.lit(1), F.greatest(F.col("_unclear").cast("int") - 1, F.lit(0)))))
        found = seen.withColumn("_found", F.filter("_clear", lambda r: r["just"]))
        enough = (F.size("_found") >= limit) | ((F.col("_unclear") == 0) & ~F.col("_more"))
        some = found.filter(enough).select("entity", "a_profile", F.explode(F.slice("_found", 1, limit)["profile"]).alias("b_profile"))
        whole = found.filter(~enough).select(*keys, "a_profile").join(b_groups.select(*keys, F.col("profile").alias("b_profile")), keys)
        return some.unionByName(whole.select("entity", "a_profile", "b_profile"))

    any_name, by_name = ["entity", "agreed", "present"], ["entity", "agreed", "present", "name"]
    # A shared name block alone is no evidence: only equal and close names count there.
    by_evidence = a_groups.filter("size > 0").join(lowest(any_name), ["entity", "agreed"])
    groups = stored(lowest(by_name).filter(F.col("name").isNotNull()), "named-groups")
    same = a_groups.withColumn("name", F.col("a_name")).join(groups, ["entity", "agreed", "name"])
    close = a_groups.join(alike.withColumnRenamed("b_name", "name"), ["entity", "a_name"]).join(groups, ["entity", "agreed", "name"])
    return told(by_evidence, any_name, False).unionByName(told(same, by_name, True)).unionByName(told(close, by_name, True))


def suggest(
    records: DataFrame,
    linked: DataFrame,
    model: Model = DEFAULT_MODEL,
    limit: int = 3,
    hot_block: int | None = HOT_BLOCK,
    chunk: int = NAME_CHUNK,
    decimals: int = 3,
    direct: int = DIRECT,
) -> DataFrame:
    """The ``limit`` best masters per record: (record_id, master_id, score, reasons, rank),
    and the unrounded probability.

    ``records`` is (entity, record_id, attributes...), ``linked`` (entity, source_id,
    master_id, attributes...). The best record of each master counts; candidates that agree
    on nothing are dropped; scores are rounded, equal ones are ordered by master. Any model
    with ``score`` and ``monotone`` will do.

    Equal records are compared once. Blocks of more than ``hot_block`` linked records, or more
    than ``HOT_PAIRS`` pairs, are searched by groups (see ``_hot_pairs``), which gives the same result;
    for a model under which agreeing can lower a score, more of a group is looked at (see
    ``_hot_pairs_of_any_model``).
    """
    shaped = profiles(records.filter(comparable()))
    left = shaped.groupBy("entity", "profile").agg(*[F.any_value(a).alias(a) for a in ATTRIBUTES])
    masters = linked_profiles(linked, limit)

    def grouped(df: DataFrame) -> DataFrame:
        return df.groupBy("entity", "profile").agg(*[F.any_value(a).alias(a) for a in ATTRIBUTES], F.min("master_id").alias("master_id"))

    right = grouped(masters)
    hot = None
    if hot_block is not None:
        # Counting rows, not profiles, may call a block hot too early: that costs nothing.
        key = ["entity", "rule", "key"]
        sizes = blocks(linked).groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
        asked = blocks(left).groupBy(*key).agg(F.count(F.lit(1)).alias("asked"))
        many = (F.col("size") > hot_block) | (F.col("size") * F.col("asked") > HOT_PAIRS)
        hot = stored(sizes.join(asked, key).filter(many).select(*key), "hot")
        if hot.isEmpty():
            hot = None
        else:  # the grouped search reads both sides several times
            left, masters = stored(left, "asked"), stored(masters, "masters")
            right = grouped(masters)
    pairs = _ordinary_pairs(left, right, hot)
    if hot is not None:
        # Groups count masters, so each profile takes part with all the masters it keeps.
        every = masters.select("entity", "profile", "master_id", "source_id", *ATTRIBUTES)
        search = _hot_pairs if model.monotone() else _hot_pairs_of_any_model
        pairs = pairs.unionByName(search(left, every, hot, limit, chunk, direct)).dropDuplicates()

    def side(df: DataFrame, p: str) -> DataFrame:
        found = [F.col(x).alias(p + x) for x in ATTRIBUTES]
        return df.select("entity", F.col("profile").alias(f"{p}profile"), *found, letters(F.col("name")).alias(p + "letters"))

    wide = pairs.join(side(left, "a_"), ["entity", "a_profile"]).join(side(right, "b_"), ["entity", "b_profile"])
    scored = model.score(wide).filter(F.size("reasons") > 0).select("entity", "a_profile", "b_profile", "score", "reasons")
    by_master = scored.join(
        masters.select("entity", F.col("profile").alias("b_profile"), "master_id", "source_id"), ["entity", "b_profile"]
    )
    # The unrounded score, then the lowest source id, choose a master's record.
    best = by_master.groupBy("entity", "a_profile", "master_id").agg(
        F.min(F.struct((-F.col("score")).alias("cost"), "source_id", "reasons")).alias("best")
    )
    shown = best.select(
        "entity", "a_profile", "master_id", F.round(-F.col("best.cost"), decimals).alias("score"), F.col("best.reasons").alias("reasons"),
        (-F.col("best.cost")).alias("probability"),
    )
    order = Window.partitionBy("entity", "a_profile").orderBy(F.desc("score"), "master_id")
    top = shown.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    names = shaped.select("entity", "record_id", F.col("profile").alias("a_profile"))
    return names.join(top, ["entity", "a_profile"]).drop("a_profile")


def decide(suggestions: DataFrame, threshold: float) -> DataFrame:
    """(entity, record_id, master_id, score, reasons) of certain matches.

    The best suggestion reaches the threshold and no other master comes close.
    """
    best = F.col("rank") == 1
    ranked = suggestions.groupBy("entity", "record_id").agg(
        F.max(F.when(best, F.struct("score", "master_id", "reasons"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    certain = (F.col("first.score") >= threshold) & (F.coalesce("second", F.lit(0.0)) < RUNNER_UP)
    return ranked.filter(certain).select("entity", "record_id", "first.master_id", "first.score", "first.reasons")
