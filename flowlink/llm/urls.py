"""URL filters (operator 2): host and path rules, and a tree of path templates per host.

Paths are cut into segments. Segments that are variable by their form (numbers, hexadecimal
ids, long slugs) are wildcards from the start, so a host of millions of articles is a few
patterns before anything is shuffled. Going down from the host, as deep as paths go, a
segment stays a branch of its own only if the share of bad labels below it differs from its
siblings' beyond chance; similar branches merge into the wildcard. Each template
left has a purity: its bad labels among all its labels, smoothed towards its host's, which is
smoothed towards that of all hosts. Impure templates are rejected. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlink.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHANCE = 0.01  # how often siblings alike are taken for different, by chance
FEW = 50  # labels of a branch up to which that is computed exactly
APART = 2.58  # standard errors between a branch and its siblings that are beyond chance
SIBLINGS = 20  # branches up to which that holds; among more, chance goes further
WEIGHT = 4.0  # labels that the smoothing counts as
IMPURE = 0.5
SALTS = 32


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does.

    A rule is a verdict and ``host/path``; it fits its host and all its subdomains where the
    path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def pattern_of(path: Column) -> Column:
    """A path's segments, those variable by form as ``*`` and their extension."""
    segments = F.array_remove(F.split(path, "/"), "")
    return F.transform(
        segments,
        lambda s: F.when(
            s.rlike(r"^([0-9]+|[0-9a-fA-F-]{16,}|.*[0-9].*[0-9].*[0-9].*|.{40,}|([^-]+-){3,}[^-]+)(\.[A-Za-z]{1,5})?$"),
            F.concat(F.lit("*"), F.regexp_extract(s, r"\.[A-Za-z]{1,5}$", 0)),
        ).otherwise(s),
    )


def _chance(bad: Column, known: Column, all_bad: Column, all_known: Column) -> Column:
    """How likely ``known`` labels drawn from all of them are as far off as ``bad`` bad ones, either way.

    The hypergeometric tail (Fisher's exact test), for branches of few labels.
    """
    def exactly(i: Column) -> Column:
        def factor(total: Column, j: Column) -> Column:
            drawn = F.when(j < i, (all_bad - j) * (known - j) / (j + 1)).otherwise(all_known - all_bad - (j - i))
            return total * drawn / (all_known - j)

        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), known - 1), F.lit(1.0), factor)

    def total(low: Column, high: Column) -> Column:
        return F.aggregate(F.sequence(low, high), F.lit(0.0), lambda t, i: t + exactly(i))

    return 2 * F.least(total(bad, known), total(F.lit(0).cast("bigint"), bad))


def _apart(bad: Column, known: Column, all_bad: Column, all_known: Column, siblings: Column) -> Column:
    """Whether a branch's share of bad labels differs from its siblings' beyond chance.

    The bar grows with the labelled branches, as the largest of many errors does. Few labels
    are judged by an exact test, many by their error.
    """
    rest, rest_bad = all_known - known, all_bad - bad
    share = F.try_divide(all_bad, all_known)
    error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1), known) + F.try_divide(F.lit(1), rest)))
    gap = F.abs(F.try_divide(bad, known) - F.try_divide(rest_bad, rest))
    bar = F.when(siblings <= SIBLINGS, F.lit(APART)).otherwise(F.sqrt(F.lit(APART**2) + 2 * F.log(siblings / SIBLINGS)))
    by_error = F.coalesce((error > 0) & (gap >= bar * error), F.lit(False))
    likely = CHANCE * F.least(F.lit(1.0), SIBLINGS / siblings)
    return F.when((known <= 0) | (rest <= 0), False).when(known <= FEW, _chance(bad, known, all_bad, all_known) <= likely).otherwise(by_error)


def _wild(segment: Column) -> Column:
    return F.when(segment.startswith("*"), segment).otherwise(F.lit("*"))


def templates(patterns: DataFrame) -> DataFrame:
    """(host, pattern, n, known, bad, template): which template of its host a pattern belongs to.

    Level by level; each level's branches and their parents are sums over patterns, so a
    host with very many URLs weighs no more than its patterns do. Where no branch can differ
    any more (labels all alike, or one pattern) all deeper levels are wildcards
    and are written at once, so a few very long paths cost no levels.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "known", "bad")]
    now, done, level = patterns.withColumn("template", F.lit("")), [], 0
    while True:
        level += 1
        all_ = now.filter(F.size("pattern") >= level).groupBy("host", "template").agg(
            *[F.sum(c).alias(f"all_{c}") for c in ("n", "known", "bad")], F.count(F.lit(1)).alias("patterns")
        )
        parent = stored(
            all_.filter((F.col("patterns") > 1) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_known"))),
            "url-parents",
        )
        closed = now.join(parent.select("host", "template"), ["host", "template"], "left_anti")
        rest = F.transform(F.slice("pattern", F.lit(level), F.greatest(F.size("pattern") - (level - 1), F.lit(0))), lambda s: F.concat(F.lit("/"), _wild(s)))
        done.append(stored(closed.withColumn("template", F.concat("template", F.array_join(rest, ""))).select(*now.columns), "url-closed"))
        if parent.isEmpty():
            break
        now = now.join(parent.select("host", "template"), ["host", "template"], "left_semi").withColumn("segment", F.get("pattern", F.lit(level - 1)))
        branch = stored(now.filter("segment IS NOT NULL").groupBy("host", "template", "segment").agg(*sums), "url-branches")
        siblings = branch.groupBy("host", "template").agg(F.count_if(F.col("known") > 0).alias("siblings"))
        own = _apart(F.col("bad"), F.col("known"), F.col("all_bad"), F.col("all_known"), F.col("siblings"))
        grown = branch.join(parent, ["host", "template"]).join(siblings, ["host", "template"]).select(
            "host", "template", "segment",
            F.concat("template", F.lit("/"), F.when(own, F.col("segment")).otherwise(_wild(F.col("segment")))).alias("grown"),
        )
        now = now.join(stored(grown, "url-grown"), ["host", "template", "segment"], "left")
        now = stored(now.withColumn("template", F.coalesce("grown", "template")).select(*patterns.columns, "template"), "url-templates")
        # Patterns that end here have no deeper level: they keep their template.
        done.append(now.filter(F.size("pattern") <= level))
        now = now.filter(F.size("pattern") > level)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return stored(out, "url-found")


def purities(found: DataFrame) -> DataFrame:
    """(host, template, purity): smoothed share of bad labels."""
    total = found.agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).collect()[0]
    known, bad = total["known"] or 0, total["bad"] or 0
    every = bad / known if known else 0.0
    leaf = found.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    host = found.groupBy("host").agg(F.sum("known").alias("host_known"), F.sum("bad").alias("host_bad"))
    prior = (F.col("host_bad") + WEIGHT * every) / (F.col("host_known") + WEIGHT)
    return leaf.join(stored(host, "url-hosts"), "host").select(
        "host", "template", ((F.col("bad") + WEIGHT * prior) / (F.col("known") + WEIGHT)).alias("purity")
    )


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), impure: float = IMPURE, url: str = "url"
) -> DataFrame:
    """``pages`` with columns host, path, rule, template, purity, verdict.

    ``labels`` is (page_id, bad): 1 for pages known to be bad, 0 for good ones, null or no
    row for unknown ones; a page labelled twice counts as bad if one label says so. The
    verdict is the rule's, else ``block`` for templates with a purity (share of bad) of
    ``impure`` or more, else ``allow``. Null urls and those without ``://`` have an empty
    host and path and are judged as the one template of the empty host. Without labels all
    are allowed. All other columns stay; those named as a result column are replaced.
    Repeated rows are judged alike; an empty table stays empty.
    """
    names = ("host", "path", "rule", "template", "purity", "verdict")
    address = F.col(url)
    parsed = pages.select(*[c for c in pages.columns if c not in names], host_of(address).alias("host"), path_of(address).alias("path"))
    parsed = parsed.withColumn("_pattern", pattern_of(F.col("path")))
    known = labels.filter(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("_bad"))
    judged = parsed.select("page_id", "host", F.col("_pattern").alias("pattern")).join(known, "page_id", "left")
    patterns = judged.groupBy("host", "pattern").agg(
        F.count(F.lit(1)).alias("n"), F.count("_bad").alias("known"), F.coalesce(F.sum("_bad"), F.lit(0)).cast("long").alias("bad")
    )
    found = templates(stored(patterns, "url-patterns"))
    verdicts = found.select("host", F.col("pattern").alias("_pattern"), "template").join(
        stored(purities(found), "url-purities"), ["host", "template"]
    )
    # A host may hold a third of all pages: its verdicts are repeated, its pages dealt out.
    spread = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = parsed.withColumn("_salt", F.pmod(F.xxhash64("page_id", url), F.lit(SALTS)).cast("int"))
    joined = dealt.join(stored(spread, "url-verdicts"), ["host", "_pattern", "_salt"], "left")
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    return joined.select(
        *[c for c in pages.columns if c not in names], "host", "path", rule.alias("rule"), "template", "purity",
        F.coalesce(said, F.when(F.col("purity") >= impure, "block").otherwise("allow")).alias("verdict"),
    )
