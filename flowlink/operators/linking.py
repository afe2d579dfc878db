"""Cross-references: exact resolution, fallback names, link tables and bulk loads.

A cross-reference row links a source record to a master record:
(entity, system, source_id, master_id, attributes).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlink.operators import matching as M
from flowlink.operators.inbox import first_by
from flowlink.session import stored

KEY = ("entity", "system", "source_id")


def resolve_exact(docs: DataFrame, xref: DataFrame, entity: str, system: str, ref: str, into: str) -> DataFrame:
    """Documents with the master their reference is linked to, NULL where there is none.

    One row per link, so documents keep their number; a reference that many documents
    share skews only the document side, which adaptive execution splits.
    """
    links = xref.filter((F.col("entity") == entity) & (F.col("system") == system)).select(
        F.col("source_id").alias(ref), F.col("master_id").alias(into)
    )
    return docs.join(links, ref, "left")


def resolve_with_fallback(
    docs: DataFrame, xref: DataFrame, entity: str, system: str, old_system: str, ref: str, into: str
) -> DataFrame:
    """Resolution by the system's name, else by the name its links were once kept under.

    Both names are brought to one row per record first, so documents are joined once.
    """
    named = xref.filter((F.col("entity") == entity) & F.col("system").isin(system, old_system))
    links = named.groupBy(F.col("source_id").alias(ref)).agg(
        F.max(F.when(F.col("system") == system, F.col("master_id"))).alias("_new"),
        F.max(F.when(F.col("system") == old_system, F.col("master_id"))).alias("_old"),
    )
    return docs.join(
        links.select(ref, F.coalesce("_new", "_old").alias(into), (F.col("_new").isNull()).alias("moved")), ref, "left"
    ).withColumn("moved", F.coalesce("moved", F.lit(False)))


def move_links(xref: DataFrame, entity: str, system: str, old_system: str, refs: DataFrame) -> DataFrame:
    """The cross-reference after links read under the old name moved to the new one.

    ``refs`` has the source_ids read. A link the new name already has is kept; the old one
    of a record read goes in either case only when it was missed under the new name.
    """
    ours = (F.col("entity") == entity) & F.col("system").isin(system, old_system)
    rest = xref.filter(~ours)
    wanted = refs.select("source_id").distinct().withColumn("_read", F.lit(True))
    # A record has at most a row per name: both in one row, then at most two rows out.
    grouped = xref.filter(ours).groupBy("entity", "source_id").agg(
        F.max(F.when(F.col("system") == system, F.struct("master_id"))).alias("_new"),
        F.max(F.when(F.col("system") == old_system, F.struct("master_id"))).alias("_old"),
    )
    marked = grouped.join(wanted, "source_id", "left")
    moves = F.col("_read").isNotNull() & F.col("_new").isNull()
    kept = F.array_compact(
        F.array(
            F.when(F.col("_new").isNotNull(), F.struct(F.lit(system).alias("system"), F.col("_new.master_id").alias("master_id"))),
            F.when(
                F.col("_old").isNotNull(),
                F.struct(F.when(moves, F.lit(system)).otherwise(F.lit(old_system)).alias("system"), F.col("_old.master_id").alias("master_id")),
            ),
        )
    )
    moved = marked.select("entity", "source_id", F.inline(kept))
    return rest.select(*KEY, "master_id").unionByName(moved.select(*KEY, "master_id"))


def skip_unknown(resolved: DataFrame, ref: str, into: str) -> tuple[DataFrame, DataFrame]:
    """(documents to go on with, skipped references with the reason)."""
    known = resolved.filter(F.col(into).isNotNull())
    skipped = resolved.filter(F.col(into).isNull()).drop(into)
    return known, skipped.withColumn("reason", F.concat(F.lit("unknown "), F.lit(ref)))


def upsert_links(xref: DataFrame, links: DataFrame) -> DataFrame:
    """The cross-reference with links put in: the master replaced, attributes kept where
    the new link brings none."""
    old = xref.select(*KEY, F.col("master_id").alias("_m"), F.col("attributes").alias("_a"))
    both = links.select(*KEY, "master_id", "attributes").join(old, list(KEY), "full_outer")
    empty = F.col("attributes").isNull() | (F.size("attributes") == 0)
    return both.select(
        *KEY, F.coalesce("master_id", "_m").alias("master_id"), F.when(empty, F.coalesce("_a", "attributes")).otherwise(F.col("attributes")).alias("attributes")
    )


def delete_links(xref: DataFrame, links: DataFrame) -> DataFrame:
    """The cross-reference without links that still lead to the given master."""
    keys = [*KEY, "master_id"]
    return xref.join(links.select(*keys), keys, "left_anti")


def link_writes(writes: DataFrame, entity: str, system: str, result_id: Column, master: Column) -> DataFrame:
    """A cross-reference row per write, from the id in its result and its document's master.

    Both must be a string or a number; ``error`` says where one is not.
    """
    missing = (F.coalesce(result_id.cast("string"), F.lit("")) == "") | (F.coalesce(master.cast("string"), F.lit("")) == "")
    return writes.select(
        F.lit(entity).alias("entity"),
        F.lit(system).alias("system"),
        result_id.cast("string").alias("source_id"),
        master.cast("string").alias("master_id"),
        F.when(missing, F.lit("the result has no id or the document no master")).alias("error"),
    )


# --- Bulk link loads --------------------------------------------------------------------


def last_links(proposed: DataFrame, order: str = "seq") -> DataFrame:
    """One proposed link per source record: the last one given."""
    return first_by(proposed, ["source_id"], F.col(order), last=True)


def compare_links(proposed: DataFrame, xref: DataFrame, entity: str, system: str, replace: bool = False) -> DataFrame:
    """Proposed links against current ones: added, unchanged, replaced or conflict.

    ``writes`` marks links to write: an unchanged one only for new attributes. A link to
    another master is a steward's decision and stays unless ``replace``.
    """
    current = xref.filter((F.col("entity") == entity) & (F.col("system") == system)).select(
        "source_id", F.col("master_id").alias("linked"), F.col("attributes").alias("known")
    )
    joined = proposed.join(current, "source_id", "left")
    status = (
        F.when(F.col("linked").isNull(), "added")
        .when(F.col("linked") == F.col("master_id"), "unchanged")
        .otherwise("replaced" if replace else "conflict")
    )

    def sorted_entries(c: str) -> Column:
        return F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))))

    fresh = (F.size(F.coalesce("attributes", F.create_map().cast("map<string,string>"))) > 0) & (
        sorted_entries("attributes") != sorted_entries("known")
    )
    return joined.withColumn("status", status).withColumn(
        "writes", F.when(F.col("status") == "unchanged", fresh).otherwise(F.col("status") != "conflict")
    )


def _no_attributes() -> Column:
    return F.create_map().cast("map<string,string>")


def link_digest(links: Column) -> Column:
    """An aggregate naming a set of texts, whatever their order or partitioning.

    The sum of 60-bit pieces of each text's SHA-256, as a decimal: sums merge in any order.
    """
    piece = F.conv(F.substring(F.sha2(links, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sum(piece).cast("string")


class LinkLoad(NamedTuple):
    """A planned load: ``merged`` has the system's links after it, one row per record, with
    each row's status (kept, added, unchanged, replaced, conflict); ``skipped`` counts rows
    read and left out."""

    merged: DataFrame
    skipped: DataFrame


def plan_load(
    export: DataFrame,
    xref: DataFrame,
    entity: str,
    system: str,
    source: str,
    master: str,
    match: list[tuple[str, str]],
    order: str = "seq",
    replace: bool = False,
) -> LinkLoad:
    """A bulk load of links from exported records, with their identifying attributes.

    Rows without a source or master are skipped and counted. One full join with the
    system's current links gives both what the load does and the table it leaves, so a
    caller writes ``merged`` once (the system's partition of the cross-reference) and
    counts what it wrote; a dry run only counts.
    """
    master_text = F.trim(F.col(master))
    no_source = F.coalesce(F.col(source), F.lit("")) == ""
    no_master = F.coalesce(master_text, F.lit("")) == ""
    skipped = export.agg(
        F.count(F.lit(1)).alias("read"), F.count_if(no_source).alias("without_source"),
        F.count_if(~no_source & no_master).alias("without_master"),
    )
    usable = export.filter(~no_source & ~no_master)
    proposed = M.extract_attributes(usable, match).select(
        F.col(source).alias("source_id"), master_text.alias("proposed"), M.attributes_map().alias("_new"), order
    )
    current = xref.filter((F.col("entity") == entity) & (F.col("system") == system)).select(
        "source_id", F.col("master_id").alias("linked"), F.col("attributes").alias("_known")
    )
    both = last_links(proposed, order).join(current, "source_id", "full_outer")
    status = (
        F.when(F.col("proposed").isNull(), "kept")
        .when(F.col("linked").isNull(), "added")
        .when(F.col("linked") == F.col("proposed"), "unchanged")
        .otherwise("replaced" if replace else "conflict")
    )
    brings = F.coalesce(F.size("_new"), F.lit(0)) > 0
    entries = lambda c: F.array_sort(F.map_entries(F.coalesce(c, _no_attributes())))
    fresh = brings & (entries("_new") != entries("_known"))
    writes = F.when(F.col("status") == "unchanged", fresh).otherwise(F.col("status").isin("added", "replaced"))
    marked = both.withColumn("status", status).withColumn("writes", writes)
    merged = marked.select(
        F.lit(entity).alias("entity"), F.lit(system).alias("system"), "source_id",
        F.when(F.col("status").isin("added", "replaced"), F.col("proposed")).otherwise(F.col("linked")).alias("master_id"),
        F.when(F.col("writes") & brings, F.col("_new")).otherwise(F.coalesce("_known", _no_attributes())).alias("attributes"),
        "status", "writes", "proposed", "linked",
    )
    return LinkLoad(merged, skipped)


def load_counts(load: LinkLoad, merged: DataFrame | None = None) -> DataFrame:
    """One row: read, skipped, added, unchanged, replaced, conflicts, written, and a digest
    of the links made. ``merged`` may be the written table, so nothing is computed twice."""
    rows = load.merged if merged is None else merged
    n = lambda status: F.count_if(F.col("status") == status).alias(status)
    made = ~F.col("status").isin("conflict", "kept")
    counts = rows.agg(
        n("added"), n("unchanged"), n("replaced"), n("conflict"), F.count_if("writes").alias("written"),
        link_digest(F.when(made, F.concat_ws("\t", "source_id", "proposed"))).alias("digest"),
    )
    names = ("read", "without_source", "without_master")
    return counts.withColumns({c: load.skipped.select(c).scalar() for c in names})


def load_conflicts(merged: DataFrame) -> DataFrame:
    """Records left at another master: (source_id, linked, proposed)."""
    return merged.filter(F.col("status") == "conflict").select("source_id", "linked", "proposed")


def load_changes(merged: DataFrame) -> DataFrame:
    """The links a load has to write."""
    return merged.filter("writes").select(*KEY, "master_id", "attributes")


# --- Resolution end to end --------------------------------------------------------------


class Resolution(NamedTuple):
    """Resolved documents, links made on the way, and references that need a steward."""

    resolved: DataFrame
    links: DataFrame
    unresolved: DataFrame


def resolve(
    docs: DataFrame,
    xref: DataFrame,
    entity: str,
    system: str,
    ref: str,
    into: str,
    match: list[tuple[str, str]],
    threshold: float = 0.95,
    model: M.Model = M.DEFAULT_MODEL,
    probabilistic: bool = True,
) -> Resolution:
    """Documents linked to masters: exactly, else by a certain match, else not at all.

    References are matched once, however many documents carry one: a reference's
    attributes are those of its first document. ``links`` has the audit's score and
    reasons; ``unresolved`` has up to three suggestions per reference.
    """
    known = resolve_exact(docs, xref, entity, system, ref, "_exact")
    missed = known.filter(F.col("_exact").isNull() & F.col(ref).isNotNull())
    first = first_by(M.extract_attributes(missed.select(ref, *{c for c, _ in match} - {ref}), match), [ref], F.struct("email", "name", "domain"))
    records = first.select(F.lit(entity).alias("entity"), F.col(ref).alias("record_id"), *M.ATTRIBUTES)
    candidates = M.with_attributes(xref.filter(F.col("entity") == entity)).select("entity", "source_id", "master_id", *M.ATTRIBUTES)
    # Three results read the references and their suggestions: both are found once.
    records = stored(records, "references")
    suggested = stored(M.suggest(records, candidates, model), "suggestions")
    certain = M.decide(suggested, threshold)
    if not probabilistic:
        certain = certain.filter(F.lit(False))
    matched = certain.select(F.col("record_id").alias(ref), F.col("master_id").alias("_matched"))
    out = known.join(matched, ref, "left").withColumn(into, F.coalesce("_exact", "_matched")).drop("_exact", "_matched")
    attributes = records.select("record_id", M.attributes_map().alias("attributes"))
    links = certain.join(attributes, "record_id").select(
        "entity", F.lit(system).alias("system"), F.col("record_id").alias("source_id"), "master_id", "attributes", "score", "reasons"
    )
    offers = suggested.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "master_id", "score", "reasons"))).alias("suggestions")
    )
    waiting = records.join(certain.select("record_id"), "record_id", "left_anti").join(offers, "record_id", "left")
    return Resolution(out, links, waiting.select("entity", F.lit(system).alias("system"), F.col("record_id").alias("ref"), M.attributes_map().alias("attributes"), "suggestions"))
