"""Schema drift: catalogs of fields, what changed, what uses it, and what that breaks.

A catalog is rows of (endpoint, object, sampled, field, type, length, required, required_by,
read_only). An object without fields has one row with a NULL field.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlink.functions.prefix import run_starts
from flowlink.session import stored

CATALOG = "endpoint string, object string, sampled boolean, field string, type string, length int, required boolean, required_by string, read_only boolean"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


# --- Discovery --------------------------------------------------------------------------


def _paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.StructField, str]]:
    """(dotted name, field, type) of a schema's fields, in depth."""
    out = []
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        if isinstance(kind, T.StructType):
            out += _paths(kind, path + ".")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out += [(path, f, "array"), *_paths(kind.elementType, path + "[].")]
        else:
            out.append((path, f, kind.simpleString()))
    return out


def _length(field: T.StructField) -> int:
    """The declared length of a text: char(n) or varchar(n), 0 if unbounded."""
    declared = str(field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", ""))
    found = re.fullmatch(r"(?:var)?char\((\d+)\)", declared) or re.fullmatch(r"(?:var)?char\((\d+)\)", field.dataType.simpleString())
    return int(found[1]) if found else int(field.metadata.get("length", 0))


def discover(df: DataFrame, endpoint: str, name: str) -> DataFrame:
    """Catalog rows of a table's declared schema; nested fields are dotted names.

    Lengths are those of char and varchar columns, or the field metadata's ``length``; a
    field is read-only if its metadata says ``read_only``.
    """
    rows = [
        (endpoint, name, False, path, kind, _length(f), not f.nullable, None, bool(f.metadata.get("read_only", False)))
        for path, f, kind in _paths(df.schema)
    ]
    return df.sparkSession.createDataFrame(rows, CATALOG)


def discover_links(df: DataFrame, endpoint: str, name: str) -> DataFrame:
    """(endpoint, object, field, key, link_to, link_field) of fields that are keys or links.

    From field metadata, where a reader keeps what a database declares: ``key``, and
    ``link`` as object.field or object.
    """
    rows = []
    for path, f, _ in _paths(df.schema):
        key, link = bool(f.metadata.get("key", False)), str(f.metadata.get("link", ""))
        if key or link:
            to, _, field = link.partition(".")
            rows.append((endpoint, name, path, key, to or None, field or None))
    schema = "endpoint string, object string, field string, key boolean, link_to string, link_field string"
    return df.sparkSession.createDataFrame(rows, schema)


def filled(df: DataFrame) -> DataFrame:
    """(field, rows, present) of a table's top-level columns, in one pass."""
    counts = [F.struct(F.lit(c).alias("field"), F.count(F.col(f"`{c}`")).alias("present")) for c in df.columns]
    totals = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*counts).alias("_fields"))
    return totals.select("rows", F.inline("_fields"))


def _json_type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    dated = text.rlike(RFC3339) & text.try_cast("timestamp").isNotNull()
    return (
        F.when(kind == "VOID", F.lit(None))
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", F.when(F.coalesce(dated, F.lit(False)), "datetime").otherwise("string"))
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def sample_fields(records: DataFrame, document: str, by: Sequence[str]) -> DataFrame:
    """Per top-level field of JSON text documents: the types seen, sorted, joined with |.

    A field that was always null has an empty type. The types of a field are combined before
    the shuffle: at most six per field and partition move.
    """
    fields = F.try_variant_get(F.try_parse_json(document), "$", "map<string,variant>")
    rows = records.select(*by, F.explode(fields).alias("field", "_value"))
    typed = rows.select(*by, "field", _json_type(F.col("_value")).alias("_type"))
    seen = typed.groupBy(*by, "field").agg(F.collect_set("_type").alias("_types"))
    return seen.select(*by, "field", F.array_join(F.array_sort("_types"), "|").alias("type"))


def digests(catalog: DataFrame) -> DataFrame:
    """A digest per endpoint of what it holds: objects and fields, in no order, no uses."""
    field = F.to_json(F.struct("field", "type", "length", "required", "required_by", "read_only"))
    objects = catalog.groupBy("endpoint", "object").agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set(F.concat(field, F.col("sampled").cast("string"))))), 256).alias("d")
    )
    text = F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("=", "object", "d"))))
    return objects.groupBy("endpoint").agg(F.sha2(text, 256).alias("digest"), F.count(F.lit(1)).alias("objects"))


def snapshots(checks: DataFrame) -> DataFrame:
    """Snapshots from checks (endpoint, checked_at number, digest): a new one only on a change.

    A snapshot is named by when it was taken; later checks with its digest extend it.
    """
    numbered = run_starts(checks, "checked_at", ["digest"], "taken_at", ["endpoint"])
    return numbered.groupBy("endpoint", "taken_at", "digest").agg(
        F.max("checked_at").alias("checked_at"), F.count(F.lit(1)).alias("checks")
    )


# --- Diff -------------------------------------------------------------------------------


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(endpoint, object, field, kind, old, new, breaking) of two catalogs."""
    keys = ["endpoint", "object"]
    o = old.groupBy(*keys).agg(F.max("sampled").alias("_os"))
    n = new.groupBy(*keys).agg(F.max("sampled").alias("_ns"))
    objects = o.join(n, keys, "full_outer")
    none = F.lit(None).cast("string")
    whole = objects.filter(F.col("_os").isNull() | F.col("_ns").isNull()).select(
        *keys, none.alias("field"),
        F.when(F.col("_ns").isNull(), "object-removed").otherwise("object-added").alias("kind"),
        none.alias("old"), none.alias("new"), F.col("_ns").isNull().alias("breaking"),
    )
    kept = objects.filter(F.col("_os").isNotNull() & F.col("_ns").isNotNull()).select(*keys, (F.col("_os") | F.col("_ns")).alias("_sampled"))
    detail = ["type", "length", "required", "required_by", "read_only"]

    def fields(df: DataFrame, prefix: str) -> DataFrame:
        rows = df.filter(F.col("field").isNotNull())
        return rows.select(*keys, "field", *[F.col(c).alias(prefix + c) for c in detail], F.lit(True).alias(prefix + "here"))

    both = fields(old, "o_").join(fields(new, "n_"), [*keys, "field"], "full_outer").join(kept, keys)
    c = F.col
    gone, added = c("n_here").isNull(), c("o_here").isNull()
    stays = ~gone & ~added

    def change(kind: str, test: Column, was: Column, now: Column, breaking: Column) -> Column:
        return F.when(
            test,
            F.struct(F.lit(kind).alias("kind"), was.cast("string").alias("old"), now.cast("string").alias("new"), breaking.alias("breaking")),
        )

    yes, no = F.lit(True), F.lit(False)
    text = lambda x: F.coalesce(c(x), F.lit(""))
    number = lambda x: F.coalesce(c(x), F.lit(0))
    flag = lambda x: F.coalesce(c(x), no)
    why = F.when(text("n_required_by") != "", F.concat_ws("; ", F.nullif(text("n_type"), F.lit("")), F.concat(F.lit("required: "), c("n_required_by")))).otherwise(c("n_type"))
    untyped = c("_sampled") & ((text("o_type") == "") | (text("n_type") == ""))
    changes = F.array_compact(
        F.array(
            change("field-added", added, none, why, flag("n_required")),
            change("field-not-seen", gone & c("_sampled"), c("o_type"), none, no),
            change("field-removed", gone & ~c("_sampled"), c("o_type"), none, yes),
            change("type-changed", stays & (text("o_type") != text("n_type")) & ~untyped, c("o_type"), c("n_type"), yes),
            change("became-required", stays & ~flag("o_required") & flag("n_required"), none, c("n_required_by"), yes),
            change("no-longer-required", stays & flag("o_required") & ~flag("n_required"), none, none, no),
            change(
                "length-shrunk",
                stays & (number("n_length") > 0) & ((number("o_length") == 0) | (number("n_length") < number("o_length"))),
                number("o_length"), number("n_length"), yes,
            ),
            change("became-read-only", stays & ~flag("o_read_only") & flag("n_read_only"), none, none, yes),
        )
    )
    return both.select(*keys, "field", F.inline(changes)).unionByName(whole)


# --- Usage ------------------------------------------------------------------------------


def mapped_objects(maps: DataFrame, endpoints: DataFrame, catalog: DataFrame, events: DataFrame) -> DataFrame:
    """(endpoint, object, mapping, target, expression): which object each mapping reads.

    ``maps`` is (source, trigger_endpoint, trigger_event, mapping, target, expression) with
    ``source`` as system.entity, the system being an endpoint or a connector; ``endpoints``
    is (endpoint, connector), ``events`` (endpoint, event, object). A mapping reads the
    object its entity names; where the endpoint has none of that name, the object that the
    records of its workflow's triggering event come from, if the event is that endpoint's.
    Mappings of other systems, and those whose object isn't in the catalog, read nothing.
    """
    objects = catalog.select("endpoint", "object").distinct()
    named = maps.filter(F.instr("source", ".") > 0).withColumns(
        {"system": F.substring_index("source", ".", 1), "entity": F.expr("substring(source, instr(source, '.') + 1)")}
    )
    systems = endpoints.select("endpoint", F.explode(F.array_distinct(F.array("endpoint", "connector"))).alias("system")).distinct()
    of = named.join(systems, "system").join(
        objects.select("endpoint", F.col("object").alias("entity"), F.lit(True).alias("_direct")), ["endpoint", "entity"], "left"
    )
    direct = of.filter("_direct").withColumn("object", F.col("entity"))
    through = of.filter(F.col("_direct").isNull() & (F.col("trigger_endpoint") == F.col("endpoint"))).join(
        events.select("endpoint", F.col("event").alias("trigger_event"), "object"), ["endpoint", "trigger_event"]
    ).join(objects, ["endpoint", "object"], "left_semi")
    columns = ["endpoint", "object", "mapping", "target", "expression"]
    return direct.select(*columns).unionByName(through.select(*columns))


def field_usage(mappings: DataFrame, catalog: DataFrame, uses: DataFrame) -> DataFrame:
    """(endpoint, object, field, consumer): what reads each field.

    Declared uses, and mappings (endpoint, object, mapping, target, expression) whose
    expression names a field the object has.
    """
    names = F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(f"({IDENTIFIER})"), F.lit(1))))
    read = mappings.select("endpoint", "object", "mapping", "target", names.alias("field"))
    known = catalog.select("endpoint", "object", "field").filter(F.col("field").isNotNull()).distinct()
    mapped = read.join(known, ["endpoint", "object", "field"], "left_semi").select(
        "endpoint", "object", "field", F.format_string("mapping %s (%s)", "mapping", "target").alias("consumer")
    )
    return mapped.unionByName(uses.select("endpoint", "object", "field", "consumer")).distinct()


def union_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Usage of either catalog, so a field the new one lacks is still known to be read."""
    return old.unionByName(new).distinct()


def missing_uses(uses: DataFrame, catalog: DataFrame) -> DataFrame:
    """Used objects and fields the catalog lacks, with their users; sampled: only not seen."""
    objects = catalog.groupBy("endpoint", "object").agg(F.max("sampled").alias("sampled"))
    fields = catalog.filter(F.col("field").isNotNull()).select("endpoint", "object", "field").distinct()
    no_object = uses.join(objects, ["endpoint", "object"], "left_anti").select(
        "endpoint", "object", F.lit(None).cast("string").alias("field"), F.lit(False).alias("sampled"), "consumer"
    )
    no_field = (
        uses.filter(F.col("field").isNotNull())
        .join(objects, ["endpoint", "object"])
        .join(fields, ["endpoint", "object", "field"], "left_anti")
        .select("endpoint", "object", "field", "sampled", "consumer")
    )
    found = no_object.unionByName(no_field)
    return found.groupBy("endpoint", "object", "field", "sampled").agg(F.array_sort(F.collect_set("consumer")).alias("used_by"))


def annotate(changes: DataFrame, usage: DataFrame, creators: DataFrame) -> DataFrame:
    """Changes with ``used_by`` and ``breaks``: a breaking change something here relies on.

    An object's change concerns the users of any of its fields; a newly required field also
    what creates the object's records.
    """
    keys = ["endpoint", "object"]
    by_field = usage.filter(F.col("field").isNotNull()).groupBy(*keys, "field").agg(F.collect_set("consumer").alias("_field_users"))
    by_object = usage.groupBy(*keys).agg(F.collect_set("consumer").alias("_object_users"))
    written = creators.groupBy(*keys).agg(F.collect_set("consumer").alias("_creators"))
    none = F.array().cast("array<string>")
    joined = changes.join(by_field, [*keys, "field"], "left").join(by_object, keys, "left").join(written, keys, "left")
    users = F.when(F.col("field").isNull(), F.col("_object_users")).otherwise(F.col("_field_users"))
    users = F.coalesce(users, none)
    makers = F.when(
        F.col("breaking") & F.col("kind").isin("field-added", "became-required"),
        F.transform(
            F.array_except(F.coalesce("_creators", none), users),
            lambda b: F.when(b.endswith(" (writes)"), b).otherwise(F.concat(b, F.lit(" (writes)"))),
        ),
    )
    used = F.array_sort(F.array_distinct(F.concat(users, F.coalesce(makers, none))))
    return joined.withColumn("used_by", used).withColumn("breaks", F.col("breaking") & (F.size("used_by") > 0)).drop(
        "_field_users", "_object_users", "_creators"
    )


def sort_changes(changes: DataFrame) -> DataFrame:
    """All changes with their ``place`` on their endpoint's list.

    Changes that can break a run come first, then by object, field and kind. An endpoint's
    list is what a reader sees, so places count within it.
    """
    order = Window.partitionBy("endpoint").orderBy(F.desc("breaks"), "object", F.asc_nulls_first("field"), "kind")
    return changes.withColumn("place", F.row_number().over(order))


def overview(catalog: DataFrame, snapshot_counts: DataFrame, changes: DataFrame, missing: DataFrame) -> DataFrame:
    """Per endpoint: snapshots, objects, fields, changes, breaking changes and missing uses."""
    held = catalog.groupBy("endpoint").agg(F.count_distinct("object").alias("objects"), F.count("field").alias("fields"))
    moved = changes.groupBy("endpoint").agg(F.count(F.lit(1)).alias("changes"), F.count_if("breaks").alias("breaking"))
    lacking = missing.groupBy("endpoint").agg(F.count(F.lit(1)).alias("missing"))
    out = held.join(snapshot_counts, "endpoint", "left").join(moved, "endpoint", "left").join(lacking, "endpoint", "left")
    return out.na.fill(0)


# --- Learned requirements ---------------------------------------------------------------

# Fixed patterns: what APIs say about a field a request must send.
REQUIRED_WORDS = (
    r"(?i)\b(required|missing|mandatory|can'?t be blank|cannot be blank|must be present|must be provided|"
    r"must not be (empty|null|blank)|may not be (empty|null|blank))\b"
)
MESSAGE_PATTERNS = (
    r"(?i)missing required (?:param(?:eter)?|field|property|attribute)s?:?\s*['\"]?([A-Za-z_][\w.\[\]]*)",
    r"(?i)required (?:param(?:eter)?|field|property|attribute) ['\"]?([A-Za-z_][\w.\[\]]*)['\"]? (?:is )?missing",
    r"(?i)['\"]([A-Za-z_][\w.\[\]]*)['\"] (?:is|are) (?:a )?required",
    r"(?i)\b([A-Za-z_][\w.\[\]]*) (?:is|are) (?:a )?required (?:field|property|param(?:eter)?|attribute)",
)
FIELD_KEYS = ("param", "field", "property", "propertyName", "path", "attribute")
MESSAGE_KEYS = ("message", "reason", "detail", "code", "type", "description", "error", "title")
NOT_FIELDS = ("message", "type", "code", "detail", "title", "status")
WRAPPERS = ("", "body", "data", "attributes")


def _top_level(name: Column) -> Column:
    """The first part of a[b], a.b or /a/b."""
    return F.regexp_extract(F.regexp_replace(name, r"^/", ""), r"^([^\[./]*)", 1)


def _said(node: Column, key: str) -> Column:
    """A member's text, if the member is a text."""
    member = node[key]
    return F.when(F.schema_of_variant(member) == "STRING", member.cast("string"))


def _named_field(node: Column) -> Column:
    """The field an error object names, when its messages say it is required."""
    messages = F.concat_ws(" ", *[F.translate(_said(node, k), "_", " ") for k in MESSAGE_KEYS])
    named = F.coalesce(*[F.nullif(_said(node, k), F.lit("")) for k in FIELD_KEYS])
    name = F.nullif(_said(node, "name"), F.lit(""))
    mentioned = F.when(F.map_contains_key(node, "reason") | messages.contains(name), name)
    pointer = _said(F.try_variant_get(node["source"], "$", "map<string,variant>"), "pointer")
    pointer = F.regexp_replace(F.regexp_replace(pointer, "^/data/attributes", ""), "^/", "")
    return F.when(messages.rlike(REQUIRED_WORDS), F.coalesce(named, mentioned, pointer))


def _field_map(value: Column) -> Column:
    """The entries of {"email": ["can't be blank"]}: fields with their messages; else NULL."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    other = F.exists(entries, lambda e: e["key"].isin(*NOT_FIELDS) | ~F.schema_of_variant(e["value"]).rlike("^(STRING|ARRAY)"))
    return F.when((F.size(entries) > 0) & ~other, entries)


def required_fields(refusals: DataFrame, error: str = "error") -> DataFrame:
    """``refusals`` with ``fields``: sorted names a refusal ("... HTTP 422: <body>") says were lacking.

    Only 400 and 422 count. Error objects and maps of fields to messages are found at any
    depth of the body, messages naming a field anywhere in its text. Equal refusals are read
    once; their bodies are walked level by level, as rows, until none has anything left.
    """
    status = F.regexp_extract(error, r"HTTP (\d{3}): ", 1)
    texts = refusals.filter(status.isin("400", "422")).select(F.col(error).alias("_error")).distinct()
    body = F.regexp_extract("_error", r"(?s)HTTP \d{3}: (.*)$", 1)
    named = [F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in MESSAGE_PATTERNS]
    found = texts.select("_error", F.explode(F.concat(*named)).alias("field"))
    level = texts.select("_error", F.try_parse_json(body).alias("node"))
    while True:
        object_ = F.try_variant_get("node", "$", "map<string,variant>")
        items = F.try_variant_get("node", "$", "array<variant>")
        parsed = level.select("_error", object_.alias("object"), items.alias("items")).filter("object IS NOT NULL OR items IS NOT NULL")
        parsed = stored(parsed.select("_error", "object", F.col("items")), "refusals")
        if parsed.isEmpty():
            break
        listed = F.map_entries("object")
        maps = F.filter(listed, lambda e: e["key"].isin("errors", "error") & _field_map(e["value"]).isNotNull())
        told = F.filter(F.flatten(F.transform(maps, lambda e: _field_map(e["value"]))), lambda e: F.to_json(e["value"]).rlike(REQUIRED_WORDS))
        names = F.concat(F.array_compact(F.array(_named_field(F.col("object")))), F.transform(told, lambda e: e["key"]))
        found = found.unionByName(parsed.filter("object IS NOT NULL").select("_error", F.explode(names).alias("field")))
        rest = F.filter(listed, lambda e: ~(e["key"].isin("errors", "error") & _field_map(e["value"]).isNotNull()))
        level = parsed.select("_error", F.explode(F.coalesce("items", F.transform(rest, lambda e: e["value"]))).alias("node"))
    kept = found.select("_error", _top_level(F.col("field")).alias("field")).filter(F.col("field").isNotNull() & ~F.col("field").isin(*WRAPPERS))
    per_text = kept.groupBy("_error").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    out = refusals.join(per_text, F.col(error) == F.col("_error"), "left").drop("_error")
    return out.withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))


def learn(catalog: DataFrame, refusals: DataFrame) -> DataFrame:
    """The catalog with fields learned from refusals (endpoint, object, operation, error, day).

    Only sampled objects learn; a field no sampled record had is added. A field keeps the
    first reason it was given.
    """
    rows = required_fields(refusals).select("endpoint", "object", "operation", "day", F.explode("fields").alias("field"))
    why = F.format_string("operation %s was refused without it on %s", "operation", "day")
    lessons = rows.groupBy("endpoint", "object", "field").agg(F.min_by(why, F.struct("day", "operation")).alias("_why"))
    sampled = catalog.filter("sampled").select("endpoint", "object").distinct()
    lessons = lessons.join(sampled, ["endpoint", "object"], "left_semi")
    out = catalog.join(lessons, ["endpoint", "object", "field"], "full_outer")
    new = F.col("_why").isNotNull() & ~F.coalesce("required", F.lit(False))
    return out.select(
        "endpoint", "object", F.coalesce("sampled", F.lit(True)).alias("sampled"), "field", F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("length", F.lit(0)).alias("length"), (F.coalesce("required", F.lit(False)) | F.col("_why").isNotNull()).alias("required"),
        F.when(new, F.col("_why")).otherwise(F.col("required_by")).alias("required_by"), F.coalesce("read_only", F.lit(False)).alias("read_only"),
    )


def keep_required(previous: DataFrame, following: DataFrame) -> DataFrame:
    """The next catalog with what the previous one knew to be required in sampled objects.

    A sample cannot show that a field stopped being required, nor must records carry it.
    """
    known = previous.filter("sampled AND required AND field IS NOT NULL").select(
        "endpoint", "object", "field", *[F.col(c).alias(f"_{c}") for c in ("type", "length", "required_by", "read_only")]
    )
    sampled = following.filter("sampled").select("endpoint", "object").distinct()
    known = known.join(sampled, ["endpoint", "object"], "left_semi").withColumn("_known", F.lit(True))
    out = following.join(known, ["endpoint", "object", "field"], "full_outer")
    gains = F.col("_known").isNotNull() & ~F.coalesce("required", F.lit(False))
    absent = F.col("sampled").isNull()
    pick = lambda c: F.when(absent, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return out.select(
        "endpoint", "object", F.coalesce("sampled", F.lit(True)).alias("sampled"), "field", pick("type"), pick("length"),
        (F.coalesce("required", F.lit(False)) | F.col("_known").isNotNull()).alias("required"),
        F.when(gains, F.col("_required_by")).otherwise(F.col("required_by")).alias("required_by"), pick("read_only"),
    )


# --- Capacity ---------------------------------------------------------------------------


def capacity(events: DataFrame, limits: DataFrame, headroom: float = 0.8) -> DataFrame:
    """Peak events per second and target against its declared limit: error, warning or ok."""
    second = events.groupBy("target", F.floor(F.col("at_ms") / 1000).alias("second")).agg(F.count(F.lit(1)).alias("n"))
    peak = second.groupBy("target").agg(F.max("n").alias("peak"))
    level = F.when(F.col("peak") > F.col("limit"), "error").when(F.col("peak") > F.col("limit") * headroom, "warning").otherwise("ok")
    return peak.join(limits, "target").withColumn("level", level)
