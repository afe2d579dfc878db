"""Messages of business systems: change events, change pointers, segments, cloud events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlink.functions.joins import small
from flowlink.functions.prefix import run_starts
from flowlink.session import stored

# --- Change events covering several records ---------------------------------------------


def fan_out(
    events: DataFrame,
    fields: Sequence[str],
    change_types: Sequence[str] = (),
    match: Mapping[str, object] | None = None,
) -> DataFrame:
    """One event per record a change covers, with the fields it set.

    ``events`` has event_id, change_type, record_ids, nulled_fields and typed field
    columns. NULL fields were left alone, unless ``nulled_fields`` names them (by their
    first path part). Match values are compared on present fields only.
    """
    rows = events
    if change_types:
        rows = rows.filter(F.upper("change_type").isin(*[c.upper() for c in change_types]))
    nulled = F.transform(
        F.coalesce(F.col("nulled_fields"), F.array().cast("array<string>")), lambda f: F.substring_index(f, ".", 1)
    )
    for field, wanted in (match or {}).items():
        present = F.col(field).isNotNull() | F.array_contains(nulled, field)
        rows = rows.filter(present & F.col(field).eqNullSafe(F.lit(wanted)))
    values = F.create_map(*[v for f in fields for v in (F.lit(f), F.col(f).cast("string"))])
    rows = rows.withColumn("changed", F.map_filter(values, lambda k, v: v.isNotNull() | F.array_contains(nulled, k)))
    rows = rows.withColumn("_n", F.size("record_ids")).select("*", F.posexplode("record_ids").alias("_i", "record_id"))
    name = F.when(F.col("_n") > 1, F.concat_ws(".", "event_id", F.col("_i").cast("string"))).otherwise(F.col("event_id"))
    return rows.withColumn("event_id", name).drop("_n", "_i", "record_ids")


def bitmap_fields(bitmaps: Column, fields: Sequence[str], nested: Mapping[int, Sequence[str]] | None = None) -> Column:
    """Field names of ``0x..`` bitmaps (bit i is field i) and ``p-0x..`` (fields of field p).

    Works digit by digit, so a record may have any number of fields.
    """

    def names(digits: Column, within: Sequence[str], prefix: str = "") -> Column:
        backwards = F.reverse(digits)
        chosen = []
        for i, name in enumerate(within):
            digit = F.conv(F.substr(backwards, F.lit(i // 4 + 1), F.lit(1)), 16, 10).try_cast("int")
            chosen.append(F.when(digit.bitwiseAND(F.lit(1 << (i % 4))) != 0, F.lit(prefix + name)))
        return F.array_compact(F.array(*chosen)) if chosen else F.array().cast("array<string>")

    def one(item: Column) -> Column:
        text = F.lower(item)
        out = F.when(text.rlike("^0x[0-9a-f]+$"), names(F.substr(text, F.lit(3)), fields))
        for position, inner in (nested or {}).items():
            digits = F.regexp_extract(text, rf"^{position}-0x([0-9a-f]+)$", 1)
            out = out.when(text.rlike(rf"^{position}-0x[0-9a-f]+$"), names(digits, inner, f"{fields[position]}."))
        return F.coalesce(out, F.array().cast("array<string>"))

    return F.flatten(F.transform(bitmaps, one))


# --- Change pointers --------------------------------------------------------------------

DOCUMENT = ("object_class", "object_id", "change_number")


def settled_pointers(pointers: DataFrame, after: int, settled_ms: int) -> DataFrame:
    """Pointers above the cursor up to the first unsettled one (a lower number may still commit)."""
    above = pointers.filter(F.col("number") > after)
    open_from = above.filter(F.col("created_ms") > settled_ms).agg(F.min("number").alias("n"))
    stop = open_from.select(F.coalesce("n", F.lit((1 << 63) - 1)))
    return above.filter(F.col("number") < stop.scalar())


def pointer_changes(pointers: DataFrame) -> DataFrame:
    """Pointers with the event they belong to: consecutive ones of one change document.

    Events are named by their first number. Numbers are cut into blocks of 65,536; each
    block finds its own starts and one row per block carries the last start over, so no
    task sees more than a block, however long an event is.
    """
    return run_starts(pointers, "number", DOCUMENT, "first_number")


def pointer_events(changes: DataFrame) -> DataFrame:
    """One event per change document; its changes stay rows of ``pointer_changes``."""
    return changes.groupBy("first_number", *DOCUMENT).agg(
        F.max("number").alias("position"),
        F.count(F.lit(1)).alias("changes"),
        F.min("created_ms").alias("changed_ms"),
        F.min_by("changed_by", "number").alias("changed_by"),
    )


# --- Fixed-width segments ---------------------------------------------------------------


def segment_definitions(definition: DataFrame) -> DataFrame:
    """One row per segment type with its fields; offsets count from its first field."""
    return definition.groupBy("segment").agg(
        F.min("offset").alias("base"),
        F.array_sort(F.collect_list(F.struct("offset", "field", "length"))).alias("fields"),
    ).select(
        "segment",
        F.transform("fields", lambda f: F.struct(
            f["field"].alias("field"), (f["offset"] - F.col("base")).alias("offset"), f["length"].alias("length")
        )).alias("fields"),
    )


def parse_segments(data: DataFrame, definition: DataFrame) -> DataFrame:
    """Segment rows with their fields as a map: values trimmed, empty ones dropped.

    The definition is one row per segment type; the map is built inside the row, without
    a shuffle of the data.
    """
    joined = data.join(small(segment_definitions(definition)), F.trim("segnam") == F.col("segment"), "left")
    entries = F.transform(
        F.coalesce("fields", F.array().cast("array<struct<field:string,offset:int,length:int>>")),
        lambda f: F.struct(
            f["field"].alias("key"), F.trim(F.substr(F.col("sdata"), f["offset"] + 1, f["length"])).alias("value")
        ),
    )
    kept = F.filter(entries, lambda e: e["value"] != "")
    return joined.withColumn("fields", F.map_from_entries(kept)).withColumn("segment", F.trim("segnam"))


def _parents(numbered: DataFrame) -> DataFrame:
    """(docnum, _pos, _up): the place of the segment that each one hangs below, if any."""
    group = Window.partitionBy("docnum", "_number").orderBy("_pos", "_named")
    named = numbered.select("docnum", "_pos", F.col("_own_number").alias("_number"), F.col("_own").alias("_text"), F.lit(1).alias("_named"))
    asking = numbered.filter("_parent <> ''").select("docnum", "_pos", F.col("_parent").alias("_number"), F.lit(None).cast("string").alias("_text"), F.lit(0).alias("_named"))
    so_far = group.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("_text", ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, 0))
    both = named.unionByName(asking).withColumn("_first", first)
    up = F.last(F.when(F.col("_text") == F.col("_first"), F.col("_pos")), ignorenulls=True).over(so_far)
    return both.withColumn("_up", up).filter("_named = 0").select("docnum", "_pos", "_up")


IN_A_ROW = 64  # segments of a document that is placed inside a row


def segment_tree(segments: DataFrame) -> DataFrame:
    """One row per segment with its place in its document's tree: level, path, parent_path.

    A segment hangs below an earlier one whose number (leading zeros aside) its parent
    number names, at any depth; without a parent, or with an unknown one, it is at the top,
    level 1. Where several earlier ones have that number as the same text, the latest takes
    the children; where as different texts, those of the text that came first. A segment
    that names itself hangs below an earlier namesake, or is at the top. A path is the
    numbers from the top down, with ``/`` before each.

    Documents of up to ``IN_A_ROW`` segments are gathered and placed inside a row, after one
    shuffle. In larger ones segments stay rows: parents are found by windows over the segments
    of one number, and paths by pointer doubling, as many joins as the depth has binary digits.
    A document's size is bounded by nothing but the disk.
    """
    named = segments.filter(F.col("docnum").isNotNull())
    sizes = named.groupBy("docnum").agg(F.count(F.lit(1)).alias("_size"))
    large = stored(sizes.filter(F.col("_size") > IN_A_ROW).select("docnum"), "large-documents")
    if large.isEmpty():
        return _tree_in_rows(named)
    few = _tree_in_rows(named.join(large, "docnum", "left_anti"))
    return few.unionByName(_tree_by_joins(named.join(large, "docnum", "left_semi")))


def _tree_in_rows(segments: DataFrame) -> DataFrame:
    """``segment_tree`` of documents that fit into a row each."""
    own, parent = F.trim(F.coalesce("segnum", F.lit(""))), F.trim(F.coalesce("psgnum", F.lit("")))
    one = F.struct(
        "segnum", "segment", F.xxhash64("psgnum", F.map_entries("fields")).alias("tie"), own.alias("own"), F.regexp_replace(own, "^0+", "").alias("number"),
        F.regexp_replace(parent, "^0+", "").alias("parent"), F.map_entries("fields").alias("fields"),
    )
    documents = segments.groupBy("docnum").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    none = F.array().cast("array<struct<number:string,own:string,path:string,level:int>>")

    def hung(acc: Column, x: Column) -> Column:
        asked = F.filter(acc, lambda y: (x["parent"] != "") & (y["number"] == x["parent"]))
        # A lambda's argument is worked out once, where a column would be for each use.
        up = F.transform(F.array(asked), lambda found: F.try_element_at(F.filter(found, lambda y: y["own"] == F.get(found, F.lit(0))["own"]), F.lit(-1)))
        return F.concat(acc, F.transform(up, lambda u: F.struct(
            x["number"].alias("number"), x["own"].alias("own"),
            F.concat(F.coalesce(u["path"], F.lit("")), F.lit("/"), x["own"]).alias("path"), (F.coalesce(u["level"], F.lit(0)) + 1).alias("level"),
        )))

    placed = documents.select("docnum", "_all", F.aggregate("_all", none, hung).alias("_ways"))
    rows = placed.select("docnum", F.explode(F.arrays_zip("_all", "_ways")).alias("_x"))
    seg, way = F.col("_x")["_all"], F.col("_x")["_ways"]
    path = way["path"]
    return rows.select(
        "docnum", seg["segnum"].alias("segnum"), seg["segment"].alias("segment"), F.map_from_entries(seg["fields"]).alias("fields"),
        path.alias("path"), F.regexp_replace(path, "/[^/]*$", "").alias("parent_path"), way["level"].alias("level"),
    )


def _tree_by_joins(segments: DataFrame) -> DataFrame:
    """``segment_tree`` of documents of any size."""
    own, parent = F.trim(F.coalesce("segnum", F.lit(""))), F.trim(F.coalesce("psgnum", F.lit("")))
    place = F.row_number().over(Window.partitionBy("docnum").orderBy("segnum", "segment", F.xxhash64("psgnum", F.map_entries("fields"))))
    numbered = segments.select(
        "docnum", "segnum", "segment", "fields", own.alias("_own"), F.regexp_replace(own, "^0+", "").alias("_own_number"),
        F.regexp_replace(parent, "^0+", "").alias("_parent"), place.alias("_pos"),
    )
    numbered = stored(numbered, "segments")
    at = ["docnum", "_pos"]
    ways = numbered.join(_parents(numbered), at, "left").select(*at, "_up", F.concat(F.lit("/"), "_own").alias("path"), F.lit(1).alias("level"))
    ways = stored(ways, "paths")
    while not ways.filter(F.col("_up").isNotNull()).isEmpty():
        above = ways.select("docnum", F.col("_pos").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_path"), F.col("level").alias("_level"))
        ways = stored(ways.join(above, ["docnum", "_up"], "left").select(
            *at, F.col("_next").alias("_up"), F.concat(F.coalesce("_path", F.lit("")), "path").alias("path"), (F.coalesce("_level", F.lit(0)) + F.col("level")).alias("level")
        ), "paths")
    return numbered.join(ways.drop("_up"), at).select(
        "docnum", "segnum", "segment", "fields", "path", F.regexp_replace("path", "/[^/]*$", "").alias("parent_path"), "level"
    )


def attach_children(segments: DataFrame) -> DataFrame:
    """Top segments with all that hangs below them, in order, each with its path and level."""
    tree = segment_tree(segments)
    top = F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2)))
    child = F.struct("segnum", "segment", F.map_entries("fields").alias("fields"), "path", "level")
    head = F.struct("segnum", "segment", F.map_entries("fields").alias("fields"))
    # Tops that share a path each get all that hangs below it.
    held = tree.groupBy("docnum", top.alias("path")).agg(
        F.collect_list(F.when(F.col("level") == 1, head)).alias("tops"), F.array_sort(F.collect_list(F.when(F.col("level") > 1, child))).alias("children")
    )
    rows = held.select("docnum", F.explode("tops").alias("top"), F.when(F.size("children") > 0, F.col("children")).alias("children"))
    return rows.select("docnum", "top.segnum", "top.segment", F.map_from_entries("top.fields").alias("fields"), "children")


# Fixed names: the fields of a control record that a message keeps.
CONTROL_FIELDS = (
    "DOCNUM", "IDOCTYP", "CIMTYP", "MESTYP", "MESCOD", "MESFCT", "SNDPRT", "SNDPRN", "RCVPRT", "RCVPRN", "CREDAT", "CRETIM",
)


def control_block(control: Column) -> Column:
    """The control record (a map) as a message's ``idoc`` block: trimmed, empty fields dropped."""
    entries = [F.struct(F.lit(k.lower()).alias("key"), F.trim(F.coalesce(control[k], F.lit(""))).alias("value")) for k in CONTROL_FIELDS]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] != ""))


def document_event_id(sender: Column, docnum: Column) -> Column:
    """sender/docnum, or the number alone."""
    s = F.trim(F.coalesce(sender, F.lit("")))
    return F.when(s == "", F.trim(docnum)).otherwise(F.concat(s, F.lit("/"), F.trim(docnum)))


# --- Routing and cloud events -----------------------------------------------------------


def type_matches(kind: Column, patterns: Sequence[str]) -> Column:
    """A type equals one of the patterns, or starts with one that ends in ``*``."""
    test = F.lit(False)
    for p in patterns:
        test = test | (kind.startswith(p[:-1]) if p.endswith("*") else kind == p)
    return test


def route(messages: DataFrame, kind: str, events: Mapping[str, Sequence[str]]) -> DataFrame:
    """Messages to every event whose patterns match; ``event`` is NULL where none does."""
    taken = F.array_compact(
        F.array(*[F.when(type_matches(F.col(kind), patterns), F.lit(name)) for name, patterns in events.items()])
    )
    return messages.select("*", F.explode_outer(F.when(F.size(taken) > 0, taken)).alias("event"))


def ignored(routed: DataFrame) -> DataFrame:
    """How many messages no event takes."""
    return routed.agg(F.count(F.when(F.col("event").isNull(), 1)).alias("ignored"))


def cloud_events(
    messages: DataFrame, types: Sequence[str], match: Mapping[str, str] | None = None
) -> DataFrame:
    """Messages (headers map, body) as cloud events, in structured or binary mode.

    Adds id, type, source, subject, time, ``data`` (VARIANT) and ``state``: ok, ignored
    (another type, or no match), or invalid (an attribute is missing, or data is no object).
    """
    from flowlink.functions.documents import variant_at

    headers = F.col("headers")
    binary = F.coalesce(headers["Ce-Id"], F.lit("")) != ""
    body = F.try_parse_json("body")
    base = messages.withColumns({"_binary": binary, "_doc": body})

    def attribute(name: str) -> Column:
        return F.when(F.col("_binary"), headers[f"Ce-{name.capitalize()}"]).otherwise(variant_at(F.col("_doc"), name))

    inline = F.try_variant_get("_doc", "$.data", "variant")
    decoded = F.decode(F.try_to_binary(variant_at(F.col("_doc"), "data_base64"), F.lit("base64")), "UTF-8")
    data = F.when(F.col("_binary"), F.col("_doc")).otherwise(F.coalesce(inline, F.try_parse_json(decoded)))
    out = base.withColumns({n: attribute(n) for n in ("specversion", "id", "type", "source", "subject", "time")})
    out = out.withColumn("data", data)
    complete = F.lit(True)
    for name in ("specversion", "id", "type", "source"):
        complete = complete & (F.coalesce(F.col(name), F.lit("")) != "")
    is_object = F.coalesce(F.schema_of_variant("data").startswith("OBJECT"), F.lit(True))
    wanted = F.lit(True)
    for path, value in (match or {}).items():
        wanted = wanted & F.coalesce(variant_at(F.col("data"), path) == value, F.lit(False))
    state = (
        F.when(~complete, "invalid")
        .when(~type_matches(F.col("type"), types), "ignored")
        .when(~is_object, "invalid")
        .when(~wanted, "ignored")
        .otherwise("ok")
    )
    return out.withColumn("state", state).drop("_binary", "_doc", "specversion")


def enrich(events: DataFrame, current: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Thin events with the record's current fields; a deleted record keeps the event's own.

    ``current`` is (key as text, record): one row per record, joined on the text of the key.
    """
    keyed = events.withColumn(key, F.col(key).cast("string"))
    return keyed.join(current, key, "left").withColumn(payload, F.coalesce("record", payload)).drop("record")


