"""Change topics: records of (partition, offset, key, value) with change envelopes as JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlink.functions.joins import small

# Operation codes, where a change comes from, and per connector the source
# fields that place a change in its database's log.
OPERATIONS = {"c": "create", "u": "update", "d": "delete", "r": "read"}
SOURCE_SUMMARY = ("connector", "name", "db", "schema", "table", "snapshot")
POSITION_FIELDS = {
    "postgresql": ("lsn", "txId", "sequence"),
    "mysql": ("server_id", "file", "pos", "row", "gtid"),
    "mariadb": ("server_id", "file", "pos", "row", "gtid"),
    "sqlserver": ("change_lsn", "commit_lsn", "event_serial_no"),
    "oracle": ("scn", "commit_scn", "txId", "rs_id", "ssn", "redo_thread"),
    "db2": ("change_lsn", "commit_lsn"),
    "mongodb": ("ord", "lsid", "txnNumber"),
}
NOT_A_POSITION = ("ts_ms", "ts_us", "ts_ns", "version", "snapshot")
SEPARATOR = "\x1f"


def resolve_starts(ends: DataFrame, offsets: DataFrame, start: str = "earliest") -> DataFrame:
    """(partition, next_offset) for every partition of the topic, to be stored before reading.

    ``ends`` is (partition, end_offset), one past each partition's last record; partitions
    without records have theirs too. A stored offset stays; a partition without one starts
    at 0, or with ``latest`` at its end as it is now: what arrives later is then read, however
    late the first read comes.
    """
    first = F.col("end_offset") if start == "latest" else F.lit(0).cast("bigint")
    known = ends.join(offsets, "partition", "full_outer")
    return known.select("partition", F.coalesce("next_offset", first).alias("next_offset"))


def topic_ends(records: DataFrame) -> DataFrame:
    """(partition, end_offset) of the partitions that have records."""
    return records.groupBy("partition").agg((F.max("offset") + 1).alias("end_offset"))


def read_topic(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """Records at or past each partition's stored offset, from the first one without it.

    ``offsets`` is (partition, next_offset), one row per partition; to start at the end of
    a topic, store what ``resolve_starts`` gives and read from that.
    """
    joined = records.join(small(offsets), "partition", "left")
    return joined.filter(F.col("offset") >= F.coalesce("next_offset", F.lit(0))).drop("next_offset")


def next_offsets(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """Stored offsets after a batch: one past the last record read, never back."""
    read = records.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))
    both = offsets.select("partition", "next_offset").unionByName(read)
    return both.groupBy("partition").agg(F.max("next_offset").alias("next_offset"))


def retention_gaps(offsets: DataFrame, starts: DataFrame) -> DataFrame:
    """Partitions whose stored offset the topic no longer keeps; new partitions are fine."""
    return offsets.join(starts, "partition").filter(F.col("next_offset") < F.col("start_offset"))


def decode(records: DataFrame, row: T.StructType, value: str = "value") -> DataFrame:
    """Envelopes parsed with the table's declared row, in one pass over the text.

    Adds ``state`` (ok, tombstone or invalid) and op, before, after, source and ts_ms.
    Envelopes come bare, or as a payload next to their schema. A record without op and
    source is not a change (a flattened record, or text that is no JSON).
    """
    inner = [
        T.StructField("op", T.StringType()),
        T.StructField("before", row),
        T.StructField("after", row),
        T.StructField("source", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts_ms", T.LongType()),
    ]
    outer = T.StructType(
        [
            T.StructField("schema", T.StructType([T.StructField("type", T.StringType())])),
            T.StructField("payload", T.StructType(inner)),
            *inner,
        ]
    )
    # Generating the parsed value keeps the optimizer from parsing again for every field.
    parsed = records.select("*", F.explode(F.array(F.from_json(value, outer))).alias("_e"))
    wrapped = F.col("_e.schema").isNotNull() & F.col("_e.payload").isNotNull()

    def part(name: str) -> Column:
        return F.when(wrapped, F.col(f"_e.payload.{name}")).otherwise(F.col(f"_e.{name}"))

    out = parsed.withColumns({f.name: part(f.name) for f in inner}).drop("_e")
    empty = F.col(value).isNull() | (F.length(value) == 0)
    complete = (F.coalesce(F.col("op"), F.lit("")) != "") & F.col("source").isNotNull()
    image = F.when(F.col("op") == "d", F.col("before").isNotNull()).otherwise(F.col("after").isNotNull())
    state = F.when(empty, "tombstone").when(~complete, "invalid").when(~image, "no_row").otherwise("ok")
    return out.withColumn("state", state)


def rejects(decoded: DataFrame) -> DataFrame:
    """Records no change could be read from; tombstones are none of them."""
    return decoded.filter(F.col("state").isin("invalid", "no_row"))


def change_row() -> Column:
    """The row a change is about: as it was for a delete, as it is otherwise."""
    return F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))


def build_events(
    decoded: DataFrame, keep: Sequence[str] = ("c", "u", "d"), match: Mapping[str, object] | None = None
) -> DataFrame:
    """Wanted changes with their payload: the row's columns and a ``debezium`` block."""
    rows = decoded.filter((F.col("state") == "ok") & F.col("op").isin(*keep)).withColumn("row", change_row())
    for column, wanted in (match or {}).items():
        rows = rows.filter(F.col(f"row.{column}").eqNullSafe(F.lit(wanted)))
    name = F.col("op")
    for code, text in OPERATIONS.items():
        name = F.when(F.col("op") == code, F.lit(text)).otherwise(name)
    source = F.map_filter("source", lambda k, v: k.isin(*SOURCE_SUMMARY) & v.isNotNull())
    change = F.struct(
        name.alias("op"),
        source.alias("source"),
        F.when(F.col("op") == "u", F.col("before")).alias("before"),
        F.when(F.col("ts_ms") > 0, F.timestamp_millis("ts_ms")).alias("ts"),
    )
    return rows.withColumn("payload", F.struct("row.*", change.alias("debezium")))


def canonical_key(key: Column) -> Column:
    """A record key as text that does not depend on field order or on a schema around it."""
    bare = F.when(
        F.get_json_object(key, "$.schema").isNotNull(), F.get_json_object(key, "$.payload")
    ).otherwise(key)
    fields = F.array_sort(F.map_entries(F.from_json(bare, "map<string,string>")))
    text = F.array_join(F.transform(fields, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null")))), ",")
    return F.coalesce(text, bare)


def change_id(key: str = "key") -> Column:
    """128 bits that name a change: the same when its source sends it again."""
    source, connector = F.col("source"), F.col("source")["connector"]

    def text(field: str) -> Column:
        return F.coalesce(source[field], F.lit(""))

    place = F.when(F.lit(False), F.lit(""))
    for name, fields in POSITION_FIELDS.items():
        place = place.when(connector == name, F.concat_ws(SEPARATOR, *[text(f) for f in fields]))
    rest = F.array_sort(F.map_entries(F.map_filter(source, lambda k, _: ~k.isin(*NOT_A_POSITION))))
    unknown = F.array_join(F.transform(rest, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null")))), SEPARATOR)
    layout = F.concat_ws(
        SEPARATOR,
        F.coalesce(connector, F.lit("")),
        F.col("op"),
        place.otherwise(unknown),
        *[text(f) for f in ("db", "schema", "table", "collection")],
        canonical_key(F.col(key)),
    )
    return F.substring(F.sha2(layout, 256), 1, 32)


# --- Logical types ---------------------------------------------------------------------


def unscaled(b64: Column) -> Column:
    """Base64 of a big-endian two's-complement number of at most 16 bytes, as decimal(38,0).

    NULL when wider, or past 38 digits; ``wide_decimal`` reads those as text.
    """
    digits = F.hex(F.unbase64(b64))
    negative = F.conv(F.substring(digits, 1, 1), 16, 10).cast("int") >= 8
    filled = F.when(negative, F.lpad(digits, 32, "F")).otherwise(F.lpad(digits, 32, "0"))
    # One's complement keeps every part positive: -(~n) - 1.
    bits = F.when(negative, F.translate(filled, "0123456789ABCDEF", "FEDCBA9876543210")).otherwise(filled)

    def part(start: int, length: int) -> Column:
        return F.conv(F.substring(bits, start, length), 16, 10).cast("decimal(20,0)")

    high = F.try_multiply(part(1, 16), F.lit(Decimal(2**64)))
    whole = F.try_add(high, part(17, 16)).try_cast("decimal(38,0)")
    value = F.when(negative, -whole - 1).otherwise(whole)
    return F.when(F.length(digits).between(1, 32), value.try_cast("decimal(38,0)"))


def decimal_text(b64: Column, scale: int) -> Column:
    """The exact number as text, with the scale's decimals."""
    number = unscaled(b64)
    digits = F.regexp_replace(number.cast("string"), "^-", "")
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    if scale > 0:
        padded = F.when(F.length(digits) <= scale, F.lpad(digits, scale + 1, "0")).otherwise(digits)
        cut = F.length(padded) - F.lit(scale)
        return F.concat(sign, F.substr(padded, F.lit(1), cut), F.lit("."), F.substr(padded, cut + 1))
    return F.concat(sign, digits, F.lit("0" * -scale))


def decimal_value(b64: Column, precision: int, scale: int) -> Column:
    return decimal_text(b64, scale).try_cast(f"decimal({precision},{scale})")


@F.pandas_udf(T.StringType())
def wide_decimal(b64: pd.Series, scale: pd.Series) -> pd.Series:
    """Unscaled bytes of any width as decimal text, for columns past 38 digits."""
    import base64
    import decimal

    def text(data, places):
        if data is None or pd.isna(places):
            return None
        whole = int.from_bytes(base64.b64decode(data), "big", signed=True)
        with decimal.localcontext(prec=10_000):
            return format(decimal.Decimal(whole).scaleb(-int(places)), "f")

    return pd.Series([text(d, p) for d, p in zip(b64, scale)])


def clock_text(nanos: Column) -> Column:
    """A time of day as hh:mm:ss with the fraction it has."""
    whole = F.floor(nanos / 1_000_000_000).cast("bigint")
    fraction = F.regexp_replace(F.lpad((nanos % 1_000_000_000).cast("string"), 9, "0"), "0+$", "")
    text = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60, whole % 60)
    return F.when(fraction == "", text).otherwise(F.concat(text, F.lit("."), fraction))


def logical_value(value: Column, name: str, precision: int = 38, scale: int = 0) -> Column:
    """A wire value of a logical type as what it means; other types pass."""
    match name:
        case "org.apache.kafka.connect.data.Decimal":
            return decimal_value(value, precision, scale)
        case "io.debezium.data.VariableScaleDecimal":
            if precision > 38:
                return wide_decimal(value["value"], value["scale"])
            return _scaled(unscaled(value["value"]), value["scale"])
        case "org.apache.kafka.connect.data.Date" | "io.debezium.time.Date":
            return F.date_from_unix_date(value.cast("int"))
        case "org.apache.kafka.connect.data.Timestamp" | "io.debezium.time.Timestamp":
            return F.timestamp_millis(value.cast("bigint"))
        case "io.debezium.time.MicroTimestamp":
            return F.timestamp_micros(value.cast("bigint"))
        case "io.debezium.time.NanoTimestamp":
            return F.timestamp_micros(F.floor(value.cast("bigint") / 1000).cast("bigint"))
        case "org.apache.kafka.connect.data.Time" | "io.debezium.time.Time":
            return clock_text(value.cast("bigint") * 1_000_000)
        case "io.debezium.time.MicroTime":
            return clock_text(value.cast("bigint") * 1000)
        case "io.debezium.time.NanoTime":
            return clock_text(value.cast("bigint"))
        case "io.debezium.data.Json":
            return F.try_parse_json(value)
    return value


def _scaled(whole: Column, scale: Column) -> Column:
    """A whole number shifted by a scale that differs per row, as text."""
    digits = F.regexp_replace(whole.cast("string"), "^-", "")
    sign = F.when(whole < 0, F.lit("-")).otherwise(F.lit(""))
    padded = F.when(F.length(digits) <= scale, F.lpad(digits, scale + 1, F.lit("0"))).otherwise(digits)
    cut = F.length(padded) - scale
    return (
        F.when(scale > 0, F.concat(sign, F.substr(padded, F.lit(1), cut), F.lit("."), F.substr(padded, cut + 1)))
        .when(scale < 0, F.concat(sign, digits, F.repeat(F.lit("0"), -scale)))
        .otherwise(F.concat(sign, digits))
    )
