"""Webhook intake: raw deliveries authenticated, unpacked, filtered and named."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlink.functions.documents import path_filter, variant_at, variant_path
from flowlink.sources.polling import parse_position

BLOCK = 64
TOLERANCE_SECONDS = 300


class Secret(NamedTuple):
    """How an endpoint signs: stripe, shopify, or hmac-sha256 in a header of its own."""

    endpoint: str
    key: bytes
    signature: str = "hmac-sha256"
    header: str = ""
    prefix: str = ""
    encoding: str = "hex"


def secrets_table(spark: SparkSession, secrets: list[Secret]) -> DataFrame:
    """One row per endpoint with the two padded keys HMAC needs."""
    import hashlib

    rows = []
    for s in secrets:
        key = hashlib.sha256(s.key).digest() if len(s.key) > BLOCK else s.key
        key = key.ljust(BLOCK, b"\0")
        inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
        rows.append((s.endpoint, s.signature, s.header, s.prefix, s.encoding, bytearray(inner), bytearray(outer)))
    return spark.createDataFrame(
        rows, "endpoint string, signature string, header string, prefix string, encoding string, inner binary, outer binary"
    )


def hmac_sha256(inner: Column, outer: Column, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, from the padded keys, without leaving the JVM."""
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def authenticate(deliveries: DataFrame, secrets: DataFrame, now_seconds: int) -> DataFrame:
    """Adds ``authentic`` to deliveries (endpoint, headers map, body).

    Header names are looked up as given. A Stripe signature signs its time too and is good
    for ``TOLERANCE_SECONDS``; any of its v1 parts may match.
    """
    joined = deliveries.join(secrets, "endpoint", "left")
    headers, body = F.col("headers"), F.col("body")

    def mac(message: Column) -> Column:
        return hmac_sha256(F.col("inner"), F.col("outer"), message)

    parts = F.transform(F.split(F.coalesce(headers["Stripe-Signature"], F.lit("")), ","), lambda p: F.trim(p))
    times = F.filter(parts, lambda p: p.startswith("t="))
    stamp = F.substr(F.try_element_at(times, F.lit(-1)), F.lit(3))
    signed = F.transform(F.filter(parts, lambda p: p.startswith("v1=")), lambda p: F.lower(F.substr(p, F.lit(4))))
    recent = F.abs(F.lit(now_seconds) - stamp.try_cast("bigint")) <= TOLERANCE_SECONDS
    stripe = recent & F.array_contains(signed, mac(F.concat(stamp, F.lit("."), body)))

    def from_base64(text: Column) -> Column:
        return F.lower(F.hex(F.try_to_binary(text, F.lit("base64"))))

    shopify = from_base64(headers["X-Shopify-Hmac-Sha256"]) == mac(body)
    given = F.try_element_at(headers, F.col("header"))
    bare = F.when(given.startswith(F.col("prefix")), F.substr(given, F.length("prefix") + 1))
    generic = F.when(F.col("encoding") == "base64", from_base64(bare)).otherwise(F.lower(bare)) == mac(body)
    test = F.when(F.col("signature") == "stripe", stripe).when(F.col("signature") == "shopify", shopify).otherwise(generic)
    return joined.withColumn("authentic", F.coalesce(test, F.lit(False))).drop(
        "signature", "header", "prefix", "encoding", "inner", "outer"
    )


def receive(
    authenticated: DataFrame,
    items: str = "",
    id_path: str = "id",
    position_path: str | None = None,
    position_form: str = "number",
    filters: Mapping[str, str] | None = None,
) -> DataFrame:
    """Deliveries unpacked into items: (delivery columns, item, event_id, result).

    ``items`` is the path of a list or of one object. Results: accepted, ignored (left out
    by a filter), unauthenticated, invalid (no JSON, no item, or an item without its id).
    A delivery with one unnamed item is invalid as a whole, so its sender tries again.
    """
    doc = F.when(F.col("authentic"), F.try_parse_json("body"))
    found = F.try_variant_get(F.col("_doc"), variant_path(items), "array<variant>")
    one = F.try_variant_get(F.col("_doc"), variant_path(items), "variant")
    is_object = F.schema_of_variant(one).startswith("OBJECT")
    listed = F.coalesce(found, F.when(is_object, F.array(one)))
    wanted = path_filter(F.col("_item"), filters or {})

    unpacked = authenticated.withColumn("_doc", doc).withColumn("_items", listed)
    rows = unpacked.select("*", F.posexplode_outer("_items").alias("item_index", "_item")).drop("_items")
    name = variant_at(F.col("_item"), id_path)
    if position_path is not None:
        name = F.concat(
            name, F.lit("@"), parse_position(variant_at(F.col("_item"), position_path), position_form).cast("string")
        )
    taken = F.col("_item").isNotNull() & F.schema_of_variant("_item").startswith("OBJECT") & wanted
    rows = rows.withColumns({"_taken": F.coalesce(taken, F.lit(False)), "event_id": name})
    unnamed = F.col("_taken") & (F.coalesce(F.col("event_id"), F.lit("")) == "")
    result = (
        F.when(~F.col("authentic"), "unauthenticated")
        .when(F.col("_item").isNull(), F.when(F.col("_doc").isNull() | F.col("item_index").isNull(), "invalid").otherwise("ignored"))
        .when(unnamed, "invalid")
        .when(F.col("_taken"), "accepted")
        .otherwise("ignored")
    )
    return rows.withColumn("result", result).withColumn(
        "event_id", F.when(F.col("result") == "accepted", F.col("event_id"))
    ).withColumnRenamed("_item", "item").drop("_doc", "_taken")
