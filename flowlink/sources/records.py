"""Record shapes of business APIs: bulk exports, commerce orders, OData records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlink.session import stored


class IncompleteExport(ValueError):
    """An export whose files do not hold the rows its job reported."""


def _cut_records(inside: dict[tuple[str, int], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of blocks, in order, to records: a line begins one where no quote is open.

    ``inside`` says which blocks begin inside quotes. What goes on from the block before
    (part 0) and what isn't over at the block's end (part 2) come as they are, to be put
    together; whole records are part 1. ``first`` marks what begins its file.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, bool, str]] = []
        place, held, open_, begun, first = None, [], False, True, False

        def end() -> None:
            if held:
                part = 2 if open_ and begun else 1 if begun else 0
                out.append((*place, part, first, "\n".join(held)))
                held.clear()

        for batch in batches:
            for value, file, block in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (file, block) != place:
                    end()
                    place, open_ = (file, block), inside.get((file, block), False)
                    begun, first = not open_, block == 0
                held.append(value)
                open_ ^= value.count('"') % 2 == 1
                if not open_:
                    end()
                    begun, first = True, False
            # A part that a later batch goes on with stays held.
            yield pa.RecordBatch.from_pylist([dict(zip(PARTS, r)) for r in out], schema=PART_SCHEMA)
            out.clear()
        end()
        yield pa.RecordBatch.from_pylist([dict(zip(PARTS, r)) for r in out], schema=PART_SCHEMA)

    return cut


PARTS = ("file", "block", "part", "first", "value")
PART_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("value", pa.string())])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, value): the CSV records of files, line breaks in quotes and all.

    Quotes stand around fields, and doubled inside them, only (RFC 4180).

    Files are read in the byte ranges Spark cuts them into. Whether a range begins inside
    quotes follows from the number of quotes before it: each range counts its own, one row
    per range says so, and a running sum over a file's ranges tells the rest. Only what
    crosses the end of a range, two parts of it at most, meets in a shuffle. The driver
    holds the ranges that begin inside quotes, one entry for ``maxPartitionBytes`` of input
    at most.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("inside", F.sum("odd").over(earlier) % 2 == 1).filter("inside").select("file", "block").collect()
    cut = lines.mapInArrow(_cut_records({(r["file"], r["block"]): True for r in inside}), "file string, block bigint, part int, first boolean, value string")
    cut = stored(cut, "records")
    # What is not over at a range's end goes on at the next one, up to a range whose first part ends it.
    ragged = cut.filter("part <> 1")
    so_far = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.sum(F.when(F.col("part") == 2, 1).otherwise(0)).over(so_far)
    pieces = ragged.withColumn("_nth", begun).groupBy("file", "_nth").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "part", "value"))).alias("_parts")
    )
    whole = pieces.select("file", "first", F.array_join(F.col("_parts.value"), "\n").alias("value"))
    ended = cut.filter("part = 1").select("file", "first", "value").unionByName(whole)
    return ended.withColumn("value", F.regexp_replace("value", r"\r$", "")).filter("first OR value <> ''")


def read_export(spark: SparkSession, path: str, columns: list[str], reported: int | None = None) -> DataFrame:
    """CSV pages with a header: every value text, "" for empty.

    Quoted line breaks are legal in an export; a page is read by as many tasks as it has
    byte ranges all the same (``quoted_records``). With the job's reported row count, the
    files must hold exactly that many rows, which are counted as they are parsed.
    """
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    parsed = quoted_records(spark, path).withColumn("_row", F.from_csv("value", schema, {"escape": '"', "multiLine": "true"}))
    header = F.array(*[F.col("_row")[c] for c in columns]) == F.array(*[F.lit(c) for c in columns])
    told = F.when(F.col("first") & ~F.coalesce(header, F.lit(False)), F.raise_error(F.concat(F.lit("the header differs in "), "file")).cast("boolean")).otherwise(~F.col("first"))
    df = parsed.filter(told).select("_row.*").na.fill("")
    if reported is not None:
        seen = Observation("export")
        df = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")), "export")
        found = seen.get["rows"]
        if found != reported:
            raise IncompleteExport(f"the export holds {found} rows, its job reported {reported}")
    return df


def _money(price_set: Column) -> Column:
    return F.coalesce(price_set["shopMoney"]["amount"], F.lit("0.00"))


def normalize_orders(nodes: DataFrame) -> DataFrame:
    """Order nodes of a graph API in the flat shape of the order resource.

    Expects typed nodes: legacyResourceId, id, name, createdAt, updatedAt, email,
    currencyCode, the price sets, displayFinancialStatus, note, tags, customer,
    shippingLines.nodes and lineItems.nodes.
    """
    c = F.col
    digits = F.regexp_replace("name", r"\D", "")
    customer = F.when(
        c("customer").isNotNull(),
        F.struct(
            c("customer.legacyResourceId").cast("bigint").alias("id"),
            c("customer.id").alias("admin_graphql_api_id"),
            c("customer.defaultEmailAddress.emailAddress").alias("email"),
            c("customer.firstName").alias("first_name"),
            c("customer.lastName").alias("last_name"),
        ),
    )

    def shipping(s: Column) -> Column:
        return F.struct(s["code"].alias("code"), s["title"].alias("title"), _money(s["originalPriceSet"]).alias("price"))

    def line(x: Column) -> Column:
        tail = F.substring_index(x["id"], "/", -1)
        return F.struct(
            F.when(tail.rlike("^[0-9]+$"), tail.try_cast("bigint")).alias("id"),
            x["id"].alias("admin_graphql_api_id"),
            x["sku"].alias("sku"),
            x["name"].alias("name"),
            F.coalesce(x["quantity"], F.lit(0)).alias("quantity"),
            _money(x["originalUnitPriceSet"]).alias("price"),
        )

    return nodes.select(
        c("legacyResourceId").cast("bigint").alias("id"),
        c("id").alias("admin_graphql_api_id"),
        "name",
        F.when(digits != "", digits.try_cast("bigint")).alias("order_number"),
        c("createdAt").alias("created_at"),
        c("updatedAt").alias("updated_at"),
        "email",
        c("currencyCode").alias("currency"),
        _money(c("subtotalPriceSet")).alias("subtotal_price"),
        _money(c("totalPriceSet")).alias("total_price"),
        _money(c("totalTaxSet")).alias("total_tax"),
        F.lower(F.coalesce("displayFinancialStatus", F.lit(""))).alias("financial_status"),
        "note",
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ").alias("tags"),
        customer.alias("customer"),
        F.transform(F.coalesce(c("shippingLines.nodes"), F.array()), shipping).alias("shipping_lines"),
        F.transform(F.coalesce(c("lineItems.nodes"), F.array()), line).alias("line_items"),
    )


def odata_date(text: Column) -> Column:
    """/Date(ms+zone)/ as ISO 8601 in UTC, a date alone at midnight; other text as it is."""
    ms = F.regexp_extract(text, r"^/Date\((-?[0-9]+)([+-][0-9]{4})?\)/$", 1).try_cast("bigint")
    at = F.timestamp_millis(ms)
    day = F.date_format(at, "yyyy-MM-dd")
    moment = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(ms.isNull(), text).when(F.pmod(ms, F.lit(86_400_000)) == 0, day).otherwise(moment)


def clean_odata(value: Column, kind: T.DataType) -> tuple[Column, T.DataType] | None:
    """An OData v2 value as plain data, following its declared type.

    Drops ``__metadata`` and deferred links, unwraps ``results`` lists and makes dates ISO
    8601. Returns None for what is dropped.
    """
    if isinstance(kind, T.StructType):
        if "__deferred" in kind.names:
            return None
        if "results" in kind.names and len(kind.names) <= 2 and isinstance(kind["results"].dataType, T.ArrayType):
            return clean_odata(value["results"], kind["results"].dataType)
        parts = []
        for f in kind.fields:
            if f.name == "__metadata":
                continue
            cleaned = clean_odata(value[f.name], f.dataType)
            if cleaned is not None:
                parts.append((f.name, *cleaned))
        struct = F.struct(*[c.alias(n) for n, c, _ in parts])
        return F.when(value.isNotNull(), struct), T.StructType([T.StructField(n, t) for n, _, t in parts])
    if isinstance(kind, T.ArrayType):
        probe = clean_odata(F.lit(None).cast(kind.elementType), kind.elementType)
        if probe is None:
            return None
        return F.transform(value, lambda x: clean_odata(x, kind.elementType)[0]), T.ArrayType(probe[1])
    if isinstance(kind, T.StringType):
        return odata_date(value), kind
    return value, kind


def clean_records(df: DataFrame, text: str, schema: T.StructType, into: str = "record") -> DataFrame:
    """JSON text of OData records parsed with its declared schema and cleaned."""
    parsed = df.select("*", F.explode(F.array(F.from_json(text, schema))).alias("_raw"))
    return parsed.withColumn(into, clean_odata(F.col("_raw"), schema)[0]).drop("_raw")
