"""Write policy: decisions, admission, amount checks, masking, row checks, currency scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMOUNT_THRESHOLD = 50000.0
OPERATOR = "integration-operator"
READER = "integration-reader"

# Personal fields, and currencies without the usual two decimals.
PERSONAL_FIELDS = ("email", "phone", "birthDate", "taxId", "iban")
ZERO_DECIMAL = "bif clp djf gnf jpy kmf krw mga pyg rwf ugx vnd vuv xaf xof xpf".split()
THREE_DECIMAL = "bhd jod kwd omr tnd".split()


def decide(
    risk: Column,
    roles: Column,
    agent: Column,
    amount: Column,
    approval: Column,
    threshold: float = AMOUNT_THRESHOLD,
) -> Column:
    """struct<allow, require_approval, denied, reasons> for a tool call.

    Reads need the operator or reader role, low-risk writes the operator role, high-risk
    writes an approval; amounts above the threshold need one too. An agent without the
    operator role may not write at all, and a rejection denies.
    """
    operator = F.array_contains(roles, OPERATOR)
    reader = F.array_contains(roles, READER)
    no = F.lit(False)
    approved = F.coalesce(approval == "approved", no)
    rejected = F.coalesce(approval == "rejected", no)
    above = F.coalesce(amount > F.lit(threshold), no)
    barred = F.coalesce(agent, no) & risk.isin("low", "high") & ~operator
    denied = barred | rejected
    allow = (
        F.when(risk == "read", operator | reader)
        .when(risk == "low", operator)
        .when(risk == "high", approved)
        .otherwise(no)
    )
    reasons = F.array_compact(
        F.array(
            F.when(risk == "high", F.lit("high-risk tool")).when(
                ~risk.isin("read", "low") | risk.isNull(),
                F.concat(F.lit("unknown risk tier "), F.coalesce(risk, F.lit(""))),
            ),
            F.when(above, F.lit("amount above approval threshold")),
            F.when(barred, F.lit(f"agents need the {OPERATOR} role to write")),
            F.when(rejected, F.lit("approval rejected")),
        )
    )
    return F.struct(
        (allow & ~denied).alias("allow"),
        (F.coalesce(risk == "high", no) | above).alias("require_approval"),
        denied.alias("denied"),
        reasons.alias("reasons"),
    )


def admission(decision: Column, require_approval: Column) -> Column:
    """What the first phase of a write ends in: denied, needs_approval or ready."""
    needs = decision["require_approval"] | F.coalesce(require_approval, F.lit(False))
    stopped = decision["denied"] | (~decision["allow"] & ~needs)
    return F.when(stopped, "denied").when(needs, "needs_approval").otherwise("ready")


def amount_mismatch(amount: Column, preview: Column, path: str, tolerance: float = 0.0) -> Column:
    """How a dry run's amount differs from the request's; NULL when they agree.

    ``preview`` is the dry run as JSON text, or NULL where the target gave none; numbers
    sent as texts count. No dry run, one that is no JSON and one without an amount at the
    dotted ``path`` are told apart.
    """
    text = F.format_string("%.2f", amount)
    allowed = F.greatest(F.lit(tolerance) * F.abs(amount), F.lit(0.005))
    member = F.try_variant_get(F.try_parse_json(preview), "$." + path, "string")
    shown = member.try_cast("double")

    def unchecked(why: str) -> Column:
        return F.concat(F.lit("amount "), text, F.lit(f" not compared: {why}"))

    return F.when(
        F.coalesce(F.length(preview), F.lit(0)) == 0, unchecked("there was no dry run")
    ).when(
        F.try_parse_json(preview).isNull(), unchecked("the dry run is no JSON")
    ).when(
        shown.isNull(), unchecked(f"the dry run has no amount at {path}")
    ).when(
        F.abs(shown - amount) > allowed,
        F.concat(
            F.lit("the dry run has "), F.format_string("%.2f", shown), F.lit(f" at {path}, the request "), text
        ),
    )


def mask_personal(df: DataFrame, purpose: str, fields: Sequence[str] = PERSONAL_FIELDS) -> DataFrame:
    """Personal fields replaced by ``***`` unless the write goes to a system of record."""
    if purpose == "system-of-record-write":
        return df
    present = [c for c in df.columns if c in fields]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit("***")) for c in present})


def check_rows(df: DataFrame, types: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Text columns coerced to a sink's declared types, with ``_errors`` naming bad columns.

    Types: Int64, Double, Decimal, Boolean, DateTime, String. A column the table does not
    declare rejects every row that has a value in it. Errors never quote the value.
    """
    values, problems = [], []
    for column in df.columns:
        if column in keep:
            continue
        raw = F.col(f"`{column}`")
        if column not in types:
            problems.append(F.when(raw.isNotNull(), F.lit(f"column {column} is not in the table")))
            continue
        kind = types[column]
        text = F.trim(raw.cast("string"))
        value = _coerce(text, kind)
        values.append(value.alias(column))
        hint = " (ISO 8601)" if kind == "DateTime" else ""
        problems.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"column {column} must be {kind}{hint}")))
    errors = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    return df.select(*keep, *values, errors.alias("_errors"))


def _coerce(text: Column, kind: str) -> Column:
    if kind == "Int64":
        wide = text.try_cast("decimal(38,6)")
        return F.when(wide == F.floor(wide), wide.try_cast("bigint"))
    if kind == "Double":
        return text.try_cast("double")
    if kind == "Decimal":
        return text.try_cast("decimal(38,6)")
    if kind == "Boolean":
        return F.when(F.lower(text) == "true", F.lit(True)).when(F.lower(text) == "false", F.lit(False))
    if kind == "DateTime":
        day = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull()
        moment = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T") & text.try_cast("timestamp").isNotNull()
        return F.when(day, F.concat(text, F.lit("T00:00:00"))).when(moment, text)
    return text


def exponent(currency: Column) -> Column:
    """Decimals of a currency's minor unit."""
    c = F.lower(currency)
    return F.when(c.isin(ZERO_DECIMAL), 0).when(c.isin(THREE_DECIMAL), 3).otherwise(2)


def to_minor(amount: Column, currency: Column) -> Column:
    """A major-unit amount in minor units; NULL when it has more decimals than allowed."""
    places = exponent(currency)
    wide = amount.cast("decimal(28,9)")
    scaled = F.when(places == 0, wide).when(places == 3, wide * 1000).otherwise(wide * 100)
    return F.when(scaled == F.floor(scaled), scaled.cast("bigint"))


def to_major(minor: Column, currency: Column) -> Column:
    places = exponent(currency)
    wide = minor.cast("decimal(28,0)")
    return (
        F.when(places == 0, wide.cast("decimal(28,3)"))
        .when(places == 3, (wide / 1000).cast("decimal(28,3)"))
        .otherwise((wide / 100).cast("decimal(28,3)"))
    )


def classify_failure(kind: Column, sqlstate: Column | None = None) -> Column:
    """denied, rejected, invalid (all final) or retryable.

    A database's data and constraint errors (SQLSTATE classes 22 and 23) are invalid.
    """
    out = F.when(kind.isin("denied", "rejected", "invalid"), kind)
    if sqlstate is not None:
        out = out.when(F.substring(sqlstate, 1, 2).isin("22", "23"), F.lit("invalid"))
    return out.otherwise(F.lit("retryable"))
