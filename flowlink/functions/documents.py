"""Paths, filters and names of JSON-like documents (VARIANT or struct columns)."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDER = re.compile(r"\{\{\s*(source|doc)\.([A-Za-z0-9_.]+)\s*\}\}")

SCALARS = (T.StringType, T.NumericType, T.BooleanType)


def variant_path(path: str) -> str:
    """customer.items.0.sku as a VARIANT path: a number indexes a list."""
    out = "$"
    for part in path.split(".") if path else []:
        out += f"[{part}]" if part.isdigit() else f"['{part}']"
    return out


def variant_at(doc: Column, path: str, dtype: str = "string") -> Column:
    """The value at a dotted path of a VARIANT; NULL when missing or of another shape."""
    return F.try_variant_get(doc, variant_path(path), dtype)


def path_filter(doc: Column, wanted: Mapping[str, str]) -> Column:
    """All paths hold these scalars, compared as text."""
    test = F.lit(True)
    for path, value in wanted.items():
        test = test & variant_at(doc, path).eqNullSafe(F.lit(value))
    return test


def equality_filter(wanted: Mapping[str, object]) -> Column:
    """All columns equal the given values (typed; a NULL wanted value matches NULL)."""
    test = F.lit(True)
    for column, value in wanted.items():
        test = test & F.col(column).eqNullSafe(F.lit(value))
    return test


def snake(name: str) -> str:
    """netValue -> net_value, customerID -> customer_id."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def snake_columns(df: DataFrame, fixed: Mapping[str, object] | None = None) -> DataFrame:
    """Top-level columns renamed to snake case, fixed values set last."""
    out = df.select(*[F.col(f"`{c}`").alias(snake(c)) for c in df.columns])
    return out.withColumns({k: F.lit(v) for k, v in fixed.items()}) if fixed else out


def snake_text(s: Column) -> Column:
    """The same renaming for names that are data."""
    return F.lower(F.regexp_replace(s, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})", "_"))


def version_id(record_id: Column, position: Column) -> Column:
    """id@position."""
    return F.concat_ws("@", record_id.cast("string"), position.cast("string"))


def record_id(version: Column) -> Column:
    """The id of id@position; text without a whole-number position is the id itself."""
    return F.regexp_replace(version, r"@-?[0-9]+$", "")


def record_position(version: Column) -> Column:
    return F.regexp_extract(version, r"@(-?[0-9]+)$", 1).try_cast("bigint")


def nest(
    fields: Mapping[str, Column],
    constants: Mapping[str, object] | None = None,
    wrap: str | None = None,
    null_value: str | None = None,
) -> Column:
    """A request body as a struct from dotted names (``\\.`` is a literal dot).

    Constants overrule fields. ``null_value`` stands in for missing text values.
    """
    flat: dict[str, Column] = {}
    for name, value in fields.items():
        flat[name] = F.coalesce(value, F.lit(null_value)) if null_value is not None else value
    for name, value in (constants or {}).items():
        flat[name] = F.lit(value)
    tree: dict = {}
    for name, value in flat.items():
        parts = [p.replace("\0", ".") for p in name.replace("\\.", "\0").split(".")]
        node = tree
        for part in parts[:-1]:
            child = node.get(part)
            if not isinstance(child, dict):
                child = node[part] = {}
            node = child
        node[parts[-1]] = value

    def build(node) -> Column:
        if isinstance(node, dict):
            return F.struct(*[build(v).alias(k) for k, v in sorted(node.items())])
        return node

    body = build(tree)
    return F.struct(body.alias(wrap)) if wrap else body


def _field_type(schema: T.DataType, path: str):
    for part in path.split("."):
        if not isinstance(schema, T.StructType) or part not in schema.names:
            return None
        schema = schema[part].dataType
    return schema


def render(df: DataFrame, template: str, roots: Mapping[str, str], into: str = "key") -> DataFrame:
    """Fills ``{{ source.path }}`` and ``{{ doc.path }}`` from two struct columns.

    Adds ``into`` and ``<into>_error``: every placeholder must hold a scalar, and the result
    must not be empty, or retries would create duplicates.
    """
    from flowlink.functions.scalars import string

    parts: list[Column] = []
    problems: list[Column] = []
    end = 0
    for m in PLACEHOLDER.finditer(template):
        parts.append(F.lit(template[end : m.start()]))
        end = m.end()
        name = f"{m.group(1)}.{m.group(2)}"
        root = roots[m.group(1)]
        kind = _field_type(df.schema[root].dataType, m.group(2))
        if kind is None:
            problems.append(F.lit(name))
            continue
        if not isinstance(kind, SCALARS):
            problems.append(F.lit(f"{name} (not a scalar)"))
            continue
        value = string(F.col(f"{root}.{m.group(2)}"), kind.typeName())
        parts.append(F.coalesce(value, F.lit("")))
        problems.append(F.when(value.isNull(), F.lit(name)))
    parts.append(F.lit(template[end:]))
    text = F.concat(*parts)
    unresolved = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    error = F.when(F.size(unresolved) > 0, F.concat(F.lit("unresolved "), F.array_join(unresolved, ", "))).when(
        F.trim(text) == "", F.lit("rendered empty")
    )
    return df.withColumn(f"{into}_error", error).withColumn(
        into, F.when(F.col(f"{into}_error").isNull(), text)
    )
