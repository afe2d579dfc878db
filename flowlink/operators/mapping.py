"""Field mappings: target fields computed from one source document, in one projection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Field(NamedTuple):
    """A target field: its value, and when computing it failed on a present input."""

    target: str
    value: Column
    fails: Column | None = None


class MappingError(ValueError):
    """Every field of a mapping that does not compile."""


def compile_mapping(df: DataFrame, fields: Iterable[Field]) -> list[Field]:
    """Checks all fields against the source's schema and reports every failure at once."""
    fields = sorted(fields, key=lambda f: f.target)
    problems, seen = [], set()
    for f in fields:
        if f.target in seen:
            problems.append(f"{f.target}: mapped twice")
        seen.add(f.target)
        try:
            df.select(f.value, *([f.fails] if f.fails is not None else []))
        except AnalysisException as e:
            problems.append(f"{f.target}: {e.getCondition()}")
    if problems:
        raise MappingError("; ".join(problems))
    return fields


def apply_mapping(df: DataFrame, fields: Iterable[Field], keep: Sequence[str] = (), checked: bool = True) -> DataFrame:
    """The target document: sorted target columns, the source document discarded.

    ``keep`` names envelope columns carried along. With ``checked``, ``_errors`` lists the
    targets that failed (names only, never values).
    """
    fields = compile_mapping(df, fields)
    columns = [f.value.alias(f.target) for f in fields]
    if checked:
        failing = [F.when(F.coalesce(f.fails, F.lit(False)), F.lit(f.target)) for f in fields if f.fails is not None]
        errors = F.array_compact(F.array(*failing)) if failing else F.array().cast("array<string>")
        columns.append(errors.alias("_errors"))
    return df.select(*keep, *columns)


def split_failures(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents without failures, rejects with the failing fields' names)."""
    good = mapped.filter(F.size("_errors") == 0).drop("_errors")
    bad = mapped.filter(F.size("_errors") > 0)
    return good, bad


def document_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """The document as JSON text: fields without a value are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def with_output(df: DataFrame, field: str, result: Column) -> DataFrame:
    """A step's result put into the document under a field."""
    return df.withColumn(field, result)


def amount_of(df: DataFrame, path: str | None = None) -> Column:
    """A document's monetary amount, or 0.

    A named path also reads numbers sent as text; otherwise the first of netValue, amount
    and totalAmount that holds a number counts.
    """
    from pyspark.sql import types as T

    if path is not None:
        value = F.col(path)
        return F.coalesce(F.trim(value.cast("string")).try_cast("double"), F.lit(0.0))
    numeric = [
        F.col(c).cast("double")
        for c in ("netValue", "amount", "totalAmount")
        if c in df.columns and isinstance(df.schema[c].dataType, T.NumericType)
    ]
    return F.coalesce(*numeric, F.lit(0.0))
