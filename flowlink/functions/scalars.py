"""Mapping expressions as Columns: what a record mapping's formulas mean, on typed data.

A missing value is NULL throughout. Functions that can fail on a present value come with a
``*_fails`` twin, so that a mapping can name the field that failed (see
``flowlink.operators.mapping``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def number(x: Column, dtype: str = "double") -> Column:
    """Text or number as a number; NULL when it is not one."""
    return F.trim(x.cast("string")).try_cast(dtype)


def number_fails(x: Column, dtype: str = "double") -> Column:
    return x.isNotNull() & number(x, dtype).isNull()


def string(x: Column, dtype: str = "string") -> Column:
    """Scalar as text. Name the type of floating columns: their text has no exponent."""
    if dtype in ("double", "float"):
        # Decimal keeps the shortest text of the double; trailing zeros are then noise.
        wide = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
        whole = x.try_cast("decimal(38,0)").cast("string")
        return F.when(x == F.floor(x), whole).otherwise(wide)
    return x.cast("string")


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """Zero-based; a negative start counts from the end."""
    first = F.lit(start + 1) if start >= 0 else F.greatest(F.char_length(s) + F.lit(start + 1), F.lit(1))
    return F.substr(s, first, F.lit(length)) if length is not None else F.substr(s, first)


def substring_before(s: Column, mark: str) -> Column:
    return F.substring_index(s, mark, 1)


def substring_after(s: Column, mark: str) -> Column:
    """What follows the first mark; all of it when there is none."""
    at = F.instr(s, mark)
    return F.when(at > 0, F.substr(s, at + F.lit(len(mark)))).otherwise(s)


def lowercase(s: Column) -> Column:
    return F.lower(s)


def uppercase(s: Column) -> Column:
    return F.upper(s)


def trim(s: Column) -> Column:
    """Ends trimmed, and runs of white space inside made one space."""
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def join_text(*parts) -> Column:
    """The & operator: a missing part is empty."""
    return F.concat(*[F.coalesce(_lit(p).cast("string"), F.lit("")) for p in parts])


def equals(a: Column, b) -> Column:
    """a = b, where a missing side is not equal."""
    return F.coalesce(a == _lit(b), F.lit(False))


def choose(test: Column, yes, no=None) -> Column:
    """test ? yes : no; a missing test is false."""
    return F.when(F.coalesce(test, F.lit(False)), _lit(yes)).otherwise(_lit(no))


def multiply(a: Column, b) -> Column:
    return F.try_multiply(a, _lit(b))


def divide(a: Column, b) -> Column:
    """NULL on division by zero."""
    return F.try_divide(a, _lit(b))


def rounded(x: Column, places: int = 0) -> Column:
    """Half to even on the decimal text of the number (12.345 is a tie, as written)."""
    return F.bround(x.try_cast("decimal(38,12)"), places).cast("double")


def from_millis(ms: Column) -> Column:
    """Milliseconds since 1970 as ISO 8601 text in UTC."""
    return F.date_format(F.timestamp_millis(ms.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def exists(x: Column) -> Column:
    return x.isNotNull()


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of a small fixed table; join a DataFrame when the table is data."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), key)


def count(array: Column) -> Column:
    return F.when(array.isNull(), F.lit(0)).otherwise(F.size(array))


def project(array: Column, fields: Mapping[str, str]) -> Column:
    """items.{target: source}[]: an array of objects, also for one item."""
    return F.transform(array, lambda x: F.struct(*[x[source].alias(target) for target, source in fields.items()]))


def where(array: Column, **equal) -> Column:
    """Elements whose fields equal the given values."""

    def test(x: Column) -> Column:
        out = F.lit(True)
        for field, value in equal.items():
            out = out & equals(x[field], value)
        return out

    return F.filter(array, test)


def at(array: Column, index: int) -> Column:
    """Zero-based element, from the end when negative; NULL when there is none."""
    return F.try_element_at(array, F.lit(index + 1 if index >= 0 else index))


def first_of(*values: Column) -> Column:
    return F.coalesce(*values)


def each(array: Column, fn) -> Column:
    """$map(array, fn)."""
    return F.transform(array, fn)


def objects(*items: Mapping[str, object]) -> Column:
    """A literal array of objects with the same fields."""
    return F.array(*[F.struct(*[_lit(v).alias(k) for k, v in sorted(item.items())]) for item in items])


def total(values: Sequence[Column]) -> Column:
    """Sum of columns, a missing one counting nothing."""
    out = F.lit(0.0)
    for v in values:
        out = out + F.coalesce(v.cast("double"), F.lit(0.0))
    return out
