"""Small helpers on columns and names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh_name(taken: Iterable[str], base: str) -> str:
    """A column name that clashes with none of ``taken``, ignoring case."""
    low = {t.lower() for t in taken}
    name = f"__{base}"
    while name.lower() in low:
        name += "_"
    return name


def has_text(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != F.lit(""))


def utc_month(c: Column) -> Column:
    """``YYYY-MM`` of an instant in UTC, whatever the session's zone."""
    days = F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def with_optional(df: DataFrame, **types: str) -> DataFrame:
    """Adds columns that an older writer left out, as typed nulls."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c.lower() not in have})
