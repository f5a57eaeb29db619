from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_or(df: DataFrame, name: str, default) -> Column:
    """The column when the frame has it, else a literal. A null inside an existing column stays null."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)


def number(c: Column) -> Column:
    """``c`` as double; unreadable text and NaN become null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def unreadable(c: Column) -> Column:
    """Present, but not a number. NaN is a missing value, not an unreadable one."""
    return c.isNotNull() & c.try_cast("double").isNull()


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """``c`` limited to [low, high]; a bound may be none. Null stays null."""
    bounds = [(c < low, low)] if low is not None else []
    bounds += [(c > high, high)] if high is not None else []
    out = F
    for beyond, bound in bounds:
        out = out.when(beyond, F.lit(float(bound)))
    return out.otherwise(c) if bounds else c


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, 1).otherwise(0)


def points(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))


def texts(*parts: Column) -> Column:
    """The non-null parts as an array."""
    return F.array_compact(F.array(*parts))


def fixed_text(c: Column, digits: int) -> Column:
    """``c`` with a fixed number of decimals, halves rounded up; float noise beyond nine places is removed first.

    Decimal arithmetic is several times faster here than ``format_string``."""
    return F.round(c.try_cast("decimal(28,9)"), digits).cast(f"decimal(28,{digits})").cast("string")


def display_round(c: Column, digits: int = 3) -> Column:
    """``c`` for display: float noise beyond nine places is removed, then halves go to the even neighbour."""
    return F.bround(c.try_cast("decimal(28,9)"), digits).cast("double")


def joined(separator: str, *parts: Column) -> Column:
    """The non-null parts in one text."""
    return F.concat_ws(separator, *parts)


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for costly columns that later filters use. A filter above a plain projection is rewritten in terms
    of the projection's inputs and evaluates the whole expression once per mention; above a generator it stays a filter
    on the computed value."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.drop(*[c for c in columns if c in df.columns]).select("*", F.inline(F.array(row)))
