"""Expressions shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A blank or one of the controls 9 to 13, which separate words.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once a row, however often ``then`` uses it, also within lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
