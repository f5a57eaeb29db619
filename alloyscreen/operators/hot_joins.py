"""Joins whose keys may be held by a large share of the rows, for keys of any type.

The keys of the left side are counted first (map-side, so that a hot key travels as few rows). A key with at least 1 / ``HOT`` of all
rows is hot; there are at most ``HOT`` of them, whatever the data, so their table is broadcast. Rows of a hot key are dealt over salts,
and the right side's rows of that key are repeated for each salt. Null keys match nothing and are dealt over all tasks."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 512
_HOWS = ("inner", "left", "left_semi", "left_anti")


def _same(df: DataFrame, other: DataFrame, keys: list[str]) -> Column:
    return functools.reduce(operator.and_, [df[f"`{k}`"] == other[f"`_hot_{i}`"] for i, k in enumerate(keys)])


def hot_keys(left: DataFrame, keys: list[str], hot: int = HOT) -> DataFrame:
    """``_hot_0``.. (the keys) and ``_salts`` of each hot key: as many salts as the key has shares of 1 / ``hot`` of the rows."""
    known = left.select(*[F.col(f"`{k}`").alias(f"_hot_{i}") for i, k in enumerate(keys)]).dropna()
    counts = known.groupBy(*known.columns).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") * hot / known.agg(F.count(F.lit(1)).alias("_total")).scalar()
    return counts.withColumn("_share", share).filter("_share >= 1 AND _n > 1").withColumn("_salts", F.floor("_share").cast("int") + 1).drop("_n", "_share")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", hot: int = HOT) -> DataFrame:
    """``left.join(right, keys, how)`` without a task that gets all rows of a hot key of ``left``.

    The salt of a row follows from the row and its input partition alone, so that a task that runs again sends each row to the
    same place. Columns that cannot be hashed (maps) are left out of it."""
    if how not in _HOWS:
        raise ValueError(f"how must be one of {', '.join(_HOWS)}, got {how}")
    table = hot_keys(left, keys, hot)
    plain = [F.col(f"`{f.name}`") for f in left.schema.fields if not _holds_map(f.dataType)]
    spread = F.xxhash64(*plain, F.spark_partition_id())
    unknown = functools.reduce(operator.or_, [F.col(f"`{k}`").isNull() for k in keys])
    marked = left.join(F.broadcast(table), _same(left, table, keys), "left")
    salt = F.when(unknown, -1 - F.pmod(spread, F.lit(1 << 16))).otherwise(F.pmod(spread, F.coalesce(F.col("_salts"), F.lit(1)))).cast("int")
    marked = marked.withColumn("_salt", salt).drop(*table.columns)
    repeated = right.join(F.broadcast(table), _same(right, table, keys), "left")
    repeated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop(*table.columns)
    out = marked.join(repeated, [*keys, "_salt"], how).drop("_salt")
    return out.select(*keys, *[f"`{c}`" for c in left.columns if c not in keys], *([] if how.startswith("left_") else [f"`{c}`" for c in right.columns if c not in keys]))


def _holds_map(kind) -> bool:
    told = kind.simpleString()
    return "map<" in told or "variant" in told
