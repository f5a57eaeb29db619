"""Exact order statistics without a global window: running totals over sorted distinct values.

The values are first grouped with their counts (partial aggregation collapses a value that holds a large share of
the rows), then range-partitioned, summed inside each slice, and shifted by the totals of the slices before it. No
task sees more than one slice, whatever the distribution of the values.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alloyscreen.operators import narrowing
from alloyscreen.operators.hot_joins import hot_join
from alloyscreen.session import materialize


def running_totals(distinct: DataFrame, value: str, measures: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``<measure>_upto`` (running total in ascending order of ``value``, own row included) and
    ``<measure>_total`` per ``keys``. ``distinct`` holds one row per keys and value."""
    slices = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, value]
    ranged = distinct.select(*order, *measures).repartitionByRange(slices, *order)
    ranged = materialize(ranged.withColumn("_slice", F.spark_partition_id()))
    # At most one row per slice and key in here.
    totals = ranged.groupBy(*keys, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}_before") for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(*order, *measures, "_slice", *[F.sum(m).over(inside).alias(f"_{m}_inside") for m in measures])
    joined = local.join(F.broadcast(offsets), [*keys, "_slice"])
    return joined.select(
        *order,
        *measures,
        *[(F.col(f"_{m}_before") + F.col(f"_{m}_inside")).alias(f"{m}_upto") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def value_counts(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def attach_by_value(rows: DataFrame, table: DataFrame, value: str, count: str = "n") -> DataFrame:
    """Left join of ``rows`` with one row per ``value``; values that many rows share, and nulls, are dealt over many tasks."""
    return hot_join(rows, table.drop(count), [value], "left").select(*[f"`{c}`" for c in rows.columns], *[c for c in table.columns if c not in (value, count)])


def with_average_rank(df: DataFrame, score: str, rank: str, digits: int = 9) -> DataFrame:
    """Descending rank; ties share the mean of their ranks, cut to an integer. Scores equal to ``digits`` places tie."""
    rounded = df.withColumn("_rank_key", F.round(F.col(score), digits))
    counts = running_totals(value_counts(rounded, "_rank_key"), "_rank_key", ["n"])
    ahead = F.col("n_total") - F.col("n_upto")
    table = counts.select("_rank_key", "n", F.floor(ahead + (F.col("n") + 1) / 2).cast("long").alias(rank))
    return attach_by_value(rounded, table, "_rank_key").drop("_rank_key")


def sort_columns(order: list[tuple[Column, bool]]) -> list[Column]:
    """``orderBy`` columns of a list of (value, whether it falls)."""
    return [F.desc(c) if falls else F.asc(c) for c, falls in order]


def rank_index(df: DataFrame, order: list[tuple[Column, bool]], rank: str) -> DataFrame:
    """``_order_0``.. (the values of ``order``) and the first rank of the rows with these values.

    Only these values are sorted, written and numbered: the position inside each sorted partition plus the rows of the
    partitions before it."""
    names = [f"_order_{i}" for i in range(len(order))]
    narrow = df.select(*[c.alias(n) for n, (c, _) in zip(names, order)])
    narrow = materialize(narrow.orderBy(*sort_columns([(F.col(n), falls) for n, (_, falls) in zip(names, order)])).withColumn("_position", F.monotonically_increasing_id()))
    keyed = narrow.withColumn("_part", F.shiftright("_position", 33))
    sizes = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # a row per partition
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_position").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return keyed.join(F.broadcast(offsets), "_part").groupBy(*names).agg(F.min(place).alias(rank))


def with_row_rank(df: DataFrame, order: list[tuple[Column, bool]], rank: str) -> DataFrame:
    """Rank 1..n over the whole table in the given order, a list of (value, whether it falls). Rows equal in all values follow one another.

    The ranks come from a narrow index; the rows themselves move once, to meet it, and are not written."""
    index = rank_index(df, order, rank)
    names = [f"_order_{i}" for i in range(len(order))]
    own = df.withColumns({f"_own_{i}": c for i, (c, _) in enumerate(order)})
    same = [F.col(f"_own_{i}").eqNullSafe(F.col(n)) for i, n in enumerate(names)]
    met = own.join(index, functools.reduce(operator.and_, same))
    repeated = F.row_number().over(Window.partitionBy(*names).orderBy(*names)) - 1
    return met.withColumn(rank, F.col(rank) + repeated).select(*[f"`{c}`" for c in df.columns], rank)


def melt_fields(df: DataFrame, fields: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Long form (field, value) of numeric columns."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]
    return df.select(*keep, F.inline(F.array(*pairs)))


def quantiles(df: DataFrame, fields: list[str], probabilities: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per field, one column ``q<percent>`` per probability."""
    found = narrowing.quantile_values(df, fields, probabilities)
    names = [quantile_name(p) for p in probabilities]
    rows = [(f, *[found[f][p] for p in probabilities]) for f in fields if f in found]
    return df.sparkSession.createDataFrame(rows, ", ".join(["field string", *[f"{n} double" for n in names]]))


def quantile_name(p: float) -> str:
    return f"q{p * 100:g}".replace(".", "_")


def ks_statistics(first: DataFrame, second: DataFrame, fields: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per field with the asymptotic p-value."""
    found = narrowing.greatest_gaps(first, second, fields)
    rows = [(f, *found[f]) for f in fields if f in found]
    stat = first.sparkSession.createDataFrame(rows, "field string, ks_stat double, n_first long, n_second long")
    return stat.withColumn("p_value", ks_p_value(F.col("ks_stat"), F.col("n_first"), F.col("n_second")))


def ks_p_value(statistic: Column, n_first: Column, n_second: Column) -> Column:
    """Kolmogorov distribution at the scaled statistic, 2·Σ(-1)^(k-1)·exp(-2k²x²), first 20 terms."""
    x = F.sqrt(n_first * n_second / (n_first + n_second)) * statistic
    total = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(x * x * (-2.0 * k * k)) for k in range(1, 21)), F.lit(0.0))
    # The series does not converge near zero, where the p-value is 1.
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
