"""Bootstrap of the Kolmogorov-Smirnov test over grouped values, by expressions alone.

A value that n rows hold is drawn Poisson(n) times in each replicate, since a sum of n unit-rate draws is one draw of rate n. The draw
follows from a digest of field, value and replicate, so that a task that runs again draws the same, and so does any other engine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen.operators import ordered

GOOD_P_VALUE = 0.05
#: Rates up to here are drawn exactly, from a table of the distribution; beyond, by a normal draw corrected for skewness.
TABLE_RATE = 16
_HALF_DIGEST = float(1 << 52)


def poisson_table(rates: int = TABLE_RATE) -> list[list[float]]:
    """For each rate from 1 the probabilities of at most 0, 1, 2, .. until the rest is below 2**-53."""
    table = []
    for rate in range(1, rates + 1):
        p, total, row = math.exp(-rate), 0.0, []
        while len(row) <= rate or p > 2.0**-54:
            total += p
            row.append(min(total, 1.0))
            p *= rate / len(row)
        table.append(row)
    return table


def digest_key(field: Column, value: Column, replicate: Column) -> Column:
    """Text that names a draw; values are told to twelve decimals where they fit."""
    told = F.coalesce(value.try_cast("decimal(38,12)").cast("string"), value.cast("string"))
    return F.concat_ws("|", field, told, replicate.cast("string"))


def poisson_draw(rate: Column, digest: Column) -> Column:
    """A Poisson draw from 26 hexadecimal digits: the first 13 give a uniform number, the next 13 a second one."""
    uniform = lambda start: (F.conv(F.substring(digest, start, 13), 16, 10).cast("double") + 0.5) / _HALF_DIGEST
    table = F.array(*[F.array(*[F.lit(p) for p in row]) for row in poisson_table()])
    row = F.get(table, (F.least(rate, F.lit(TABLE_RATE)) - 1).cast("int"))
    exact = F.size(F.filter(row, lambda p: p <= uniform(1)))
    z = F.sqrt(F.log(uniform(1)) * -2.0) * F.cos(uniform(14) * (2.0 * math.pi))
    normal = F.floor(rate + F.sqrt(rate.cast("double")) * z + (z * z - 1.0) / 6.0 + 0.5)
    return F.when(rate <= 0, 0).when(rate <= TABLE_RATE, exact).otherwise(F.greatest(normal, F.lit(0))).cast("long")


def ks_replicates(first: DataFrame, second: DataFrame, fields: list[str], replicates: int = 100, seed: int = 42) -> DataFrame:
    """field, replicate, ks_stat, n_first, n_second and p_value; ``second`` is drawn anew in each replicate."""
    tagged = ordered.melt_fields(first, fields).withColumn("side", F.lit(1)).unionByName(
        ordered.melt_fields(second, fields).withColumn("side", F.lit(2))
    )
    grouped = tagged.filter(F.col("value").isNotNull()).groupBy("field", "value").agg(
        F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 2).alias("n")
    )
    # distinct values times replicates: the rows of the tables themselves are not multiplied
    each = grouped.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    digest = F.md5(digest_key(F.col("field"), F.col("value"), F.col("replicate") + F.lit(seed) * 1_000_000))
    drawn = each.withColumn("_digest", digest).withColumn("b", poisson_draw(F.col("n"), F.col("_digest"))).drop("_digest", "n")
    totals = ordered.running_totals(drawn, "value", ["a", "b"], ("field", "replicate"))
    gap = F.abs(F.try_divide(F.col("a_upto"), F.col("a_total")) - F.try_divide(F.col("b_upto"), F.col("b_total")))
    found = totals.groupBy("field", "replicate").agg(F.max(gap).alias("ks_stat"), F.max("a_total").alias("n_first"), F.max("b_total").alias("n_second"))
    known = F.col("ks_stat").isNotNull()
    return found.withColumn("p_value", F.when(known, ordered.ks_p_value(F.col("ks_stat"), F.col("n_first"), F.greatest("n_second", F.lit(1)))))


def ks_bootstrap(first: DataFrame, second: DataFrame, fields: list[str], replicates: int = 100, seed: int = 42) -> DataFrame:
    """Mean and deviation of the p-value over bootstrap samples of ``second``, with its central 95 % range, per field."""
    # one row per field and replicate
    return ks_replicates(first, second, fields, replicates, seed).groupBy("field").agg(
        F.avg("p_value").alias("mean_p_value"),
        (F.lit(1.0) - F.stddev_pop("p_value")).alias("p_stability"),
        F.percentile("p_value", 0.025).alias("ci_low"),
        F.percentile("p_value", 0.975).alias("ci_high"),
        F.when(F.avg("p_value") > GOOD_P_VALUE, "good").otherwise("poor").alias("distribution_similarity"),
    )


def overall_assessment(fields: DataFrame) -> DataFrame:
    """One verdict over the fields of ``ks_bootstrap``: how stable the p-values are and how many fields match."""
    stable = fields.agg(
        F.avg("p_stability").alias("average_stability"), F.count_if(F.col("distribution_similarity") == "good").alias("good_matches"), F.count(F.lit(1)).alias("fields")
    )
    grade = (
        F.when((F.col("average_stability") > 0.8) & (F.col("good_matches") >= 3), "high")
        .when((F.col("average_stability") > 0.6) & (F.col("good_matches") >= 2), "moderate").otherwise("low")
    )
    return stable.withColumn("robustness", grade)
