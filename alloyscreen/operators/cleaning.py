"""Coercion, imputation, clipping and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alloyscreen import schema
from alloyscreen.functions.basics import clip, number, unreadable
from alloyscreen.operators import ordered


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares as greater than everything here, so it is turned into null right after the scan."""
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def coerce_numeric(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumns({f: number(F.col(f"`{f}`")) for f in fields if f in df.columns})


def coercion_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """Values per field that are present but cannot be read as a number."""
    counted = df.agg(*[F.count_if(unreadable(F.col(f"`{f}`"))).alias(f) for f in fields])
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("coerced")) for f in fields]
    return counted.select(F.inline(F.array(*rows)))


def _means(df: DataFrame, fields: list[str]):
    """Means of all fields as one scalar subquery: one extra pass, no join."""
    return df.agg(F.struct(*[F.avg(F.col(f).cast("double")).alias(f) for f in fields]).alias("means")).scalar()


def schema_clean(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Null becomes the mean of the values as they came, then every value is limited to the range of its field."""
    rules = {c: r for c, r in (ranges if ranges is not None else schema.VALUE_RANGES).items() if c in df.columns}
    if not rules:
        return df
    out = df.withColumn("_means", _means(df, list(rules)))
    filled = {c: clip(F.coalesce(F.col(c).cast("double"), F.col(f"_means.{c}")), *r) for c, r in rules.items()}
    return out.withColumns(filled).drop("_means")


def mean_impute(df: DataFrame, fields: list[str]) -> DataFrame:
    out = df.withColumn("_means", _means(df, fields))
    return out.withColumns({f: F.coalesce(F.col(f).cast("double"), F.col(f"_means.{f}")) for f in fields}).drop("_means")


def medians(df: DataFrame, fields: list[str]) -> dict[str, float | None]:
    """Exact medians: one number per field comes back to the driver."""
    rows = ordered.quantiles(df, fields, [0.5]).collect()
    return {r["field"]: r["q50"] for r in rows}


def median_impute(df: DataFrame, fields: list[str], training_medians: dict[str, float | None]) -> DataFrame:
    """Null becomes the training median; where training has none, the mean of this table."""
    known = {f: training_medians.get(f) for f in fields}
    unknown = [f for f, m in known.items() if m is None]
    out = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float(m))) for f, m in known.items() if m is not None})
    return mean_impute(out, unknown) if unknown else out


def drop_incomplete(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.dropna(subset=fields)


def dedupe(df: DataFrame, key: str = "material_id", order: list | None = None) -> DataFrame:
    """One row per key, the first in ``order``. The limit per key is also applied before the shuffle."""
    w = Window.partitionBy(key).orderBy(*(order or [F.col(key)]))
    return df.withColumn("_row", F.row_number().over(w)).filter(F.col("_row") == 1).drop("_row")
