"""Data-quality reports: one pass over the table each, with one row per field as the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen import schema
from alloyscreen.functions.basics import number, unreadable


def _unpivot(one_row: DataFrame, fields: list[str], parts: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(f).alias("field"), *[F.col(f"{f}__{p}").alias(p) for p in parts]) for f in fields]
    return one_row.select(F.inline(F.array(*rows)))


def _unreadable(df: DataFrame, field: str) -> Column:
    return F.count_if(unreadable(F.col(f"`{field}`")))


def _missing(df: DataFrame, field: str) -> Column:
    c = F.col(f"`{field}`")
    return F.count_if(c.isNull() | F.isnan(c) if dict(df.dtypes)[field] in ("double", "float") else c.isNull())


def quality_report(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Per canonical field: present, nulls, unreadable values, and whether the field passes."""
    fields = required or list(schema.CANONICAL_TYPES)
    measures = []
    for f in fields:
        here = f in df.columns
        text = schema.CANONICAL_TYPES.get(f) == "string"
        nulls = _missing(df, f) if here else F.count_if(F.lit(True))
        bad = _unreadable(df, f) if here and not text else F.count_if(F.lit(False))
        measures += [
            F.first(F.lit(here)).alias(f"{f}__present"),
            F.count(F.lit(1)).alias(f"{f}__row_count"),
            nulls.alias(f"{f}__null_count"),
            bad.alias(f"{f}__unreadable_count"),
        ]
    report = _unpivot(df.agg(*measures), fields, ["present", "row_count", "null_count", "unreadable_count"])
    present = F.coalesce(F.col("present"), F.lit(False))
    return report.withColumns(
        {"present": present, "passed": present & (F.col("unreadable_count") == 0)}
    )


def field_validity(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """One row: missing and unreadable required fields, rows, columns."""
    fields = required or schema.CLASSIFIER_FIELDS
    here = [f for f in fields if f in df.columns]
    missing = [f for f in fields if f not in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), *[_unreadable(df, f).alias(f"_bad_{f}") for f in here])
    bad = F.array_compact(F.array(*[F.when(F.col(f"_bad_{f}") > 0, F.lit(f)) for f in here], F.lit(None).cast("string")))
    return counts.select(
        F.lit(not missing).alias("all_fields_present"),
        F.lit(", ".join(missing)).alias("missing_fields"),
        F.array_join(bad, ", ").alias("invalid_fields"),
        "total_rows",
        F.lit(len(df.columns)).alias("total_columns"),
    )


def profile(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Type, least and greatest value and count of each required field."""
    wanted = [f for f in (fields or schema.CLASSIFIER_FIELDS)]
    here = [f for f in wanted if f in df.columns]
    measures = []
    for f in here:
        v = number(F.col(f"`{f}`"))
        measures += [F.min(v).alias(f"{f}__min_value"), F.max(v).alias(f"{f}__max_value"), F.count(v).alias(f"{f}__value_count")]
    kinds = dict(df.dtypes)
    report = _unpivot(df.agg(*measures), here, ["min_value", "max_value", "value_count"])
    kind = F.create_map(*[x for f in here for x in (F.lit(f), F.lit(kinds[f]))])
    return report.withColumn("data_type", kind[F.col("field")])


def missing_total(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    cells = sum((F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in (fields or df.columns)), F.lit(0))
    return df.agg(F.coalesce(F.sum(cells), F.lit(0)).cast("long").alias("missing_values"))


def sanity_checks(df: DataFrame, probability: str = "synthesizability_probability", tolerance: float = 1e-6) -> DataFrame:
    """Violations of the physical limits, one row per check."""
    c = [F.coalesce(F.col(f"composition_{i}"), F.lit(0.0)) for i in (1, 2, 3)]
    binary = c[2] <= 0
    checks = {
        "density_in_range": ~((F.col("density") > 0) & (F.col("density") < 50)),
        "energy_above_hull_not_negative": ~(F.col("energy_above_hull") >= 0),
        "probability_in_unit_range": ~F.col(probability).between(0, 1),
        "binary_composition_1_in_range": binary & ~c[0].between(0.05, 0.95),
        "binary_composition_2_in_range": binary & ~c[1].between(0.05, 0.95),
        "composition_sum_is_one": F.abs(c[0] + c[1] + c[2] - 1.0) > tolerance,
    }
    counted = df.agg(*[F.count_if(v).alias(k) for k, v in checks.items()])
    rows = [F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in checks]
    return counted.select(F.inline(F.array(*rows)))
