"""Mapping of differing column names and types onto the canonical schema. Everything here is resolved from the
column list alone; no operator in this module runs a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen import schema
from alloyscreen.functions.basics import column_or, number
from alloyscreen.functions.composition import slots_formula


def find_alias(columns: list[str], field: str) -> str | None:
    """First alias of ``field`` among ``columns`` (names are case sensitive)."""
    return next((name for name in schema.ALIASES.get(field, []) if name in columns), None)


def rename_to_canonical(df: DataFrame) -> DataFrame:
    found = {field: find_alias(df.columns, field) for field in schema.ALIASES}
    return df.withColumnsRenamed({source: field for field, source in found.items() if source and source != field})


def rename_required(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [f for f in required if f not in df.columns]
    found = {f: find_alias(df.columns, f) for f in missing}
    return df.withColumnsRenamed({source: f for f, source in found.items() if source})


def copy_aliases(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Classifier fields copied from their alias (which stays), read as numbers, nulls and unreadable text filled."""
    columns = {}
    for field in fields or schema.CLASSIFIER_FIELDS:
        source = find_alias(df.columns, field)
        if source is None:
            columns[field] = F.lit(float(schema.ABSENT_DEFAULTS[field]))
        else:
            columns[field] = F.coalesce(number(F.col(f"`{source}`")), F.lit(float(schema.NULL_DEFAULTS[field])))
    return df.withColumns(columns)


def add_absent(df: DataFrame, required: list[str], defaults: dict | None = None) -> DataFrame:
    """Absent columns get a fixed default (for example training medians) and ``<column>_imputed`` = true."""
    values = {**schema.ABSENT_DEFAULTS, **(defaults or {})}
    absent = [f for f in required if f not in df.columns]
    out = df
    for field in absent:
        if field == "formula" and values.get(field) is None:
            continue
        kind = schema.CANONICAL_TYPES.get(field, "double")
        out = out.withColumn(field, F.lit(values.get(field, 0.0)).cast(kind))
    if "formula" in absent and "formula" not in out.columns:
        out = out.withColumn("formula", slots_formula(out))
    return out.withColumns({f"{f}_imputed": F.lit(f in absent) for f in required})


def cast_required(df: DataFrame, required: list[str]) -> DataFrame:
    """Numeric required fields as numbers with null as zero; text fields as they are."""
    columns = {}
    for field in required:
        kind = schema.CANONICAL_TYPES.get(field, "double")
        if kind == "string":
            columns[field] = F.col(field).cast("string")
        else:
            columns[field] = F.coalesce(number(F.col(field)), F.lit(0.0)).cast(kind)
    return df.withColumns(columns)


def complete_fields(df: DataFrame, required: list[str]) -> DataFrame:
    return cast_required(add_absent(rename_to_canonical(df), required), required)


def standardize(df: DataFrame, required: list[str]) -> DataFrame:
    """Rename, complete and type a table. An empty table gives an empty result, so it needs no case of its own."""
    return complete_fields(df, required)


def safe_column(df: DataFrame, field: str, default=None) -> Column:
    return column_or(df, field, schema.ABSENT_DEFAULTS.get(field) if default is None else default)
