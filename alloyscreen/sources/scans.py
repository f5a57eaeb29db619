"""Scans of materials, outcomes and methods."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alloyscreen import refdata, schema
from alloyscreen.functions.basics import number
from alloyscreen.functions.methods import with_method_details
from alloyscreen.operators import cleaning, ranking


def read_csv(spark: SparkSession, path: str, table_schema=schema.MATERIALS_SCHEMA) -> DataFrame:
    return cleaning.nan_to_null(
        spark.read.schema(table_schema).option("header", True).option("escape", '"').option("nanValue", "NaN").csv(path)
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return cleaning.nan_to_null(spark.read.parquet(path))


def conform(df: DataFrame, table_schema) -> DataFrame:
    """The columns of ``table_schema``, in its order and types; absent ones as null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema.fields
        ]
    )


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcome log of parquet files; absent columns become null, and a missing log is an empty table."""
    try:
        log = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema.OUTCOME_SCHEMA)
    return conform(log, schema.OUTCOME_SCHEMA)


SUMMARY_FIELDS = [
    "material_id", "formula_pretty", "elements", "nsites", "volume", "density", "density_atomic", "band_gap",
    "energy_above_hull", "formation_energy_per_atom", "total_magnetization",
]
SUMMARY_NAMES = {"formula_pretty": "formula", "density_atomic": "atomic_density"}


def summary_scan(
    materials: DataFrame,
    elements: list[str] | None = None,
    band_gap_min: float | None = None,
    band_gap_max: float | None = None,
    energy_above_hull_max: float | None = 0.1,
    nsites_max: int | None = 20,
    limit: int | None = None,
) -> DataFrame:
    """Filtered summary of a materials table; comparisons reach the file scan. With ``limit`` the first ids are kept."""
    out = materials
    for element in elements or []:
        out = out.filter(F.array_contains("elements", element))
    bounds = [("band_gap", ">=", band_gap_min), ("band_gap", "<=", band_gap_max),
              ("energy_above_hull", "<=", energy_above_hull_max), ("nsites", "<=", nsites_max)]
    for column, sign, value in bounds:
        if value is not None:
            out = out.filter(F.col(column) >= value if sign == ">=" else F.col(column) <= value)
    out = summarised(out)
    return out.orderBy("material_id").limit(limit) if limit is not None else out


def summarised(materials: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The summary fields that are there, texts as numbers, under their usual names, and the columns ``more``."""
    out = materials.select(*[c for c in SUMMARY_FIELDS if c in materials.columns], *more)
    numeric = ["volume", "density", "density_atomic", "band_gap", "energy_above_hull", "formation_energy_per_atom", "total_magnetization"]
    out = out.withColumns({c: number(F.col(c)) for c in numeric if c in out.columns and dict(out.dtypes)[c] == "string"})
    return out.withColumnsRenamed({k: v for k, v in SUMMARY_NAMES.items() if k in out.columns})


def listed_pairs(pairs: list[tuple[str, str]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("pair_index"), F.lit(a).alias("element_1"), F.lit(b).alias("element_2"))
            for i, (a, b) in enumerate(pairs)
        ]
    )


def matching_pairs(pairs: list[tuple[str, str]]) -> Column:
    """The pairs of which a row's ``elements`` hold both. A row meets its pairs through a literal array, without a join."""
    both = lambda p: F.array_contains(F.col("elements"), p["element_1"]) & F.array_contains(F.col("elements"), p["element_2"])
    return F.filter(listed_pairs(pairs), both)


def pair_scan(
    materials: DataFrame,
    pairs: list[tuple[str, str]] | None = None,
    limit_per_pair: int | None = None,
    energy_above_hull_max: float = 0.05,
    nsites_max: int = 10,
) -> DataFrame:
    """Materials of the element pairs, tagged with the pair; a material of several pairs keeps its first pair, of rows with one
    ``material_id`` one stays. ``limit_per_pair`` keeps the first materials of each pair only."""
    kept = summary_scan(materials, energy_above_hull_max=energy_above_hull_max, nsites_max=nsites_max, limit=None)
    matching = matching_pairs(pairs or refdata.ALLOY_PAIRS)
    if limit_per_pair is None:
        tagged = kept.select("*", F.inline(F.slice(matching, 1, 1)))
    else:
        tagged = ranking.top_per_group(kept.select("*", F.inline(matching)), ["pair_index"], [F.col("material_id")], limit_per_pair)
    return cleaning.dedupe(tagged, "material_id", [F.col("pair_index")]).withColumn("alloy_type", F.lit("binary")).drop("pair_index")


def training_scan(materials: DataFrame, pairs=None, limit_per_pair: int | None = None, energy_above_hull_max: float = 0.5) -> DataFrame:
    """``pair_scan`` over a wider stability range."""
    return pair_scan(materials, pairs, limit_per_pair, energy_above_hull_max)


def lookup(materials: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """Properties of a list of ids; ids without a material keep null properties."""
    return wanted.select("material_id").distinct().join(materials.select("material_id", *fields), "material_id", "left")


def method_table(spark: SparkSession) -> DataFrame:
    keys = refdata.synthesis_methods(spark).select("method_order", "method_key")
    return with_method_details(keys).orderBy("method_order").drop("method_order")
