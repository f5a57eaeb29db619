"""Materials and outcomes as projections of the TPC-H-like test tables (``lineitem``, ``events``).

The expressions are plain SQL that reads the same in Spark and in the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloyscreen.functions.composition import element_array, slots_formula
from alloyscreen.session import spread, tuned

SYMBOLS = "'Al,Ti,V,Cr,Mn,Fe,Co,Ni,Cu,Zn,Cd,Pb'"
TERNARY = "l_orderkey % 10 < 3"
HULL_STEP = "(l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 100"
GAP_STEP = "(l_orderkey + l_partkey * 3) % 100"
HUNDRED = "CAST(100 AS DOUBLE)"

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag"]

MATERIAL_COLUMNS = {
    "material_id": "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), "
    "'-', CAST(l_suppkey AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))",
    "element_1": f"split_part({SYMBOLS}, ',', CAST(l_partkey % 12 + 1 AS INT))",
    "element_2": f"split_part({SYMBOLS}, ',', CAST((l_partkey % 12 + 1 + l_suppkey % 5) % 12 + 1 AS INT))",
    "element_3": f"CASE WHEN {TERNARY} THEN split_part({SYMBOLS}, ',', CAST((l_partkey % 12 + 6 + l_suppkey % 3) % 12 + 1 AS INT)) END",
    "composition_1": f"CASE WHEN {TERNARY} THEN CAST(10 + l_partkey % 41 AS DOUBLE) / {HUNDRED} "
    f"ELSE CAST(5 + l_partkey % 91 AS DOUBLE) / {HUNDRED} END",
    "composition_2": f"CASE WHEN {TERNARY} THEN CAST(10 + l_suppkey % 31 AS DOUBLE) / {HUNDRED} "
    f"ELSE CAST(95 - l_partkey % 91 AS DOUBLE) / {HUNDRED} END",
    "composition_3": f"CASE WHEN {TERNARY} THEN CAST(80 - l_partkey % 41 - l_suppkey % 31 AS DOUBLE) / {HUNDRED} "
    "ELSE CAST(0 AS DOUBLE) END",
    "energy_above_hull": f"CAST(({HULL_STEP}) * ({HULL_STEP}) AS DOUBLE) / CAST(25000 AS DOUBLE)",
    "formation_energy_per_atom": f"CAST((l_orderkey * 13 + l_partkey) % 1400 - 1150 AS DOUBLE) / {HUNDRED}",
    "band_gap": f"CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(({GAP_STEP}) * ({GAP_STEP}) AS DOUBLE) / CAST(1100 AS DOUBLE) END",
    "density": "CAST((l_suppkey * 17 + l_orderkey) % 320 + 5 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "electronegativity": f"CAST((l_partkey * 5 + l_linenumber * 31) % 250 + 60 AS DOUBLE) / {HUNDRED}",
    "atomic_radius": f"CAST((l_orderkey * 3 + l_suppkey) % 200 + 70 AS DOUBLE) / {HUNDRED}",
    "nsites": "CAST(1 + (l_partkey + l_orderkey) % 40 AS INT)",
    "synthesizability_probability": "CAST((l_orderkey * 29 + l_partkey * 3 + l_linenumber) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "in_distribution": "CASE WHEN l_returnflag = 'R' THEN 'out-dist' ELSE 'in-dist' END",
}

OUTCOME_COLUMNS = {
    "outcome_id": "event_id",
    "attempted_date": "ts",
    "outcome": "split_part('Successful,Partial success,Failed,Not yet attempted', ',', CAST(event_id % 4 + 1 AS INT))",
    "ml_pred": "CAST((event_id * 37 + user_id) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "llm_pred": "CAST((event_id * 53 + user_id) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "e_hull": "CAST(event_id % 400 AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "notes": "event_type",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_materials(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(*[f"{e} AS {c}" for c, e in MATERIAL_COLUMNS.items()])


def as_outcomes(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{e} AS {c}" for c, e in OUTCOME_COLUMNS.items()])


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_materials(spread(table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)))


def with_formula(df: DataFrame) -> DataFrame:
    return df.withColumn("formula", slots_formula(df))


def with_elements(df: DataFrame) -> DataFrame:
    return df.withColumn("elements", element_array(df))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with a formula: that of the first material whose order number is the outcome's id, if there is one."""
    lines = table(spark, sf_dir, "lineitem")
    found = with_formula(lines.selectExpr("l_orderkey AS outcome_id", *[f"{e} AS {c}" for c, e in MATERIAL_COLUMNS.items()]))
    formulas = found.groupBy("outcome_id").agg(F.min_by("formula", "material_id").alias("formula"))
    return as_outcomes(table(spark, sf_dir, "events")).join(formulas, "outcome_id", "left")
