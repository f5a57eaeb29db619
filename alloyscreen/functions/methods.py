"""Synthesis-method choice and cost-benefit model, without any join: the eight methods are literals in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.functions.basics import clip, column_or, points, with_computed
from alloyscreen.functions.stability import linear_stability, stability_score

METHOD_FIELDS = [f.split()[0] for f in refdata.METHOD_DDL.split(", ")]


# Rates and market values of the cost-benefit model.
LABOR_RATE = 50.0
SYNTHESIS_RATE_FACTOR, COOLING_RATE_FACTOR = 1.5, 0.5
EQUIPMENT_SHARE, MATERIAL_SHARE = 0.1, 0.3
SUCCESS_BONUS, SUCCESS_MIN, SUCCESS_MAX = 1.1, 0.1, 0.95
VALUE_WIDE_GAP, VALUE_SEMICONDUCTOR, VALUE_CONDUCTOR, VALUE_OTHER = 50000.0, 30000.0, 20000.0, 15000.0


def available_methods(equipment: list[str] | None) -> list[tuple[int, dict]]:
    """(order, method) for the methods whose equipment is at hand. ``None`` means that everything is."""
    chosen = []
    for order, row in enumerate(refdata.METHODS, start=1):
        method = dict(zip(METHOD_FIELDS, row))
        if equipment is None or set(method["equipment_needed"]) <= set(equipment):
            chosen.append((order, method))
    return chosen


def equipment_ok(needed: Column, available: Column) -> Column:
    return F.size(F.array_except(needed, available)) == 0


def suitability(df: DataFrame, stability: Column) -> dict[str, Column]:
    """Points per method before success rate and cost are taken into account."""
    q = column_or(df, "ensemble_probability", 0.5)
    gap = column_or(df, "band_gap", 1.0)
    density = column_or(df, "density", 7.0)
    metallic = gap < 2.0
    return {
        "arc_melting": points(metallic, 3.0) + points(density > 6.0, 1.0),
        "induction_melting": points(metallic, 2.5),
        "resistance_furnace": points(stability > 0.6, 2.0) + points(gap > 1.5, 1.5),
        "vacuum_arc_melting": points(metallic, 2.5) + points(stability < 0.7, 1.0),
        "plasma_arc_melting": F.lit(0.0),
        "solid_state_reaction": points(stability > 0.7, 3.0) + points(q > 0.7, 1.5) + 1.0,
        "chemical_vapor_deposition": points(stability < 0.6, 2.0) + points(gap > 1.0, 1.5),
        "mechanical_alloying": points(stability < 0.6, 2.5) + points(metallic, 1.0),
    }


def _total_cost(m: dict) -> float:
    hours = (
        m["prep_time_hours"]
        + m["synthesis_time_hours"] * SYNTHESIS_RATE_FACTOR
        + m["cooling_time_hours"] * COOLING_RATE_FACTOR
    )
    return hours * LABOR_RATE + m["estimated_cost_usd"] * (EQUIPMENT_SHARE + MATERIAL_SHARE)


def _ranked(df: DataFrame, equipment: list[str] | None) -> list[Column]:
    """Score, tie order and attributes of each available method. Needs the column ``_stability``."""
    base = suitability(df, F.col("_stability"))
    return [
        F.struct(
            (base[m["method_key"]] * m["success_probability"] / (m["estimated_cost_usd"] / 100)).alias("score"),
            F.lit(-order).alias("tie_order"),
            F.lit(m["method_key"]).alias("method_key"),
            F.lit(m["method_name"]).alias("method_name"),
            F.lit(m["success_probability"]).alias("success"),
            F.lit(_total_cost(m)).alias("cost"),
        )
        for order, m in available_methods(equipment)
    ]


BEST_TYPE = (
    "struct<score: double, tie_order: int, method_key: string, method_name: string, success: double, cost: double>"
)


def method_scores(df: DataFrame, equipment: list[str] | None = None, keep=("material_id",)) -> DataFrame:
    """One row per material and available method."""
    ranked = _ranked(df, equipment)
    scores = F.array(*ranked) if ranked else F.array().cast(f"array<{BEST_TYPE}>")
    scored = df.withColumn("_stability", stability_score(df))
    return scored.select(*keep, F.inline(scores)).select(*keep, "method_key", F.col("score").alias("method_score"))


def _with_best(df: DataFrame, equipment: list[str] | None) -> DataFrame:
    ranked = _ranked(df, equipment)
    best = F.array_max(F.array(*ranked)) if ranked else F.lit(None).cast(BEST_TYPE)
    return with_computed(df.withColumn("_stability", stability_score(df)), {"_best": best}).drop("_stability")


def with_best_method(df: DataFrame, equipment: list[str] | None = None) -> DataFrame:
    """Key and score of the best available method; earlier methods win ties; null when none is available."""
    return _with_best(df, equipment).withColumns(
        {"method_key": F.col("_best.method_key"), "method_score": F.col("_best.score")}
    ).drop("_best")


def with_method_details(df: DataFrame) -> DataFrame:
    """Details of the chosen method from the fixed table of eight methods."""
    m = refdata.synthesis_methods(df.sparkSession)
    hours = F.col("prep_time_hours") + F.col("synthesis_time_hours") + F.col("cooling_time_hours")
    detail = m.select(
        "method_key",
        "method_name",
        F.col("description").alias("method_description"),
        F.format_string("%d°C (%d-%d°C)", "temperature_typical", "temperature_min", "temperature_max").alias("temperature_range"),
        "atmosphere",
        F.array_join("equipment_needed", ", ").alias("equipment_needed"),
        hours.alias("total_time_hours"),
        "estimated_cost_usd",
        F.col("success_probability").alias("method_success_rate"),
        F.array_join(F.slice("best_for", 1, 2), ", ").alias("best_for"),
        F.array_join("limitations", ", ").alias("limitations"),
        F.col("reference").alias("method_reference"),
    )
    return df.join(F.broadcast(detail), "method_key", "left")


def with_cost_benefit(df: DataFrame, equipment: list[str] | None = None) -> DataFrame:
    """Best method with adjusted success, costs, value, net benefit and ratio; zeros when no method is available."""
    out = _with_best(df, equipment)
    stability = column_or(df, "thermodynamic_stability_score", 0.5)
    q = column_or(df, "ensemble_probability", 0.5)
    gap = column_or(df, "band_gap", 1.0)
    adjusted = clip(F.col("_best.success") * stability * q * SUCCESS_BONUS, SUCCESS_MIN, SUCCESS_MAX)
    value = (
        F.when(gap > 2.5, F.lit(VALUE_WIDE_GAP)).when(gap > 1.5, F.lit(VALUE_SEMICONDUCTOR))
        .when(gap < 0.5, F.lit(VALUE_CONDUCTOR)).otherwise(F.lit(VALUE_OTHER))
    ) * stability * q
    out = out.withColumns({"_success": adjusted, "_value": value})
    known = F.col("_best").isNotNull()
    out = out.withColumns(
        {
            "method_key": F.col("_best.method_key"),
            "method_score": F.col("_best.score"),
            "recommended_method": F.coalesce(F.col("_best.method_name"), F.lit("No suitable method available")),
            "success_probability": F.when(known, F.col("_success")).otherwise(0.0),
            "total_cost": F.when(known, F.col("_best.cost")).otherwise(0.0),
            "expected_cost": F.when(known, F.col("_best.cost") / F.col("_success")).otherwise(0.0),
            "expected_value": F.when(known, F.col("_value") * F.col("_success")).otherwise(0.0),
        }
    ).drop("_best", "_success", "_value")
    cost, worth = F.col("expected_cost"), F.col("expected_value")
    return out.withColumns(
        {
            "net_benefit": worth - cost,
            "benefit_cost_ratio": F.when(cost > 0, F.try_divide(worth, cost)).otherwise(0.0),
        }
    )


# Fixed values: (method, total of its cost items, success factor, success limit) of the three-method model.
SIMPLE_ARC = ("arc_melting", 508.0, 1.2, 0.9)
SIMPLE_SOLID = ("solid_state", 1148.0, 1.1, 0.8)
SIMPLE_CVD = ("cvd", 3372.0, 1.0, 0.6)


def with_simple_cost_benefit(df: DataFrame, prefix: str = "simple_") -> DataFrame:
    """Three-method model on the classifier probability. Ratios with a zero success probability are null."""
    s = linear_stability(df)
    q = column_or(df, "synthesizability_probability", 0.5)
    gap = column_or(df, "band_gap", 0.0)

    def choose(pick) -> Column:
        return F.when(gap < 2.0, pick(SIMPLE_ARC)).when(s > 0.7, pick(SIMPLE_SOLID)).otherwise(pick(SIMPLE_CVD))

    value = F.when(gap > 1.5, F.lit(10000.0)).when(
        column_or(df, "total_magnetization", 0.0) > 0.1, F.lit(8000.0)
    ).otherwise(F.lit(5000.0)) * s * q
    out = df.withColumns(
        {
            f"{prefix}method": choose(lambda m: F.lit(m[0])),
            f"{prefix}success_probability": choose(lambda m: F.least(F.lit(m[3]), s * q * m[2])),
            f"{prefix}total_cost": choose(lambda m: F.lit(m[1])),
        }
    )
    success = F.col(f"{prefix}success_probability")
    out = out.withColumns(
        {
            f"{prefix}expected_cost": F.try_divide(F.col(f"{prefix}total_cost"), success),
            f"{prefix}expected_value": value * success,
        }
    )
    cost, worth = F.col(f"{prefix}expected_cost"), F.col(f"{prefix}expected_value")
    return out.withColumns(
        {f"{prefix}net_benefit": worth - cost, f"{prefix}benefit_cost_ratio": F.try_divide(worth, cost)}
    )


