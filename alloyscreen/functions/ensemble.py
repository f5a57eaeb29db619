"""Decisions, ensemble of classifier and rules, and live thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.functions.basics import clip, flag, with_computed


def distance_confidence(p: Column) -> Column:
    return F.abs(p - 0.5) * 2


def with_decision(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = F.col("synthesizability_probability")
    return df.withColumns(
        {"synthesizability_prediction": flag(p >= threshold), "synthesizability_confidence": distance_confidence(p)}
    )


def with_ensemble(df: DataFrame, ml_weight: float | None = None, policy: dict | None = None) -> DataFrame:
    """Weighted mean of classifier and rule probability; the classifier counts more near its training data."""
    policy = policy or refdata.ENSEMBLE_POLICY
    base = policy["ml_weight"] if ml_weight is None else ml_weight
    if "in_distribution" in df.columns:
        shift = F.when(F.col("in_distribution") == "in-dist", F.lit(policy["in_dist_bonus"])).otherwise(
            F.lit(policy["out_dist_penalty"])
        )
        weight = clip(F.lit(base) + shift, policy["ml_weight_min"], policy["ml_weight_max"])
    else:
        weight = F.lit(base)
    ml, rule = F.col("synthesizability_probability"), F.col("rule_probability")
    out = with_computed(df, {"ensemble_probability": weight * ml + (F.lit(1.0) - weight) * rule})
    p = F.col("ensemble_probability")
    agreement = F.lit(1.0) - F.abs(ml - rule) * 0.35
    return out.withColumns(
        {"ensemble_prediction": flag(p >= 0.5), "ensemble_confidence": clip(distance_confidence(p) * agreement, 0.0, 1.0)}
    )


def with_fixed_ensemble(df: DataFrame, ml_weight: float = 0.7) -> DataFrame:
    mixed = F.col("synthesizability_probability") * ml_weight + F.col("rule_probability") * (1.0 - ml_weight)
    out = with_computed(df, {"ensemble_probability": mixed})
    p = F.col("ensemble_probability")
    return out.withColumns({"ensemble_prediction": flag(p >= 0.5), "ensemble_confidence": distance_confidence(p)})


def live_gate(
    df: DataFrame,
    min_probability: float = refdata.LIVE_GATE["min_probability"],
    max_energy_above_hull: float = refdata.LIVE_GATE["max_energy_above_hull"],
    require_in_distribution: bool = refdata.LIVE_GATE["require_in_distribution"],
) -> Column:
    passed = (F.col("ensemble_probability") >= min_probability) & (F.col("energy_above_hull") <= max_energy_above_hull)
    if require_in_distribution and "in_distribution" in df.columns:
        passed = passed & (F.col("in_distribution") == "in-dist")
    return F.coalesce(passed, F.lit(False))
