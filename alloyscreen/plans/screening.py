"""Screening of candidates, as one lazy plan up to the rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloyscreen.functions import composition, ensemble, methods, safety, stability
from alloyscreen.operators import aggregates, mapping, ranking


def score(materials: DataFrame, ml_weight: float | None = None) -> DataFrame:
    """Fields completed, stability, rules and ensemble. Works on batch and streaming frames alike."""
    return (
        materials.transform(mapping.copy_aliases)
        .transform(stability.with_stability)
        .transform(stability.with_rules)
        .transform(ensemble.with_ensemble, ml_weight)
    )


def screen(materials: DataFrame, equipment: list[str] | None = None, ml_weight: float | None = None) -> DataFrame:
    """Scores, priority, weight percents, best method and cost-benefit of every candidate, without a shuffle."""
    return (
        score(materials, ml_weight)
        .transform(ranking.with_priority_score)
        .transform(methods.with_cost_benefit, equipment)
        .transform(composition.with_weight_percent)
    )


def top_candidates(materials: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` best candidates by priority."""
    scored = score(materials).transform(ranking.with_priority_score)
    order = [F.desc(F.round("synthesis_priority_score", 9)), F.col("material_id")]
    return ranking.top_n(scored, n, order)


def summary(materials: DataFrame, equipment: list[str] | None = None) -> DataFrame:
    screened = score(materials).transform(ranking.with_priority_score).transform(methods.with_cost_benefit, equipment)
    return aggregates.generation_summary(screened)


def safety_first(materials: DataFrame) -> DataFrame:
    """Stable candidates only, with fixed ensemble, safety rating, composite and final score."""
    return (
        materials.transform(stability.with_stability_flags)
        .filter(F.col("overall_stability"))
        .transform(stability.with_stability)
        .transform(stability.with_rules)
        .transform(ensemble.with_fixed_ensemble)
        .transform(safety.with_safety_rating)
        .transform(ranking.with_composite_score)
        .transform(ranking.with_final_score)
    )


def safety_first_pool(materials: DataFrame, top: int | None = None, confidence: float = 0.60, minimum: int = 10) -> DataFrame:
    """Candidate pool by the net benefits of all candidates, or of the ``top`` best alone."""
    ranked = safety_first(materials)
    best = ranked if top is None else ranking.top_n(ranked, top, ranking.final_order())
    best = best.transform(methods.with_simple_cost_benefit)
    benefits = best.select("formula", "material_id", F.col("simple_net_benefit").alias("net_benefit"))
    return ranking.candidate_pool(ranked, benefits, confidence, minimum)
