"""Joins of materials with features, outcomes, elements and methods. Many rows may share a formula, or lack one, so that joins by
formula split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.functions import composition
from alloyscreen.functions.methods import method_scores
from alloyscreen.operators.hot_joins import hot_join

#: Rows of a pool that every task may hold.
HELD_ROWS = 10_000


def join_features(features: DataFrame, raw: DataFrame, columns=("formula", "elements")) -> DataFrame:
    """Features with columns of the raw table, by ``material_id``."""
    return features.join(raw.select("material_id", *columns), "material_id")


def has_outcome(materials: DataFrame, outcomes: DataFrame) -> DataFrame:
    return hot_join(materials, outcomes.select("formula").distinct(), ["formula"], "left_semi")


def no_outcome(materials: DataFrame, outcomes: DataFrame) -> DataFrame:
    return hot_join(materials, outcomes.select("formula").distinct(), ["formula"], "left_anti")


def filter_by_outcome(materials: DataFrame, outcomes: DataFrame, status: str) -> DataFrame:
    if status == "Has Outcome Logged":
        return has_outcome(materials, outcomes)
    if status == "No Outcome Logged":
        return no_outcome(materials, outcomes)
    return materials


def enrich_outcomes(outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """Predictions and hull energy of the first result (by id) with the outcome's formula."""
    first = results.groupBy("formula").agg(
        F.min_by(
            F.struct("synthesizability_probability", "rule_probability", "energy_above_hull"), "material_id"
        ).alias("_first")
    )
    joined = hot_join(outcomes.drop("ml_pred", "llm_pred", "e_hull"), first, ["formula"], "left")
    return joined.withColumns(
        {
            "ml_pred": F.col("_first.synthesizability_probability"),
            "llm_pred": F.col("_first.rule_probability"),
            "e_hull": F.col("_first.energy_above_hull"),
        }
    ).drop("_first")


def map_net_benefit(materials: DataFrame, benefits: DataFrame) -> DataFrame:
    """``estimated_net_benefit`` by formula; of several benefits for a formula the last by id counts."""
    last = benefits.groupBy("formula").agg(F.max_by("net_benefit", "material_id").alias("estimated_net_benefit"))
    return hot_join(materials, last, ["formula"], "left")


def top_up(pool: DataFrame, candidates: DataFrame, shortfall: int, order: list, held: bool = False) -> DataFrame:
    """Best candidates whose formula the pool lacks, as many as are short. A pool of at most ``HELD_ROWS`` rows may be ``held`` by every task."""
    known = pool.select("formula").distinct()
    lacking = candidates.join(F.broadcast(known), "formula", "left_anti") if held else hot_join(candidates, known, ["formula"], "left_anti")
    return lacking.orderBy(*order).limit(shortfall)


def slot_properties(df: DataFrame, keep=("material_id",)) -> DataFrame:
    """One row per material and used slot, with the properties of the element. Unknown elements drop out."""
    long = df.select(*keep, F.posexplode(composition.slots(df)).alias("slot", "used"))
    long = long.select(*keep, (F.col("slot") + 1).alias("slot"), F.col("used.element").alias("symbol"), F.col("used.fraction").alias("fraction"))
    return long.join(F.broadcast(refdata.alloy_elements(df.sparkSession)), "symbol")


def material_methods(df: DataFrame, keep=("material_id",)) -> DataFrame:
    """Material by method, from a literal array of the eight methods: no join takes place."""
    return method_scores(df, keep=keep)
