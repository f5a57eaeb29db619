"""Priority scores, ranks, shortlists, pools and workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alloyscreen.functions import methods, safety
from alloyscreen.functions.basics import clip, column_or
from alloyscreen.operators import joins, ordered
from alloyscreen.session import materialize

# Weights of the priority score and of the safety-first score.
STABILITY_WEIGHT, PROBABILITY_WEIGHT, NOVELTY_WEIGHT, EASE_WEIGHT = 0.4, 0.3, 0.2, 0.1
CONFIDENCE_SHARE, PROBABILITY_SHARE, SAFETY_SHARE = 0.50, 0.30, 0.20
PRIORITY_SHARE, COMPOSITE_SHARE = 0.6, 0.4


def with_priority_score(df: DataFrame, probability: str = "ensemble_probability") -> DataFrame:
    hull = F.col("energy_above_hull")
    score = (
        (F.lit(1.0) - clip(hull, 0.0, 1.0)) * STABILITY_WEIGHT
        + column_or(df, probability, 0.5) * PROBABILITY_WEIGHT
        + clip(hull, 0.0, 0.5) / 0.5 * NOVELTY_WEIGHT
        + F.lit(1.0) / (F.lit(1.0) + F.col("nsites") / 10) * EASE_WEIGHT
    )
    return df.withColumn("synthesis_priority_score", score)


def priority_rank(df: DataFrame, probability: str = "ensemble_probability") -> DataFrame:
    scored = with_priority_score(df, probability)
    return ordered.with_average_rank(scored, "synthesis_priority_score", "synthesis_priority_rank")


def with_composite_score(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "composite_priority_score",
        F.col("ensemble_confidence") * CONFIDENCE_SHARE
        + F.col("ensemble_probability") * PROBABILITY_SHARE
        + F.col("safety_rating") * SAFETY_SHARE,
    )


def with_final_score(df: DataFrame, probability: str = "ensemble_probability") -> DataFrame:
    """Blend of priority and safety-first score; the plain priority score where no safety-first score exists."""
    out = df if "synthesis_priority_score" in df.columns else with_priority_score(df, probability)
    if "composite_priority_score" not in df.columns:
        return out.withColumn("final_priority_score", F.col("synthesis_priority_score"))
    return out.withColumn(
        "final_priority_score",
        F.col("synthesis_priority_score") * PRIORITY_SHARE + F.col("composite_priority_score") * COMPOSITE_SHARE,
    )


def final_values() -> list:
    """The values that decide the final order, each with whether it falls."""
    return [(F.round("final_priority_score", 9), True), (F.col("material_id"), False)]


def final_order() -> list:
    return ordered.sort_columns(final_values())


def final_rank(df: DataFrame) -> DataFrame:
    return ordered.with_row_rank(with_final_score(df), final_values(), "final_priority_rank")


def safety_first_values() -> list:
    rounded = [F.round(c, 9) for c in ("composite_priority_score", "ensemble_confidence")]
    return [(F.col("safety_rating"), True), *[(c, True) for c in rounded], (F.col("material_id"), False)]


def safety_first_order() -> list:
    return ordered.sort_columns(safety_first_values())


def safety_first_rank(df: DataFrame) -> DataFrame:
    return ordered.with_row_rank(df, safety_first_values(), "safety_first_rank")


def safety_first_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(*safety_first_order())


def shortlist(df: DataFrame, size: int = 20) -> DataFrame:
    """First safe rows; if no row is safe, the first rows that an override would allow.

    Both cases are top-k queries over one scan each; the flag is one scalar."""
    any_safe = df.agg(F.max(F.col("safety_check_passed")).alias("any_safe")).scalar()
    wanted = F.when(any_safe, F.col("safety_check_passed")).otherwise(F.col("requires_human_override"))
    return df.filter(wanted).orderBy(*safety_first_order()).limit(size)


def top_n(df: DataFrame, n: int, order: list) -> DataFrame:
    return df.orderBy(*order).limit(n)


def most_probable(df: DataFrame, n: int = 10, confidence: float = 0.8) -> DataFrame:
    return df.filter(F.col("ensemble_confidence") > confidence).orderBy(
        F.desc(F.round("ensemble_probability", 9)), "material_id"
    ).limit(n)


def candidate_pool(df: DataFrame, benefits: DataFrame, confidence: float = 0.60, minimum: int = 10) -> DataFrame:
    """Confident rows; only those with a positive net benefit if there are enough of them; topped up by final score
    otherwise. ``df`` needs ``final_priority_score``."""
    confident = df.filter(F.col("ensemble_confidence") >= confidence)
    if 0 < minimum <= joins.HELD_ROWS:
        # if there are fewer, these are all of them: no benefit of another formula is needed, and no row moves
        few = materialize(confident.limit(minimum))
        n = few.count()
        if n < minimum:
            formulas = F.broadcast(few.select("formula").distinct())
            pool = joins.map_net_benefit(few, benefits.join(formulas, "formula", "left_semi"))
            return pool.unionByName(joins.top_up(few, df, minimum - n, final_order(), True), allowMissingColumns=True)
    confident = joins.map_net_benefit(confident, benefits)
    # Two scalars decide the shape of the pool.
    counts = confident.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("estimated_net_benefit"), F.lit(0.0)) > 0).alias("efficient")
    ).first()
    if counts["efficient"] >= minimum:
        return confident.filter(F.col("estimated_net_benefit") > 0)
    if counts["n"] >= minimum:
        return confident
    more = joins.top_up(confident, df, minimum - counts["n"], final_order())
    return confident.unionByName(more, allowMissingColumns=True)


def experimental_workflow(df: DataFrame, top: int = 10, probability: str = "ensemble_probability") -> DataFrame:
    """The ``top`` rows by priority with step, batch of five, level, equipment and time of the best method in days."""
    scored = df if "synthesis_priority_score" in df.columns else with_priority_score(df, probability)
    best = scored.orderBy(F.desc(F.round("synthesis_priority_score", 9)), "material_id").limit(top)
    # At most ``top`` rows from here on.
    step = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("synthesis_priority_score", 9)), "material_id"))
    planned = best.withColumn("workflow_step", step).withColumn("batch_number", F.floor((F.col("workflow_step") - 1) / 5).cast("int") + 1)
    planned = methods.with_method_details(methods.with_best_method(safety.with_priority_level(planned)))
    return planned.select(
        "material_id", "workflow_step", "batch_number", "priority_level", "synthesis_priority_score", probability,
        "energy_above_hull", "formation_energy_per_atom",
        F.round(F.col("total_time_hours") / 24, 1).alias("estimated_time_days"),
        F.lit("Arc Melter/Furnace").alias("required_equipment"),
    )


def last_outcomes(outcomes: DataFrame, n: int = 10) -> DataFrame:
    return outcomes.orderBy(F.desc("attempted_date"), F.desc("outcome_id")).limit(n)


def last_hit_rate(outcomes: DataFrame, n: int = 10) -> DataFrame:
    return last_outcomes(outcomes, n).agg(
        F.count(F.lit(1)).alias("recent_experiments"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("outcome") == "Successful"), F.count(F.lit(1))), F.lit(0.0)
        ).alias("hit_rate_last_10"),
    )


def outcome_table(outcomes: DataFrame, n: int = 10) -> DataFrame:
    """Last outcomes with predicted probability and 0/1 success."""
    predicted = F.col("ml_pred") * 0.7 + F.col("llm_pred") * 0.3
    return last_outcomes(outcomes, n).select(
        "formula", "outcome", predicted.alias("predicted_probability"),
        F.when(F.col("outcome").isin("Successful", "Partial success"), 1).otherwise(0).alias("actual_success"), "notes",
    )


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key. Rows are first cut to ``n`` per key within groups of input partitions, so that the last
    step sees few rows per key even when one key holds most of the table."""
    slice_of = F.pmod(F.spark_partition_id(), F.lit(256))
    sliced = df.withColumn("_slice", slice_of)
    part = Window.partitionBy(*keys, "_slice").orderBy(*order)
    few = sliced.withColumn("_row", F.row_number().over(part)).filter(F.col("_row") <= n).drop("_row", "_slice")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return few.withColumn("_row", F.row_number().over(whole)).filter(F.col("_row") <= n).drop("_row")
