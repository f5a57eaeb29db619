"""Laboratory safety gate, safety classes and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.functions.basics import column_or, fixed_text, joined
from alloyscreen.functions.composition import element_array

SAFE, REVIEW, UNSAFE = "safe", "human_review", "unsafe"


def _findings(df: DataFrame, safe_mode: bool, override: bool, policy: dict) -> tuple[list, list]:
    """(reasons against export, warnings) as pairs of a never-null flag and its text."""
    blacklist = F.array(*[F.lit(e) for e in policy["blacklist_elements"]])
    elements = element_array(df)
    hazardous = F.arrays_overlap(elements, blacklist)
    listed = F.array_join(F.array_intersect(elements, blacklist), ", ")

    p = column_or(df, "ensemble_probability", 0.0).cast("double")
    limit = policy["ensemble_probability_min"] if safe_mode else policy["relaxed_probability_min"]
    stability = F.coalesce(column_or(df, "thermodynamic_stability_category", "unknown"), F.lit("unknown"))
    required = policy["thermodynamic_stability_required"]
    off_class = stability != required
    distribution = F.coalesce(column_or(df, "in_distribution", "unknown"), F.lit("unknown"))
    far = (distribution != "in-dist") if policy["in_distribution_required"] else F.lit(False)

    # A missing probability never passes.
    enough = F.coalesce((p >= limit) & ~F.isnan(p), F.lit(False))
    low_text = F.coalesce(
        F.concat(F.lit("Ensemble probability too low: "), fixed_text(p, 3), F.lit(f" < {limit}")),
        F.lit("Ensemble probability missing"),
    )
    reasons, warnings = [], []
    if override:
        warnings.append((hazardous, F.concat(F.lit("Human override approved for hazardous elements: "), listed)))
    else:
        reasons.append((hazardous, F.concat(F.lit("Contains hazardous elements: "), listed)))
    reasons.append((~enough, low_text))
    if safe_mode and override:
        warnings.append((off_class, F.concat(F.lit("Human override for stability: "), stability)))
    elif safe_mode:
        reasons.append((off_class, F.concat(F.lit(f"Stability category not '{required}': "), stability)))
    elif not override:
        reasons.append((stability == "unstable", F.concat(F.lit("Unstable material: "), stability)))
    if safe_mode and not override:
        reasons.append((far, F.concat(F.lit("Out-of-distribution material: "), distribution)))
    else:
        warnings.append((far, F.lit("Out-of-distribution material: predictions may be less reliable")))
    return reasons, warnings


def _passes(reasons: list) -> Column:
    """No reason applies. Built from the flags alone, so that filters on it do not build any text."""
    passed = F.lit(True)
    for applies, _ in reasons:
        passed = passed & ~applies
    return passed


def _texts(findings: list) -> Column:
    return joined("; ", *[F.when(applies, text) for applies, text in findings]) if findings else F.lit("")


def with_safety_check(
    df: DataFrame, safe_mode: bool = True, human_override: bool = False, policy: dict | None = None
) -> DataFrame:
    reasons, warnings = _findings(df, safe_mode, human_override, policy or refdata.HAZARD_POLICY)
    passed = _passes(reasons)
    return df.withColumns(
        {
            "safety_check_passed": passed,
            "safety_reason": F.when(passed, F.lit("Safe for export")).otherwise(_texts(reasons)),
            "safety_warnings": _texts(warnings),
        }
    )


def with_safety_class(
    df: DataFrame, safe_mode: bool = True, human_override: bool = False, policy: dict | None = None
) -> DataFrame:
    """Safe, safe only with a human override, or unsafe: both checks in one projection."""
    policy = policy or refdata.HAZARD_POLICY
    reasons, warnings = _findings(df, safe_mode, human_override, policy)
    reasons_left, warnings_left = _findings(df, safe_mode, True, policy)
    passed = _passes(reasons)
    needs = ~passed & _passes(reasons_left) if policy["human_override_allowed"] else F.lit(False)
    return df.withColumns(
        {
            "safety_check_passed": passed,
            "safety_reason": F.when(passed, F.lit("Safe for export")).otherwise(_texts(reasons)),
            "safety_warnings": F.when(needs, _texts(warnings_left)).otherwise(_texts(warnings)),
            "safety_class": F.when(passed, SAFE).when(needs, REVIEW).otherwise(UNSAFE),
            "requires_human_override": needs,
        }
    )


RATING_COLUMNS = ["safety_check_passed", "safety_reason", "safety_warnings", "requires_human_override", "safety_rating"]


def with_safety_rating(df: DataFrame, policy: dict | None = None) -> DataFrame:
    """Rating 1.0 safe, 0.5 safe with override, 0.0 unsafe. A frame that carries all safety columns is left alone."""
    if all(c in df.columns for c in RATING_COLUMNS):
        return df
    out = with_safety_class(df, policy=policy)
    rating = F.when(F.col("safety_class") == SAFE, 1.0).when(F.col("safety_class") == REVIEW, 0.5).otherwise(0.0)
    return out.withColumn("safety_rating", rating)


def with_element_safety(df: DataFrame, policy: dict | None = None) -> DataFrame:
    """Screening by elements alone, for tables without predictions."""
    policy = policy or refdata.HAZARD_POLICY
    blacklist = F.array(*[F.lit(e) for e in policy["blacklist_elements"]])
    hazardous = F.arrays_overlap(element_array(df), blacklist)
    return df.withColumns(
        {
            "safety_check_passed": ~hazardous,
            "safety_reason": F.when(hazardous, F.lit("Contains hazardous element(s)")).otherwise(
                F.lit("Fallback safety pass (no blacklisted elements detected)")
            ),
            "safety_warnings": F.lit(""),
            "requires_human_override": hazardous,
            "safety_rating": F.when(hazardous, 0.5).otherwise(1.0),
        }
    )


# Note texts.
STABILITY_NOTES = {
    "highly_stable": "Highly stable - good candidate",
    "marginal": "Marginally stable - proceed with care",
    "unstable": "Unstable - high risk",
}
CALIBRATION_NOTES = {
    "well-calibrated": "Well-calibrated prediction",
    "overconfident": "Model may be overconfident",
    "underconfident": "Model may be underconfident",
}
DISTRIBUTION_NOTES = {"out-dist": "Out-of-distribution - predictions less reliable"}


def lab_notes(df: DataFrame) -> Column:
    def note(name: str, table: dict) -> Column:
        value = column_or(df, name, "")
        chosen = F.lit(None).cast("string")
        for key, text in table.items():
            chosen = F.when(value == key, F.lit(text)).otherwise(chosen)
        return chosen

    notes = joined(
        "; ",
        note("thermodynamic_stability_category", STABILITY_NOTES),
        note("calibration_status", CALIBRATION_NOTES),
        note("in_distribution", DISTRIBUTION_NOTES),
    )
    return F.when(notes == "", F.lit("No special notes")).otherwise(notes)


def with_priority_level(df: DataFrame, step: str = "workflow_step") -> DataFrame:
    s = F.col(step)
    level = F.when((s > 0) & (s <= 3), "High").when((s > 3) & (s <= 7), "Medium").when((s > 7) & (s <= 10), "Low")
    return df.withColumn("priority_level", level)
