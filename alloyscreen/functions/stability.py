"""Thermodynamic stability: categories, score, flags, labels and the rule-based synthesizability score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.functions.basics import clip, column_or, fixed_text, flag, points, texts

HIGHLY_STABLE_MAX = refdata.STABILITY_CLASSES[0][1]
MARGINAL_MAX = refdata.STABILITY_CLASSES[1][1]


def by_hull(hull: Column, stable, marginal, beyond) -> Column:
    """One of three values by energy above hull; an unknown hull energy counts as beyond every limit."""
    return (
        F.when(hull <= HIGHLY_STABLE_MAX, F.lit(stable)).when(hull <= MARGINAL_MAX, F.lit(marginal))
        .otherwise(F.lit(beyond))
    )


def stability_category(hull: Column) -> Column:
    return by_hull(hull, *(c[0] for c in refdata.STABILITY_CLASSES))


def stability_info(hull: Column) -> Column:
    """Category with its description, confidence and limit, as one struct."""
    category, limit, description, confidence = zip(*refdata.STABILITY_CLASSES)
    return F.struct(
        by_hull(hull, *category).alias("category"),
        by_hull(hull, *description).alias("description"),
        by_hull(hull, *confidence).alias("synthesis_confidence"),
        hull.alias("energy_above_hull"),
        by_hull(hull, *limit).alias("threshold_used"),
    )


# Limits and factors of the stability score.
SCORE_BY_CLASS = (0.9, 0.6, 0.2)
EXTREME_FORMATION = (-10.0, 2.0, 0.8)
EXTREME_DENSITY = (1.0, 30.0, 0.7)
SEMICONDUCTOR_GAP = (0.5, 4.0, 1.1)


def stability_score(df: DataFrame) -> Column:
    hull = column_or(df, "energy_above_hull", 0.1)
    formation = column_or(df, "formation_energy_per_atom", 0.0)
    density = column_or(df, "density", 5.0)
    gap = column_or(df, "band_gap", 1.0)

    def outside(c: Column, low: float, high: float, factor: float) -> Column:
        return F.when((c < low) | (c > high), F.lit(factor)).otherwise(F.lit(1.0))

    base = by_hull(hull, *SCORE_BY_CLASS) * outside(formation, *EXTREME_FORMATION) * outside(density, *EXTREME_DENSITY)
    low, high, boost = SEMICONDUCTOR_GAP
    return F.when(gap.between(low, high), F.least(base * boost, F.lit(1.0))).otherwise(base)


def with_stability(df: DataFrame) -> DataFrame:
    hull = column_or(df, "energy_above_hull", 0.1)
    return df.withColumns(
        {
            "thermodynamic_stability_score": stability_score(df),
            "thermodynamic_stability_category": by_hull(hull, "highly_stable", "marginal", "unstable"),
            "stability_color": by_hull(hull, "green", "yellow", "red"),
        }
    )


def with_stability_flags(df: DataFrame) -> DataFrame:
    stable = F.col("energy_above_hull") <= 0.1
    reasonable = F.col("formation_energy_per_atom").between(-10, 2)
    return df.withColumns(
        {
            "thermodynamically_stable": F.coalesce(stable, F.lit(False)),
            "formation_energy_reasonable": F.coalesce(reasonable, F.lit(False)),
            "overall_stability": F.coalesce(stable & reasonable, F.lit(False)),
        }
    )


def label_stability(df: DataFrame, label: str = "synthesizable") -> DataFrame:
    """1 for clearly stable rows, 0 for clearly unstable ones; the rows between carry no label and are left out."""
    hull = F.col("energy_above_hull")
    return df.withColumn(label, F.when(hull <= HIGHLY_STABLE_MAX, 1).when(hull >= MARGINAL_MAX, 0)).filter(
        F.col(label).isNotNull()
    )


def label_proxy(df: DataFrame, label: str = "synthesizable") -> DataFrame:
    return df.withColumn(label, flag(F.col("energy_above_hull") <= MARGINAL_MAX))


# The seven rules as (column, value if absent, lowest, highest, points, decimals, text before, text
# after, verdict if inside, verdict if outside).
RULES = [
    ("energy_above_hull", 0.0, None, 0.1, 2.0, 3,
     "Low energy above hull (", "High energy above hull (", " eV/atom) indicates stability",
     " eV/atom) indicates instability"),
    ("formation_energy_per_atom", 0.0, -4.0, 1.0, 1.5, 3,
     "Formation energy (", "Formation energy (", " eV/atom) is reasonable", " eV/atom) is extreme"),
    ("nsites", 10, None, 20, 1.0, 0,
     "Unit cell size (", "Unit cell size (", " sites) is reasonable", " sites) is very large"),
    ("density", 5.0, 2.0, 25.0, 1.0, 1, "Density (", "Density (", " g/cm³) is reasonable", " g/cm³) is unusual"),
    ("band_gap", 0.0, None, 8.0, 1.5, 1, "Band gap (", "Band gap (", " eV) is reasonable", " eV) is very wide"),
    ("electronegativity", 1.5, 0.7, 2.8, 1.0, 2,
     "Electronegativity (", "Electronegativity (", ") is reasonable", ") is extreme"),
    ("atomic_radius", 1.4, 0.8, 2.5, 1.0, 2,
     "Atomic radius (", "Atomic radius (", " Å) is reasonable", " Å) is unusual"),
]
RULE_MAX_SCORE = 10.0


def _inside(value: Column, low, high) -> Column:
    return value <= high if low is None else value.between(low, high)


def rule_score(df: DataFrame) -> Column:
    total = F.lit(0.0)
    for name, default, low, high, worth, *_ in RULES:
        total = total + points(_inside(column_or(df, name, default), low, high), worth)
    return total


def rule_reasons(df: DataFrame) -> Column:
    """One sentence per rule, in rule order."""
    sentences = []
    for name, default, low, high, _, digits, good_lead, bad_lead, good, bad in RULES:
        value = column_or(df, name, default)
        shown = fixed_text(value, digits)
        sentences.append(
            F.when(_inside(value, low, high), F.concat(F.lit(good_lead), shown, F.lit(good))).otherwise(
                F.concat(F.lit(bad_lead), shown, F.lit(bad))
            )
        )
    return F.array(*sentences)


def rule_probability(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp((score - RULE_MAX_SCORE / 2) * -2.0))


def with_rules(df: DataFrame, reasons: bool = False) -> DataFrame:
    """Rule score, probability, prediction and confidence; ``reasons`` adds the sentences (only worth it for reports)."""
    out = df.withColumn("rule_score", rule_score(df))
    out = out.withColumn("rule_probability", rule_probability(F.col("rule_score")))
    p = F.col("rule_probability")
    out = out.withColumns(
        {"rule_prediction": flag(p >= 0.5), "rule_confidence": F.abs(p - 0.5) * 2, "rule_max_score": F.lit(RULE_MAX_SCORE)}
    )
    return out.withColumn("rule_reasons", rule_reasons(df)) if reasons else out


def boundary_confidence(p: Column) -> Column:
    """Confidence that is highest at the decision boundary: 2·min(p, 1-p)."""
    return F.least(p, F.lit(1.0) - p) * 2


# Precursor routes.
SOLID_STATE = ("Solid State Reaction", ["Elemental powders", "Binary oxides"], "800-1200°C", "Medium", 0.8)
ARC_MELTING = ("Arc Melting", ["Pure elements", "Master alloy"], "High temperature", "Low", 0.9)
VAPOR_DEPOSITION = (
    "Chemical Vapor Deposition", ["Metal halides", "Hydrogen", "Inert gas"], "600-1000°C", "High", 0.6,
)


def _route(route: tuple) -> Column:
    method, precursors, temperature, difficulty, success = route
    return F.struct(
        F.lit(method).alias("method"),
        F.array(*[F.lit(p) for p in precursors]).alias("precursors"),
        F.lit(temperature).alias("temperature_range"),
        F.lit(difficulty).alias("difficulty"),
        F.lit(success).alias("success_probability"),
    )


def linear_stability(df: DataFrame) -> Column:
    return clip(F.lit(1.0) - column_or(df, "energy_above_hull", 0.0) / 0.5, 0.0, 1.0)


def precursor_routes(df: DataFrame) -> Column:
    """Array of suitable synthesis routes, in fixed order."""
    return texts(
        F.when(linear_stability(df) > 0.7, _route(SOLID_STATE)),
        F.when(column_or(df, "band_gap", 0.0) < 2.0, _route(ARC_MELTING)),
        _route(VAPOR_DEPOSITION),
    )
