"""Feature tables for the classifier and the alloy models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloyscreen import schema
from alloyscreen.functions import composition, stability
from alloyscreen.functions.basics import clip, column_or
from alloyscreen.operators import aggregates, cleaning, joins, mapping
from alloyscreen.session import materialize
from alloyscreen.sources import scans

VOCABULARY_MAX = 200
NO_ELEMENT, OTHER_ELEMENT = "None", "Other"


def one_hot_slots(df: DataFrame, most: int = VOCABULARY_MAX) -> tuple[DataFrame, list[str]]:
    """0/1 columns per slot and element over one shared vocabulary; an empty slot counts as ``None``.

    The vocabulary comes back to the driver because it names columns: the ``most`` most frequent symbols (of equal ones the first
    by name). If there are more, the others share one column per slot, ``Other``."""
    names = [F.coalesce(column_or(df, f"element_{i}", None).cast("string"), F.lit(NO_ELEMENT)) for i in composition.SLOTS]
    counted = df.select(F.explode(F.array(*names)).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    seen = counted.orderBy(F.desc("n"), "e").limit(most + 1).collect()
    vocabulary = sorted(r["e"] for r in seen[:most])
    filled = df.withColumns(
        {
            **{f"element_{i}": n for i, n in zip(composition.SLOTS, names)},
            "composition_3": F.coalesce(column_or(df, "composition_3", 0.0).cast("double"), F.lit(0.0)),
        }
    )
    hot = {
        f"element_{i}_{e}": F.when(F.col(f"element_{i}") == e, 1).otherwise(0) for i in composition.SLOTS for e in vocabulary
    }
    if len(seen) > most:
        hot |= {f"element_{i}_{OTHER_ELEMENT}": F.when(F.col(f"element_{i}").isin(vocabulary), 0).otherwise(1) for i in composition.SLOTS}
    return filled.withColumns(hot), list(hot)


PROPERTY_FEATURES = [
    "melting_point", "boiling_point", "density", "electronegativity", "atomic_radius", "electronegativity_difference",
    "mp_bp_ratio", "electroneg_sq", "radius_sq",
]
COMPOSITION_FEATURES = [*schema.COMPOSITION_FIELDS, "comp_1_2", "comp_1_3", "comp_2_3"]


def alloy_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """One-hot slots, interactions and properties, with the list of feature columns."""
    hot, names = one_hot_slots(df)
    return composition.with_interactions(hot), [*names, *COMPOSITION_FEATURES, *PROPERTY_FEATURES]


def fit_scaler(df: DataFrame, columns: list[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """(shift, divisor) per column: mean and population deviation, or least value and range. Two numbers per column."""
    shift, spread = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
    row = df.agg(
        *[shift(c).cast("double").alias(f"shift_{i}") for i, c in enumerate(columns)],
        *[spread(c).cast("double").alias(f"spread_{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"shift_{i}"], row[f"spread_{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, columns: list[str], fitted: dict[str, tuple[float, float]] | None) -> DataFrame:
    """Columns shifted and divided by fitted values; an error when nothing has been fitted."""
    if not fitted:
        raise ValueError("fit_scaler has to run before scale")
    return df.withColumns({c: (F.col(c) - fitted[c][0]) / fitted[c][1] for c in columns})


FEATURE_FIELDS = [
    "composition_1", "composition_2", "composition_3", "density", "electronegativity", "atomic_radius", "band_gap",
    "energy_above_hull", "formation_energy_per_atom", "nsites",
]

#: Those that come with the material; the others are derived from its elements and formula.
MEASURED_FIELDS = ["density", "band_gap", "energy_above_hull", "formation_energy_per_atom", "nsites"]


def ml_features(raw: DataFrame) -> DataFrame:
    """Classifier features of raw materials (with ``material_id``): element means, composition fractions, numbers with
    nulls replaced by means."""
    base = raw if "nsites" in raw.columns else raw.withColumn("nsites", F.lit(8))
    derived = base.transform(aggregates.element_means).transform(composition.with_top_fractions)
    numbers = cleaning.coerce_numeric(derived.select("material_id", *FEATURE_FIELDS), FEATURE_FIELDS)
    # derived fields are never null: the pass for the means reads measured fields only and parses no formula
    return mapping.cast_required(cleaning.mean_impute(numbers, MEASURED_FIELDS), schema.CLASSIFIER_FIELDS)


def training_dataset(materials: DataFrame, n_materials: int | None = None, energy_above_hull_max: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(features, raw rows) of the default element pairs: all of them, or with ``n_materials`` at most ``max(20, n/15)`` rows per pair.

    The chosen rows are written out, so that the means, the joins and the fits that follow do not scan the whole
    materials table again."""
    limit = None if n_materials is None else max(20, n_materials // 15)
    raw = materialize(scans.training_scan(materials, None, limit, energy_above_hull_max))
    return ml_features(raw), raw


RAW_LABEL_COLUMNS = ["band_gap", "nsites", "total_magnetization", "energy_above_hull"]


def training_table(features: DataFrame, raw: DataFrame) -> DataFrame:
    """Features with the raw measurements next to them and the stability label; unclear rows are left out."""
    own = raw if "total_magnetization" in raw.columns else raw.withColumn("total_magnetization", F.lit(0.0))
    joined = joins.join_features(features.drop(*RAW_LABEL_COLUMNS), own, RAW_LABEL_COLUMNS)
    return stability.label_stability(joined)


def alloy_table(features: DataFrame, raw: DataFrame) -> DataFrame:
    """Materials of exactly two elements as tagged binary alloys with limited fractions."""
    binary = joins.join_features(features, raw).filter(F.size("elements") == 2)
    limits = (composition.FRACTION_MIN, composition.FRACTION_MAX)
    return binary.select(
        "material_id",
        F.concat(F.lit("alloy_"), F.col("material_id")).alias("id"),
        "formula",
        F.lit("binary").alias("alloy_type"),
        F.try_element_at("elements", F.lit(1)).alias("element_1"),
        F.try_element_at("elements", F.lit(2)).alias("element_2"),
        F.lit(None).cast("string").alias("element_3"),
        *[clip(F.coalesce(F.col(f"composition_{i}"), F.lit(0.5)), *limits).alias(f"composition_{i}") for i in (1, 2)],
        F.lit(0.0).alias("composition_3"),
        *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in (
            ("formation_energy_per_atom", 0.0), ("density", 7.0), ("electronegativity", 1.8), ("atomic_radius", 1.4))],
    )


def feature_set(df: DataFrame, tertiary: bool | None = None) -> list[str]:
    """Seven base features, with the fractions when asked for or (``None``) when the data hold enough ternaries."""
    if tertiary is None:
        tertiary = bool(aggregates.tertiary_coverage(df).first()["recommended"])
    return [*schema.CLASSIFIER_FIELDS, *(schema.COMPOSITION_FIELDS if tertiary else [])]
