"""Aggregations over materials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.functions import composition, ensemble, safety
from alloyscreen.functions.basics import column_or, number, with_computed
from alloyscreen.operators import ordered

TERTIARY_MIN_ROWS, TERTIARY_MIN_FRACTION = 50, 0.15


def tertiary_coverage(df: DataFrame) -> DataFrame:
    third = number(F.col("composition_3")) if "composition_3" in df.columns else F.lit(0.0)
    counted = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(third > 1e-6).alias("tertiary_rows"))
    fraction = F.coalesce(F.try_divide(F.col("tertiary_rows"), F.col("total_rows")), F.lit(0.0))
    return counted.withColumn("tertiary_fraction", fraction).withColumn(
        "recommended", (F.col("total_rows") >= TERTIARY_MIN_ROWS) & (F.col("tertiary_fraction") >= TERTIARY_MIN_FRACTION)
    )


def value_counts(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), *columns).limit(top) if top else counted


def describe(df: DataFrame, fields: list[str]) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles and greatest value per field."""
    figures = []
    for f in fields:
        x = F.col(f"`{f}`").cast("double")
        figures.append(F.struct(F.lit(f).alias("field"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")))
    basic = df.agg(F.array(*figures).alias("figures")).select(F.inline("figures"))
    # One row per field on both sides.
    return basic.join(F.broadcast(ordered.quantiles(df, fields, [0.25, 0.5, 0.75])), "field", "left")


def element_means(df: DataFrame, elements: str = "elements") -> DataFrame:
    """Mean atomic number, electronegativity and radius of each row's elements (0 when none is known).

    The row's own array decides the mean, so it is computed inside the row from a map of the known elements; no
    explode, no shuffle back together."""
    number_of = {s: z for z, s in enumerate(refdata.ATOMIC_WEIGHTS, start=1)}
    entries = []
    for symbol, chi, radius, *_ in refdata.ALLOY_ELEMENTS:
        entries += [F.lit(symbol), F.struct(F.lit(float(number_of[symbol])).alias("z"), F.lit(chi).alias("chi"), F.lit(radius).alias("r"))]
    table = F.create_map(*entries)
    found = F.filter(F.transform(elements, lambda e: F.try_element_at(table, e)), lambda p: p.isNotNull())
    out = with_computed(df, {"_found": found})
    names = {"avg_atomic_number": "z", "electronegativity": "chi", "atomic_radius": "r"}
    return out.withColumns({name: _mean_of("_found", part) for name, part in names.items()}).drop("_found")


def _mean_of(structs: str, part: str):
    total = F.aggregate(F.col(structs), F.lit(0.0), lambda acc, p: acc + p[part])
    return F.coalesce(F.try_divide(total, F.size(structs)), F.lit(0.0))


MIXED = ["melting_point", "boiling_point", "density", "electronegativity", "atomic_radius"]


def rule_of_mixtures(df: DataFrame) -> DataFrame:
    """Fraction-weighted element properties and, for binaries, the electronegativity difference.

    Each of the three slots looks its element up in the fixed element table by a broadcast join, so that the row stays
    where it is; mixed columns replace columns of the same name."""
    table = refdata.alloy_elements(df.sparkSession)
    out = df.drop(*[c for c in MIXED if c in df.columns])
    for i in composition.SLOTS:
        props = table.select(F.col("symbol").alias(f"_symbol_{i}"), *[F.col(p).alias(f"_{p}_{i}") for p in MIXED])
        out = out.withColumn(f"_element_{i}", composition.slot_element(df, i))
        out = out.join(F.broadcast(props), F.col(f"_element_{i}") == F.col(f"_symbol_{i}"), "left")
        share = F.when(F.col(f"_symbol_{i}").isNotNull(), F.col(f"composition_{i}") if f"composition_{i}" in df.columns else F.lit(0.0))
        out = out.withColumn(f"_share_{i}", F.coalesce(share, F.lit(0.0)))
    whole = sum((F.col(f"_share_{i}") for i in composition.SLOTS), F.lit(0.0))
    known = sum((F.when(F.col(f"_symbol_{i}").isNotNull(), 1).otherwise(0) for i in composition.SLOTS), F.lit(0))
    columns = {
        p: F.try_divide(
            sum((F.coalesce(F.col(f"_{p}_{i}"), F.lit(0.0)) * F.col(f"_share_{i}") for i in composition.SLOTS), F.lit(0.0)), whole
        )
        for p in MIXED
    }
    chi = [F.col(f"_electronegativity_{i}") for i in composition.SLOTS]
    columns["electronegativity_difference"] = F.when(known == 2, F.greatest(*chi) - F.least(*chi)).otherwise(F.lit(0.0))
    helpers = [f"_{n}_{i}" for i in composition.SLOTS for n in ("element", "symbol", "share", *MIXED)]
    return out.withColumns(columns).drop(*helpers)


def element_totals(df: DataFrame) -> DataFrame:
    """Total fraction and percent share per element, with number and mass. At most one row per known symbol shuffles out
    of each task."""
    pairs = [
        F.struct(column_or(df, f"element_{i}", None).cast("string").alias("element"), column_or(df, f"composition_{i}", None).cast("double").alias("fraction"))
        for i in composition.SLOTS
    ]
    long = df.select(F.inline(F.array(*pairs))).filter(F.col("element").isNotNull() & F.col("fraction").isNotNull())
    totals = long.groupBy("element").agg(F.sum("fraction").alias("total_fraction"))
    whole = totals.agg(F.sum("total_fraction").alias("whole")).scalar()
    weights = refdata.atomic_weights(df.sparkSession)
    return (
        totals.withColumn("atomic_percent", F.coalesce(F.try_divide(F.col("total_fraction"), whole) * 100, F.lit(0.0)))
        .join(F.broadcast(weights.withColumnRenamed("symbol", "element")), "element", "left")
        .select("element", "atomic_number", F.col("atomic_weight").alias("atomic_mass"), "total_fraction", "atomic_percent")
    )


# Limits of the solid-solution rules.
RADIUS_LIMIT, CHI_LIMIT, VALENCE_LIMIT = 0.15, 0.4, 1


def with_solution_rules(df: DataFrame) -> DataFrame:
    """Per binary: which of the four solid-solution rules are broken. Null when an element is not in the table."""
    table = refdata.solution_elements(df.sparkSession)
    out = df
    for i in (1, 2):
        side = table.select(*[F.col(c).alias(f"_{c}_{i}") for c in table.columns])
        out = out.join(F.broadcast(side), F.col(f"element_{i}") == F.col(f"_symbol_{i}"), "left")
    r1, r2 = F.col("_radius_1"), F.col("_radius_2")
    structures = F.array_sort(F.array("_structure_1", "_structure_2"))
    known = F.col("_symbol_1").isNotNull() & F.col("_symbol_2").isNotNull()
    rules = {
        "radius_violation": F.abs(r1 - r2) / F.greatest(r1, r2) > RADIUS_LIMIT,
        "electronegativity_violation": F.abs(F.col("_chi_1") - F.col("_chi_2")) > CHI_LIMIT,
        "valence_violation": F.abs(F.col("_valence_1") - F.col("_valence_2")) > VALENCE_LIMIT,
        "structure_violation": structures == F.array(F.lit("BCC"), F.lit("FCC")),
    }
    out = out.withColumns({k: F.when(known, v) for k, v in rules.items()})
    broken = [F.col(k) for k in rules]
    out = out.withColumn("composition_valid", ~(broken[0] | broken[1] | broken[2] | broken[3]))
    return out.drop(*[f"_{c}_{i}" for i in (1, 2) for c in table.columns])


def hume_rothery(df: DataFrame) -> DataFrame:
    """Violation counts over the table, as counts and as percent of all rows."""
    rules = ["radius", "electronegativity", "valence", "structure"]
    counted = with_solution_rules(df).agg(
        F.count(F.lit(1)).alias("total_materials"),
        F.count_if(F.col("composition_valid")).alias("valid_compositions"),
        F.count_if(~F.col("composition_valid")).alias("violating_compositions"),
        *[F.count_if(F.col(f"{r}_violation")).alias(f"{r}_violations") for r in rules],
    )
    percent = {f"{r}_percent": F.try_divide(F.col(f"{r}_violations") * 100.0, F.col("total_materials")) for r in rules}
    valid = F.try_divide(F.col("valid_compositions") * 100.0, F.col("total_materials"))
    return counted.withColumns({"valid_percent": valid, **percent}).withColumn(
        "compliance", F.when(F.col("valid_percent") > 70, "good").when(F.col("valid_percent") > 50, "moderate").otherwise("low")
    )


def safety_summary(df: DataFrame, human_override: bool = False) -> DataFrame:
    """Counts per class of a frame with ``safety_class``, and how many rows an export would hold."""
    c = F.col("safety_class")
    exported = (c == safety.SAFE) | (c == safety.REVIEW) if human_override else c == safety.SAFE
    return df.agg(
        F.count(F.lit(1)).alias("total_materials"),
        F.count_if(c == safety.SAFE).alias("safe_materials"),
        F.count_if(c == safety.UNSAFE).alias("unsafe_materials"),
        F.count_if(c == safety.REVIEW).alias("human_review_materials"),
        F.count_if(exported).alias("exported_materials"),
    )


def generation_summary(df: DataFrame, **gate) -> DataFrame:
    """Headline counts of a screened table (with ensemble, priority and cost-benefit columns)."""
    return df.agg(
        F.count(F.lit(1)).alias("total_materials"),
        F.coalesce(F.sum("ensemble_prediction"), F.lit(0)).alias("predicted_synthesizable"),
        F.count_if(F.col("ensemble_confidence") > 0.8).alias("high_confidence"),
        F.count_if(ensemble.live_gate(df, **gate)).alias("gate_passing"),
        F.count_if(F.col("synthesis_priority_score") > 0.7).alias("high_priority"),
        F.count_if(F.col("net_benefit") > 0).alias("positive_net_benefit"),
        F.avg("net_benefit").alias("mean_net_benefit"),
    )


def workflow_summary(workflow: DataFrame) -> DataFrame:
    level = F.col("priority_level")
    return workflow.agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.max("batch_number").alias("batches"),
        F.count_if(level == "High").alias("high_priority"),
        F.count_if(level == "Medium").alias("medium_priority"),
        F.count_if(level == "Low").alias("low_priority"),
        F.sum("estimated_time_days").alias("total_days"),
        F.avg("estimated_time_days").alias("mean_days"),
    )


def histogram(df: DataFrame, field: str, bins: int) -> DataFrame:
    """Counts in equal bins over the range of the data; the last bin includes its right end."""
    known = df.select(F.col(field).cast("double").alias("v")).filter(F.col("v").isNotNull())
    bounds = known.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("b")).scalar()
    width = (F.col("b.high") - F.col("b.low")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("b.low"), width)), F.lit(0)).cast("int")
    counted = (
        known.withColumn("b", bounds)
        .select(F.least(place, F.lit(bins - 1)).alias("bin"), F.col("b.low").alias("low"), width.alias("width"))
        .groupBy("bin", "low", "width")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        "n",
    )


def range_novelty(candidates: DataFrame, originals: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with any value below 0.9·least or above 1.1·greatest original value."""
    bounds = originals.agg(
        F.struct(*[x for f in fields for x in (F.min(f).alias(f"{f}_low"), F.max(f).alias(f"{f}_high"))]).alias("b")
    ).scalar()
    outside = F.lit(False)
    for f in fields:
        low, high = F.col(f"b.{f}_low") * 0.9, F.col(f"b.{f}_high") * 1.1
        outside = outside | F.coalesce((F.col(f) < low) | (F.col(f) > high), F.lit(False))
    counted = candidates.withColumn("b", bounds).agg(
        F.count(F.lit(1)).alias("total_materials"), F.count_if(outside).alias("novel_materials")
    )
    return counted.withColumn("novel_percent", F.try_divide(F.col("novel_materials") * 100.0, F.col("total_materials")))


def coverage_ratio(candidates: DataFrame, originals: DataFrame, fields: list[str]) -> DataFrame:
    """Mean over fields of the candidates' range relative to the originals' range, and their mean deviation."""
    span = originals.agg(F.struct(*[(F.max(f) - F.min(f)).alias(f) for f in fields]).alias("s")).scalar()
    measured = candidates.agg(
        *[(F.max(f) - F.min(f)).alias(f"{f}_span") for f in fields], *[F.stddev_pop(f).alias(f"{f}_std") for f in fields]
    ).withColumn("s", span)
    ratios = sum((F.try_divide(F.col(f"{f}_span"), F.col(f"s.{f}")) for f in fields), F.lit(0.0)) / len(fields)
    spread = sum((F.col(f"{f}_std") for f in fields), F.lit(0.0)) / len(fields)
    return measured.select(ratios.alias("range_coverage"), spread.alias("mean_std"))


