from __future__ import annotations

from pyspark.sql import functions as F

from alloyscreen import schema
from alloyscreen.checks.core import aliased, check, r, raw, rounded
from alloyscreen.operators import cleaning, mapping, quality

RENAMED = """SELECT material_id, formula_pretty AS formula, elem_1 AS element_1, elem_2 AS element_2, elem_3 AS element_3, comp_1 AS composition_1,
    comp_2 AS composition_2, comp_3 AS composition_3, formation_energy AS formation_energy_per_atom, e_above_hull AS energy_above_hull, stability_energy, bandgap AS band_gap,
    num_sites AS nsites, mass_density AS density, electronegativity_avg AS electronegativity, atomic_radius_avg AS atomic_radius FROM alloy_raw"""


@check("canonical_rename", RENAMED)
def canonical_rename(spark, d):
    return mapping.rename_to_canonical(aliased(spark, d))


@check("rename_required", """SELECT * RENAME (formation_energy AS formation_energy_per_atom, e_above_hull AS energy_above_hull, mass_density AS density, electronegativity_avg AS electronegativity,
    atomic_radius_avg AS atomic_radius, comp_1 AS composition_1, comp_2 AS composition_2) FROM alloy_raw""")
def rename_required(spark, d):
    return mapping.rename_required(aliased(spark, d), schema.GENERATOR_FIELDS + ["energy_above_hull"])


@check("alias_copy", """SELECT *, formation_energy AS formation_energy_per_atom, e_above_hull AS energy_above_hull, coalesce(try_cast(bandgap AS DOUBLE), 0) AS band_gap,
    CAST(num_sites AS DOUBLE) AS nsites, coalesce(mass_density, CAST(7.8 AS DOUBLE)) AS density, electronegativity_avg AS electronegativity, atomic_radius_avg AS atomic_radius FROM alloy_raw""")
def alias_copy(spark, d):
    return mapping.copy_aliases(aliased(spark, d))


@check("fallback_column", """SELECT material_id, element_1, formation_energy_per_atom, CAST(7.0 AS DOUBLE) AS density, true AS density_imputed, false AS formation_energy_per_atom_imputed,
    CAST(1500 AS DOUBLE) AS melting_point, true AS melting_point_imputed, false AS element_1_imputed FROM materials""")
def fallback_column(spark, d):
    table = raw(spark, d).select("material_id", "element_1", "formation_energy_per_atom")
    return mapping.add_absent(table, ["density", "melting_point", "formation_energy_per_atom", "element_1"])


COMPLETE = """SELECT material_id, formula, element_1, element_2, formation_energy_per_atom, energy_above_hull, coalesce(try_cast(band_gap AS DOUBLE), 0) AS band_gap, nsites,
    coalesce(density, 0) AS density, electronegativity, atomic_radius, composition_1, composition_2"""


@check("complete_fields", f"{COMPLETE} FROM ({RENAMED})")
def complete_fields(spark, d):
    return mapping.complete_fields(aliased(spark, d), schema.SCREENING_FIELDS).select("material_id", *_order())


def _order():
    return ["formula", "element_1", "element_2", "formation_energy_per_atom", "energy_above_hull", "band_gap", "nsites", "density",
            "electronegativity", "atomic_radius", "composition_1", "composition_2"]


@check("standardize", f"{COMPLETE}, CAST(1500 AS DOUBLE) AS melting_point, true AS melting_point_imputed FROM ({RENAMED})")
def standardize(spark, d):
    out = mapping.standardize(aliased(spark, d), [*schema.SCREENING_FIELDS, "melting_point"])
    return out.select("material_id", *_order(), "melting_point", "melting_point_imputed")


def _quality_sql() -> str:
    parts = []
    present = [c for c in schema.CANONICAL_TYPES if c != "melting_point"]
    for f in schema.CANONICAL_TYPES:
        if f not in present:
            parts.append(f"SELECT '{f}' AS field, false AS present, count(*) AS row_count, count(*) AS null_count, CAST(0 AS BIGINT) AS unreadable_count, false AS passed FROM q")
            continue
        bad = "CAST(0 AS BIGINT)" if schema.CANONICAL_TYPES[f] == "string" else f"count(*) FILTER (WHERE {f} IS NOT NULL AND try_cast({f} AS DOUBLE) IS NULL)"
        parts.append(f"SELECT '{f}' AS field, true AS present, count(*) AS row_count, count(*) FILTER (WHERE {f} IS NULL) AS null_count, {bad} AS unreadable_count, {bad} = 0 AS passed FROM q")
    return f"SELECT * FROM (WITH q AS ({RENAMED}) {' UNION ALL '.join(parts)})"


@check("quality_report", _quality_sql())
def quality_report(spark, d):
    return quality.quality_report(mapping.rename_to_canonical(aliased(spark, d)))


@check("field_validity", f"""SELECT false AS all_fields_present, 'nsites' AS missing_fields, CASE WHEN count(*) FILTER (WHERE band_gap IS NOT NULL AND try_cast(band_gap AS DOUBLE) IS NULL) > 0
    THEN 'band_gap' ELSE '' END AS invalid_fields, count(*) AS total_rows, 15 AS total_columns FROM ({RENAMED})""")
def field_validity(spark, d):
    return quality.field_validity(mapping.rename_to_canonical(aliased(spark, d).drop("num_sites")))


@check("safe_column", "SELECT material_id, density AS density_safe, CAST(2.5 AS DOUBLE) AS volume_safe FROM materials")
def safe_column(spark, d):
    table = raw(spark, d)
    return table.select(
        "material_id", mapping.safe_column(table, "density", 1.0).alias("density_safe"), mapping.safe_column(table, "volume", 2.5).alias("volume_safe")
    )


def _profile_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS field, CAST(min({f}) AS DOUBLE) AS min_value, CAST(max({f}) AS DOUBLE) AS max_value, count({f}) AS value_count, '{'int' if f == 'nsites' else 'double'}' AS data_type FROM materials"
        for f in schema.CLASSIFIER_FIELDS
    )


@check("profile", _profile_sql())
def profile(spark, d):
    return quality.profile(raw(spark, d))


CLEAN = ["composition_1", "composition_2", "density", "electronegativity", "atomic_radius", "formation_energy_per_atom", "energy_above_hull", "band_gap", "nsites"]


@check("schema_clean", "SELECT material_id, " + ", ".join(
    r(f"least(greatest(coalesce(CAST({c} AS DOUBLE), avg({c}) OVER ()), CAST({schema.VALUE_RANGES[c][0]} AS DOUBLE)), CAST({schema.VALUE_RANGES[c][1]} AS DOUBLE))", c, 8) for c in CLEAN
) + " FROM materials")
def schema_clean(spark, d):
    return rounded(cleaning.schema_clean(raw(spark, d)).select("material_id", *CLEAN), 8)


@check("coerce_numeric", "SELECT 'bandgap' AS field, count(*) FILTER (WHERE bandgap IS NOT NULL AND try_cast(bandgap AS DOUBLE) IS NULL) AS coerced FROM alloy_raw UNION ALL SELECT 'mass_density', count(*) FILTER (WHERE false) FROM alloy_raw")
def coerce_numeric(spark, d):
    return cleaning.coercion_counts(aliased(spark, d), ["bandgap", "mass_density"])


@check("coerced_values", "SELECT material_id, try_cast(bandgap AS DOUBLE) AS bandgap FROM alloy_raw")
def coerced_values(spark, d):
    return cleaning.coerce_numeric(aliased(spark, d), ["bandgap"]).select("material_id", "bandgap")


@check("mean_impute", f"SELECT material_id, {r('coalesce(band_gap, avg(band_gap) OVER ())', 'band_gap', 8)} FROM materials")
def mean_impute(spark, d):
    return rounded(cleaning.mean_impute(raw(spark, d), ["band_gap"]).select("material_id", "band_gap"), 8)


@check("median_impute", f"SELECT material_id, {r('coalesce(band_gap, (SELECT median(band_gap) FROM materials))', 'band_gap', 8)} FROM materials")
def median_impute(spark, d):
    table = raw(spark, d)
    return rounded(cleaning.median_impute(table, ["band_gap"], cleaning.medians(table, ["band_gap"])).select("material_id", "band_gap"), 8)


@check("drop_incomplete", "SELECT material_id, band_gap FROM materials WHERE band_gap IS NOT NULL AND density IS NOT NULL")
def drop_incomplete(spark, d):
    return cleaning.drop_incomplete(raw(spark, d), ["band_gap", "density"]).select("material_id", "band_gap")


@check("missing_total", "SELECT count(*) FILTER (WHERE band_gap IS NULL) + count(*) FILTER (WHERE element_3 IS NULL) AS missing_values FROM materials")
def missing_total(spark, d):
    return quality.missing_total(raw(spark, d))


SANITY = {
    "density_in_range": "NOT (density > 0 AND density < 50)",
    "energy_above_hull_not_negative": "NOT energy_above_hull >= 0",
    "probability_in_unit_range": "NOT synthesizability_probability BETWEEN 0 AND 1",
    "binary_composition_1_in_range": "composition_3 <= 0 AND NOT composition_1 BETWEEN 0.05 AND 0.95",
    "binary_composition_2_in_range": "composition_3 <= 0 AND NOT composition_2 BETWEEN 0.05 AND 0.95",
    "composition_sum_is_one": "abs(composition_1 + composition_2 + composition_3 - 1) > 1e-6",
}


@check("sanity_checks", " UNION ALL ".join(f"""SELECT '{k}' AS "check", count(*) FILTER (WHERE {v}) AS violations FROM materials""" for k, v in SANITY.items()))
def sanity_checks(spark, d):
    return quality.sanity_checks(raw(spark, d))


@check("dedupe", "SELECT material_id, density FROM materials")
def dedupe(spark, d):
    table = raw(spark, d).select("material_id", "density")
    copies = table.withColumn("density", F.col("density") + 1)
    return cleaning.dedupe(copies.union(table).union(table), "material_id", [F.col("density")])
