from __future__ import annotations

from pyspark.sql import functions as F

from alloyscreen.checks.core import check, full, outcomes, r, rounded, scored
from alloyscreen.functions import composition, methods
from alloyscreen.operators import features
from alloyscreen.plans import export, screening
from alloyscreen.session import run_folder
from alloyscreen.sources import pair_store, scans, sinks

CSV_COLUMNS = [
    "material_id", "formula", "element_1", "element_2", "element_3", "composition_1", "composition_2", "composition_3",
    "energy_above_hull", "formation_energy_per_atom", "band_gap", "density", "electronegativity", "atomic_radius", "nsites",
]


def _summary_source(spark, d):
    return full(spark, d).withColumnsRenamed({"formula": "formula_pretty"})


@check("csv_scan", f"SELECT {', '.join(CSV_COLUMNS)} FROM full_materials")
def csv_scan(spark, d):
    path = run_folder(spark, "csv_scan")
    table = full(spark, d).select(*CSV_COLUMNS)
    sinks.write_csv(table, path)
    return scans.read_csv(spark, path, table.schema)


@check("outcomes_scan", """SELECT formula, attempted_date, outcome, ml_pred, llm_pred, CAST(NULL AS DOUBLE) AS e_hull, CAST(NULL AS VARCHAR) AS notes FROM outcomes""")
def outcomes_scan(spark, d):
    path = run_folder(spark, "outcomes_scan")
    outcomes(spark, d).select("formula", "attempted_date", "outcome", "ml_pred", "llm_pred").write.parquet(path)
    return scans.read_outcomes(spark, path).withColumn("attempted_date", F.col("attempted_date").cast("timestamp_ntz"))


@check("filtered_scan", """SELECT material_id, formula, array_to_string(elements, ',') AS elements, nsites, density, band_gap, energy_above_hull, formation_energy_per_atom
    FROM full_materials WHERE list_contains(elements, 'Al') AND list_contains(elements, 'Fe') AND band_gap >= 0.1 AND band_gap <= 6 AND energy_above_hull <= 0.2 AND nsites <= 20""")
def filtered_scan(spark, d):
    out = scans.summary_scan(_summary_source(spark, d), ["Al", "Fe"], 0.1, 6.0, 0.2, 20)
    return out.withColumn("elements", F.array_join("elements", ","))


PAIR_SQL = """SELECT material_id, formula, array_to_string(elements, ',') AS elements, pair_1 AS element_1, pair_2 AS element_2, 'binary' AS alloy_type, nsites, energy_above_hull FROM """


def _pairs(df):
    return df.select(
        "material_id", "formula", F.array_join("elements", ",").alias("elements"), "element_1", "element_2", "alloy_type",
        "nsites", "energy_above_hull",
    )


@check("pair_scan", PAIR_SQL + "pair_all")
def pair_scan(spark, d):
    return _pairs(scans.pair_scan(_summary_source(spark, d)))


@check("pair_scan_training", PAIR_SQL + "pair_train_all")
def pair_scan_training(spark, d):
    return _pairs(scans.training_scan(_summary_source(spark, d)))


@check("pair_scan_limited", PAIR_SQL + "pair_train_50")
def pair_scan_limited(spark, d):
    """The first fifty materials of each pair."""
    return _pairs(scans.training_scan(_summary_source(spark, d), limit_per_pair=50))


STORED_PAIRS = [("Fe", "Ni"), ("Al", "Fe"), ("Al", "Ni")]
STORED_INDEX = " ".join(f"WHEN pair_1 = '{a}' AND pair_2 = '{b}' THEN {i}" for i, (a, b) in enumerate(STORED_PAIRS))


@check("pair_store_scan", PAIR_SQL + f"""(SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY own) AS k FROM (SELECT *, CASE {STORED_INDEX} END AS own
    FROM full_materials JOIN pairs ON list_contains(elements, pair_1) AND list_contains(elements, pair_2) WHERE energy_above_hull <= 0.3 AND nsites <= 12) WHERE own IS NOT NULL) WHERE k = 1""")
def pair_store_scan(spark, d):
    """Three pairs out of a store of all of them, in an order of their own."""
    path = run_folder(spark, "pair_store")
    pair_store.write_pairs(_summary_source(spark, d), path)
    return _pairs(pair_store.stored_pair_scan(spark, path, STORED_PAIRS, 0.3, 12))


@check("lookup_by_id", """SELECT i.material_id, m.formula, m.density, m.energy_above_hull FROM
    (SELECT material_id FROM full_materials UNION ALL SELECT concat('absent-', material_id) FROM full_materials WHERE band_gap IS NULL) i
    LEFT JOIN full_materials m ON i.material_id = m.material_id""")
def lookup_by_id(spark, d):
    table = full(spark, d)
    absent = table.filter("band_gap IS NULL").select(F.concat(F.lit("absent-"), "material_id").alias("material_id"))
    return scans.lookup(table, table.select("material_id").union(absent), ["formula", "density", "energy_above_hull"])


FEATURE_COLUMNS = ["composition_1", "composition_2", "composition_3", "density", "electronegativity", "atomic_radius",
                   "band_gap", "energy_above_hull", "formation_energy_per_atom"]
FEATURE_SELECT = "SELECT material_id, " + ", ".join(r(c, c, 8) for c in FEATURE_COLUMNS) + ", nsites FROM "


@check("training_dataset", FEATURE_SELECT + "dataset_features")
def training_dataset(spark, d):
    table, _ = features.training_dataset(_summary_source(spark, d), 500)
    return rounded(table.select("material_id", *FEATURE_COLUMNS, "nsites"), 8)


@check("method_details", """SELECT b.material_id, b.method_key, m.method_name, m.atmosphere,
    concat(m.temperature_typical, '°C (', m.temperature_min, '-', m.temperature_max, '°C)') AS temperature_range,
    m.prep_time_hours + m.synthesis_time_hours + m.cooling_time_hours AS total_time_hours,
    array_to_string(m.equipment_needed, ', ') AS equipment_needed, array_to_string(m.best_for[1:2], ', ') AS best_for,
    m.estimated_cost_usd, m.success_probability AS method_success_rate FROM best_method b JOIN methods m ON b.method_key = m.method_key""")
def method_details(spark, d):
    chosen = scored(spark, d).transform(methods.with_best_method).select("material_id", "method_key")
    return methods.with_method_details(chosen).select(
        "material_id", "method_key", "method_name", "atmosphere", "temperature_range", "total_time_hours", "equipment_needed",
        "best_for", "estimated_cost_usd", "method_success_rate",
    )


LAB_SQL = """SELECT c.material_id AS "ID", c.formula AS "Formula", concat_ws('; ', CASE WHEN w.mass_1 IS NOT NULL THEN concat(c.element_1, ': ', format('{:.1f}', c.composition_1 * 100), '%') END,
      CASE WHEN w.mass_2 IS NOT NULL THEN concat(c.element_2, ': ', format('{:.1f}', c.composition_2 * 100), '%') END,
      CASE WHEN w.mass_3 IS NOT NULL THEN concat(c.element_3, ': ', format('{:.1f}', c.composition_3 * 100), '%') END) AS "Comp (at%)",
      c.thermodynamic_stability_category AS "Stability", c.method_name AS "Method",
      concat(m.temperature_typical, '°C (', m.temperature_min, '-', m.temperature_max, '°C)') AS "Temp°C", m.atmosphere AS "Atm",
      round(c.energy_above_hull, 3) AS "E_hull", round(c.adjusted, 8) AS "SuccessProb", m.estimated_cost_usd AS "EstCost",
      m.prep_time_hours + m.synthesis_time_hours + m.cooling_time_hours AS "EstTime(h)", 'N/A' AS "Priority", c.in_distribution AS "InDist",
      CAST(0 AS DOUBLE) AS "NNDistance",
      concat_ws('; ', CASE c.thermodynamic_stability_category WHEN 'highly_stable' THEN 'Highly stable - good candidate' WHEN 'marginal' THEN 'Marginally stable - proceed with care' ELSE 'Unstable - high risk' END,
        CASE WHEN c.in_distribution = 'out-dist' THEN 'Out-of-distribution - predictions less reliable' END) AS "Notes"
      FROM costed c JOIN weighed w ON c.material_id = w.material_id JOIN methods m ON m.method_key = c.method_key"""
LAB_SHOWN = ["ID", "Formula", "Comp (at%)", "Stability", "Method", "Temp°C", "Atm", "E_hull", "SuccessProb", "EstCost",
             "EstTime(h)", "Priority", "InDist", "NNDistance", "Notes"]


def _lab(df):
    return df.select(*[F.col(f"`{c}`") for c in LAB_SHOWN]).withColumns(
        {"E_hull": F.round("E_hull", 3), "SuccessProb": F.round("SuccessProb", 8)}
    )


@check("lab_projection", LAB_SQL)
def lab_projection(spark, d):
    return _lab(sinks.lab_projection(scored(spark, d)))


@check("lab_csv", LAB_SQL + " JOIN classed k ON k.material_id = c.material_id WHERE k.safety_class = 'safe'")
def lab_csv(spark, d):
    path = run_folder(spark, "lab_csv")
    rows = export.exportable(scored(spark, d)).transform(composition.with_composition_text)
    shape = sinks.lab_projection(rows).schema
    sinks.write_lab_csv(rows, path)
    return _lab(scans.read_csv(spark, path, shape))


RESULT_NUMBERS = ["thermodynamic_stability_score", "ensemble_probability", "ensemble_confidence"]


@check("results_csv", """SELECT formula, thermodynamic_stability_category, ensemble_prediction, """ + ", ".join(r(c, c) for c in RESULT_NUMBERS)
       + """, energy_above_hull, formation_energy_per_atom, density, band_gap, electronegativity, atomic_radius, nsites,
    element_1, element_2, element_3, composition_1, composition_2, composition_3 FROM ens""")
def results_csv(spark, d):
    path = run_folder(spark, "results_csv")
    rows = scored(spark, d).transform(composition.with_composition_text)
    shape = sinks.results_projection(rows).schema
    sinks.write_results_csv(rows, path)
    out = scans.read_csv(spark, path, shape).drop("at%", "wt%", "feedstock_g_per_100g")
    return out.withColumns({c: F.round(c, 9) for c in RESULT_NUMBERS})


SHORT_ORDER = "ORDER BY safety_rating DESC, round(composite_priority_score, 9) DESC, round(ensemble_confidence, 9) DESC, material_id LIMIT 20"


@check("shortlist_csv", f"""SELECT formula, element_1, element_2, composition_1, composition_2, {r('ensemble_probability', 'ensemble_probability')},
    {r('ensemble_confidence', 'ensemble_confidence')}, safety_rating, safety_check_passed, requires_human_override, {r('composite_priority_score', 'composite_priority_score')}
    FROM route WHERE safety_check_passed {SHORT_ORDER}""")
def shortlist_csv(spark, d):
    path = run_folder(spark, "shortlist_csv")
    ranked = screening.safety_first(full(spark, d))
    shape = sinks.shortlist_projection(ranked).schema
    sinks.write_shortlist_csv(ranked, path)
    return rounded(scans.read_csv(spark, path, shape).drop("safety_reason"))


@check("intake_package", f"""SELECT formula, element_1, element_2, element_3, composition_1, composition_2, composition_3, {r('ensemble_probability', 'ensemble_probability')},
    {r('ensemble_confidence', 'ensemble_confidence')}, safety_rating, safety_check_passed, requires_human_override, {r('final_priority_score', 'final_priority_score')},
    energy_above_hull, band_gap, density, count(*) OVER () AS candidate_count FROM
    (SELECT * FROM route WHERE ensemble_confidence >= 0.6 ORDER BY round(final_priority_score, 9) DESC, material_id LIMIT 100)""")
def intake_package(spark, d):
    path = run_folder(spark, "intake_package")
    pool = screening.safety_first(full(spark, d)).filter("ensemble_confidence >= 0.6")
    shape = sinks.intake_projection(pool).schema
    sinks.write_intake_package(pool, path)
    manifest = spark.read.json(f"{path}/manifest").select("candidate_count").scalar()
    package = scans.read_csv(spark, f"{path}/candidates", shape).drop("estimated_net_benefit")
    return rounded(package.withColumn("candidate_count", manifest))


@check("outcome_append", "SELECT formula, attempted_date, outcome, ml_pred, llm_pred, e_hull, notes FROM outcomes")
def outcome_append(spark, d):
    path = run_folder(spark, "outcome_append")
    log = outcomes(spark, d)
    # one batch under a name, one without, both sent twice; then all of it, of which the log lacks nothing
    for _ in range(2):
        sinks.append_outcomes(log.filter("outcome = 'Successful'"), path, "successful")
        sinks.append_outcomes(log.filter("outcome <> 'Successful'"), path)
    sinks.append_outcomes(log, path, "all")
    return scans.read_outcomes(spark, path).withColumn("attempted_date", F.col("attempted_date").cast("timestamp_ntz"))


@check("plain_csv", "SELECT material_id, formula, energy_above_hull, density FROM full_materials")
def plain_csv(spark, d):
    path = run_folder(spark, "plain_csv")
    table = full(spark, d).select("material_id", "formula", "energy_above_hull", "density")
    sinks.write_csv(table, path)
    return scans.read_csv(spark, path, table.schema)


@check("override_union", """SELECT material_id, CASE WHEN safety_class = 'safe' THEN 'safe' ELSE 'human_override' END AS export_status FROM classed WHERE safety_class <> 'unsafe'""")
def override_union(spark, d):
    return export.exportable(scored(spark, d), human_override=True).select("material_id", "export_status")


@check("export_for_lab", """SELECT count(*) AS total_materials, count(*) FILTER (WHERE safety_class = 'safe') AS safe_materials,
    count(*) FILTER (WHERE safety_class = 'unsafe') AS unsafe_materials, count(*) FILTER (WHERE safety_class = 'human_review') AS human_review_materials,
    count(*) FILTER (WHERE safety_class <> 'unsafe') AS exported_materials FROM classed""")
def export_for_lab(spark, d):
    return export.export_for_lab(scored(spark, d), run_folder(spark, "export_for_lab"), human_override=True)


