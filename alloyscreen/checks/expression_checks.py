from __future__ import annotations

from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.checks.core import by_hull_sql, check, formula_sql, full, quoted, r, raw, rounded, scored
from alloyscreen.functions import basics, composition, ensemble, methods, safety, stability
from alloyscreen.plans import candidates
from alloyscreen.operators import aggregates


@check("stability_category", f"SELECT material_id, {by_hull_sql(quoted('highly_stable'), quoted('marginal'), quoted('risky'))} AS category FROM materials")
def stability_category(spark, d):
    return raw(spark, d).select("material_id", stability.stability_category(F.col("energy_above_hull")).alias("category"))


@check("stability_info", "SELECT material_id, " + ", ".join(
    f"{by_hull_sql(*[quoted(row[i]) for row in refdata.STABILITY_CLASSES])} AS {name}"
    for i, name in ((0, "category"), (2, "description"), (3, "synthesis_confidence"))
) + ", energy_above_hull, CASE WHEN energy_above_hull <= 0.1 THEN CAST(" + by_hull_sql("0.025", "0.1", "0") + " AS DOUBLE) END AS finite_threshold FROM materials")
def stability_info(spark, d):
    out = raw(spark, d).select("material_id", stability.stability_info(F.col("energy_above_hull")).alias("i")).select("material_id", "i.*")
    limit = F.when(F.col("threshold_used") < 1, F.col("threshold_used"))
    return out.withColumn("finite_threshold", limit).drop("threshold_used")


@check("thermo_score", f"SELECT material_id, {r('thermodynamic_stability_score', 'thermodynamic_stability_score')}, thermodynamic_stability_category, {by_hull_sql(quoted('green'), quoted('yellow'), quoted('red'))} AS stability_color FROM stab")
def thermo_score(spark, d):
    return rounded(scored(spark, d).select("material_id", "thermodynamic_stability_score", "thermodynamic_stability_category", "stability_color"))


@check("stability_flags", """SELECT material_id, energy_above_hull <= 0.1 AS thermodynamically_stable, formation_energy_per_atom BETWEEN -10 AND 2 AS formation_energy_reasonable,
    energy_above_hull <= 0.1 AND formation_energy_per_atom BETWEEN -10 AND 2 AS overall_stability FROM materials""")
def stability_flags(spark, d):
    return stability.with_stability_flags(raw(spark, d)).select("material_id", "thermodynamically_stable", "formation_energy_reasonable", "overall_stability")


def _reason(cond, good, bad, shown):
    return f"concat(CASE WHEN {cond} THEN {quoted(good[0])} ELSE {quoted(bad[0])} END, {shown}, CASE WHEN {cond} THEN {quoted(good[1])} ELSE {quoted(bad[1])} END)"


REASONS_SQL = "concat_ws(' | ', " + ", ".join([
    _reason("energy_above_hull <= 0.1", ("Low energy above hull (", " eV/atom) indicates stability"), ("High energy above hull (", " eV/atom) indicates instability"), "format('{:.3f}', energy_above_hull)"),
    _reason("formation_energy_per_atom BETWEEN -4 AND 1", ("Formation energy (", " eV/atom) is reasonable"), ("Formation energy (", " eV/atom) is extreme"), "format('{:.3f}', formation_energy_per_atom)"),
    _reason("nsites <= 20", ("Unit cell size (", " sites) is reasonable"), ("Unit cell size (", " sites) is very large"), "CAST(CAST(nsites AS INT) AS VARCHAR)"),
    _reason("density BETWEEN 2 AND 25", ("Density (", " g/cm³) is reasonable"), ("Density (", " g/cm³) is unusual"), "format('{:.1f}', density)"),
    _reason("band_gap <= 8", ("Band gap (", " eV) is reasonable"), ("Band gap (", " eV) is very wide"), "format('{:.1f}', band_gap)"),
    _reason("electronegativity BETWEEN 0.7 AND 2.8", ("Electronegativity (", ") is reasonable"), ("Electronegativity (", ") is extreme"), "format('{:.2f}', electronegativity)"),
    _reason("atomic_radius BETWEEN 0.8 AND 2.5", ("Atomic radius (", " Å) is reasonable"), ("Atomic radius (", " Å) is unusual"), "format('{:.2f}', atomic_radius)"),
]) + ")"


@check("rule_score", f"""SELECT material_id, rule_score, {r('rule_probability', 'rule_probability')}, CASE WHEN rule_probability >= 0.5 THEN 1 ELSE 0 END AS rule_prediction,
    {r('abs(rule_probability - 0.5) * 2', 'rule_confidence')}, {REASONS_SQL} AS reasons FROM ruled""")
def rule_score(spark, d):
    base = scored(spark, d).drop("rule_score", "rule_probability", "rule_prediction", "rule_confidence", "rule_max_score")
    out = stability.with_rules(base, reasons=True)
    return rounded(out.select("material_id", "rule_score", "rule_probability", "rule_prediction", "rule_confidence", F.array_join("rule_reasons", " | ").alias("reasons")))


@check("rule_confidence_alt", f"SELECT material_id, {r('2 * least(rule_probability, 1 - rule_probability)', 'boundary_confidence')} FROM ruled")
def rule_confidence_alt(spark, d):
    return rounded(scored(spark, d).select("material_id", stability.boundary_confidence(F.col("rule_probability")).alias("boundary_confidence")))


@check("precursors", """SELECT material_id, 'Solid State Reaction' AS method, 'Elemental powders, Binary oxides' AS precursors, '800-1200°C' AS temperature_range, 'Medium' AS difficulty, CAST(0.8 AS DOUBLE) AS success_probability
      FROM std WHERE 1 - energy_above_hull / 0.5 > 0.7
    UNION ALL SELECT material_id, 'Arc Melting', 'Pure elements, Master alloy', 'High temperature', 'Low', CAST(0.9 AS DOUBLE) FROM std WHERE band_gap < 2
    UNION ALL SELECT material_id, 'Chemical Vapor Deposition', 'Metal halides, Hydrogen, Inert gas', '600-1000°C', 'High', CAST(0.6 AS DOUBLE) FROM std""")
def precursors(spark, d):
    table = scored(spark, d)
    out = table.select("material_id", F.inline(stability.precursor_routes(table)))
    return out.withColumn("precursors", F.array_join("precursors", ", "))


@check("weight_percent", "SELECT material_id, " + ", ".join(r(f"weight_percent_{i}", f"weight_percent_{i}", 8) for i in (1, 2, 3))
       + f", {r('coalesce(weight_percent_1, 0) + coalesce(weight_percent_2, 0) + coalesce(weight_percent_3, 0)', 'total_weight_percent', 8)} FROM weighed")
def weight_percent(spark, d):
    out = composition.with_weight_percent(raw(spark, d))
    return rounded(out.select("material_id", *[f"weight_percent_{i}" for i in (1, 2, 3)], "total_weight_percent"), 8)


def _joined(template: str, sep: str) -> str:
    return f"concat_ws('{sep}', " + ", ".join(f"CASE WHEN mass_{i} IS NOT NULL THEN {template.format(i=i)} END" for i in (1, 2, 3)) + ")"


@check("composition_text", "SELECT material_id, " + _joined("concat(element_{i}, ': ', format('{{:.1f}}', weight_percent_{i}), '%')", "; ") + ' AS "wt%", '
       + _joined("concat(format('{{:.1f}}', weight_percent_{i}), 'g ', element_{i})", ", ") + " AS feedstock_g_per_100g FROM weighed")
def composition_text(spark, d):
    return composition.with_composition_text(raw(spark, d)).select("material_id", "`wt%`", "feedstock_g_per_100g")


@check("atomic_percent_text", "SELECT material_id, " + _joined("concat(element_{i}, ': ', format('{{:.1f}}', composition_{i} * 100), '%')", "; ") + " AS atomic_percent FROM weighed")
def atomic_percent_text(spark, d):
    table = raw(spark, d)
    return table.select("material_id", composition.atomic_percent_text(table).alias("atomic_percent"))


@check("formula_text", f"SELECT material_id, {formula_sql()} AS formula, CASE WHEN element_3 IS NULL THEN {formula_sql(2)} ELSE 'Invalid' END AS from_two FROM materials")
def formula_text(spark, d):
    table = raw(spark, d)
    elements = F.array_compact(F.array(*[F.col(f"element_{i}") for i in (1, 2, 3)]))
    two = F.array("composition_1", "composition_2")
    return table.select("material_id", composition.slots_formula(table).alias("formula"), composition.formula_text(elements, two).alias("from_two"))


@check("neutralize_cell", """SELECT doc_id, CASE WHEN regexp_matches(text, '^\\s*[=+@-]') THEN concat('''', text) ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN concat('''=', source) WHEN doc_id % 3 = 1 THEN concat(''' @', source) ELSE source END AS marked FROM documents""")
def neutralize_cell(spark, d):
    table = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    third = F.col("doc_id") % 3
    marked = F.when(third == 0, F.concat(F.lit("="), "source")).when(third == 1, F.concat(F.lit(" @"), "source")).otherwise(F.col("source"))
    return composition.with_neutral_cells(table.withColumn("marked", marked).drop("source"))


FRACTIONS = "SELECT material_id, " + ", ".join(r(e, f"composition_{i}") for i, e in ((1, "c[1] / total"), (2, "c[2] / total"), (3, "coalesce(c[3], 0) / total")))


@check("formula_fractions", FRACTIONS + """ FROM (SELECT *, list_sum(c) AS total FROM (SELECT material_id,
    list_sort(list_filter([composition_1, composition_2, composition_3], lambda x: x > 0), 'DESC') AS c FROM full_materials))""")
def formula_fractions(spark, d):
    out = composition.with_top_fractions(full(spark, d).select("material_id", "formula", "elements"))
    return rounded(out.select("material_id", "composition_1", "composition_2", "composition_3"))


@check("bracketed_fractions", FRACTIONS + """ FROM (SELECT material_id, list_sum(c) AS total, c FROM (SELECT material_id,
    list_sort([CAST(nsites AS DOUBLE), nsites % 4 + 1, (nsites % 3 + 2) * (nsites % 4 + 1), 1.5, 3 * (nsites % 3 + 2)], 'DESC') AS c FROM full_materials))""")
def bracketed_fractions(spark, d):
    """Formulas with a group and a nested group, such as ``Fe7(NiO3)4[H(N2)3]1.5``."""
    few, more = (F.col("nsites") % 3 + 2).cast("string"), (F.col("nsites") % 4 + 1).cast("string")
    text = F.concat("element_1", F.col("nsites").cast("string"), F.lit("("), "element_2", F.lit("O"), few, F.lit(")"), more, F.lit("[H(N2)"), few, F.lit("]1.5"))
    out = composition.with_top_fractions(full(spark, d).select("material_id", text.alias("formula")))
    return rounded(out.select("material_id", "composition_1", "composition_2", "composition_3"))


@check("clamp_composition", f"SELECT material_id, {r('least(greatest(composition_1, 0.1), 0.9)', 'composition_1')}, {r('1 - least(greatest(composition_1, 0.1), 0.9)', 'composition_2')} FROM materials")
def clamp_composition(spark, d):
    return rounded(composition.with_clamped_binary(raw(spark, d), 0.1, 0.9).select("material_id", "composition_1", "composition_2"))


CLAMPED = [f"least(greatest(composition_{i}, CAST(0.05 AS DOUBLE)), CAST(0.95 AS DOUBLE))" for i in (1, 2, 3)]


@check("normalize_composition", "SELECT material_id, " + ", ".join(r(f"{c} / ({' + '.join(CLAMPED)})", f"x{i}") for i, c in enumerate(CLAMPED, 1)) + " FROM materials")
def normalize_composition(spark, d):
    x = composition.normalized_fractions(F.array("composition_1", "composition_2", "composition_3"))
    out = raw(spark, d).select("material_id", x.alias("x"))
    return rounded(out.select("material_id", *[F.col("x")[i].alias(f"x{i + 1}") for i in range(3)]))


@check("range_constraints", "SELECT material_id, density, band_gap FROM materials WHERE density BETWEEN 3 AND 12 AND band_gap BETWEEN 0.2 AND 3")
def range_constraints(spark, d):
    table = raw(spark, d)
    kept = table.filter(candidates.satisfies(table, {"density": (3.0, 12.0), "band_gap": (0.2, 3.0), "not_a_column": (0.0, 1.0)}))
    return kept.select("material_id", "density", "band_gap")


@check("label_stability", "SELECT material_id, CASE WHEN energy_above_hull <= 0.025 THEN 1 ELSE 0 END AS synthesizable FROM materials WHERE energy_above_hull <= 0.025 OR energy_above_hull >= 0.1")
def label_stability(spark, d):
    return stability.label_stability(raw(spark, d)).select("material_id", "synthesizable")


@check("label_proxy", "SELECT material_id, CASE WHEN energy_above_hull <= 0.1 THEN 1 ELSE 0 END AS synthesizable FROM materials")
def label_proxy(spark, d):
    return stability.label_proxy(raw(spark, d)).select("material_id", "synthesizable")


@check("decision", f"SELECT material_id, CASE WHEN synthesizability_probability >= 0.35 THEN 1 ELSE 0 END AS synthesizability_prediction, {r('abs(synthesizability_probability - 0.5) * 2', 'synthesizability_confidence')} FROM materials")
def decision(spark, d):
    out = ensemble.with_decision(raw(spark, d), 0.35)
    return rounded(out.select("material_id", "synthesizability_prediction", "synthesizability_confidence"))


@check("ensemble", f"SELECT material_id, {r('ensemble_probability', 'ensemble_probability')}, ensemble_prediction, {r('ensemble_confidence', 'ensemble_confidence')} FROM ens")
def ensemble_check(spark, d):
    return rounded(scored(spark, d).select("material_id", "ensemble_probability", "ensemble_prediction", "ensemble_confidence"))


@check("ensemble_fixed", f"SELECT material_id, {r('p', 'ensemble_probability')}, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS ensemble_prediction, {r('abs(p - 0.5) * 2', 'ensemble_confidence')} FROM (SELECT *, synthesizability_probability * 0.7 + rule_probability * 0.3 AS p FROM ruled)")
def ensemble_fixed(spark, d):
    return rounded(ensemble.with_fixed_ensemble(scored(spark, d)).select("material_id", "ensemble_probability", "ensemble_prediction", "ensemble_confidence"))


@check("live_gate", "SELECT material_id FROM ens WHERE ensemble_probability >= 0.8 AND energy_above_hull <= 0.15 AND in_distribution = 'in-dist'")
def live_gate(spark, d):
    table = scored(spark, d)
    return table.filter(ensemble.live_gate(table)).select("material_id")


GATE_SQL = """SELECT material_id, {passed} AS safety_check_passed, CASE WHEN {passed} THEN 'Safe for export' ELSE concat_ws('; ', {reasons}) END AS safety_reason, concat_ws('; ', {warnings}) AS safety_warnings FROM gated"""
HAZARD = "CASE WHEN len(hazards) > 0 THEN concat('{}', array_to_string(hazards, ', ')) END"
LOW = "CASE WHEN ensemble_probability < {0} THEN concat('Ensemble probability too low: ', CAST(round(CAST(ensemble_probability AS DECIMAL(18, 9)), 3) AS VARCHAR), ' < {0}') END"
STRICT = GATE_SQL.format(
    passed="(len(hazards) = 0 AND ensemble_probability >= 0.8 AND thermodynamic_stability_category = 'highly_stable' AND in_distribution = 'in-dist')",
    reasons=", ".join([
        HAZARD.format("Contains hazardous elements: "), LOW.format("0.8"),
        "CASE WHEN thermodynamic_stability_category <> 'highly_stable' THEN concat('Stability category not ''highly_stable'': ', thermodynamic_stability_category) END",
        "CASE WHEN in_distribution <> 'in-dist' THEN concat('Out-of-distribution material: ', in_distribution) END",
    ]),
    warnings="NULL",
)
FAR = "CASE WHEN in_distribution <> 'in-dist' THEN 'Out-of-distribution material: predictions may be less reliable' END"
RELAXED = GATE_SQL.format(
    passed="(len(hazards) = 0 AND ensemble_probability >= 0.5 AND thermodynamic_stability_category <> 'unstable')",
    reasons=", ".join([
        HAZARD.format("Contains hazardous elements: "), LOW.format("0.5"),
        "CASE WHEN thermodynamic_stability_category = 'unstable' THEN 'Unstable material: unstable' END",
    ]),
    warnings=FAR,
)
OVERRIDDEN = GATE_SQL.format(
    passed="(ensemble_probability >= 0.8)",
    reasons=LOW.format("0.8"),
    warnings=", ".join([
        HAZARD.format("Human override approved for hazardous elements: "),
        "CASE WHEN thermodynamic_stability_category <> 'highly_stable' THEN concat('Human override for stability: ', thermodynamic_stability_category) END", FAR,
    ]),
)


def _gate(spark, d, **mode):
    return safety.with_safety_check(scored(spark, d), **mode).select("material_id", "safety_check_passed", "safety_reason", "safety_warnings")


@check("safety_gate", STRICT)
def safety_gate(spark, d):
    return _gate(spark, d)


@check("safety_gate_relaxed", RELAXED)
def safety_gate_relaxed(spark, d):
    return _gate(spark, d, safe_mode=False)


@check("safety_gate_override", OVERRIDDEN)
def safety_gate_override(spark, d):
    return _gate(spark, d, human_override=True)


@check("safety_split", "SELECT material_id, safety_class, safety_class = 'human_review' AS requires_human_override FROM classed")
def safety_split(spark, d):
    return safety.with_safety_class(scored(spark, d)).select("material_id", "safety_class", "requires_human_override")


@check("safety_rating", "SELECT material_id, CAST(CASE safety_class WHEN 'safe' THEN 1.0 WHEN 'human_review' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS safety_rating FROM classed")
def safety_rating(spark, d):
    return safety.with_safety_rating(scored(spark, d)).select("material_id", "safety_rating")


@check("element_safety", "SELECT material_id, len(hazards) = 0 AS safety_check_passed, CAST(CASE WHEN len(hazards) = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS safety_rating FROM gated")
def element_safety(spark, d):
    return safety.with_element_safety(raw(spark, d)).select("material_id", "safety_check_passed", "safety_rating")


@check("lab_notes", """SELECT material_id, concat_ws('; ', CASE thermodynamic_stability_category WHEN 'highly_stable' THEN 'Highly stable - good candidate' WHEN 'marginal' THEN 'Marginally stable - proceed with care' ELSE 'Unstable - high risk' END,
    CASE WHEN nsites < 10 THEN 'Well-calibrated prediction' WHEN nsites < 20 THEN 'Model may be overconfident' WHEN nsites < 30 THEN 'Model may be underconfident' END,
    CASE WHEN in_distribution = 'out-dist' THEN 'Out-of-distribution - predictions less reliable' END) AS notes FROM stab""")
def lab_notes(spark, d):
    n = F.col("nsites")
    status = F.when(n < 10, "well-calibrated").when(n < 20, "overconfident").when(n < 30, "underconfident").otherwise("none")
    table = scored(spark, d).withColumn("calibration_status", status)
    return table.select("material_id", safety.lab_notes(table).alias("notes"))


@check("priority_level", "SELECT material_id, CASE WHEN nsites <= 3 THEN 'High' WHEN nsites <= 7 THEN 'Medium' WHEN nsites <= 10 THEN 'Low' END AS priority_level FROM materials")
def priority_level(spark, d):
    return safety.with_priority_level(raw(spark, d), "nsites").select("material_id", "priority_level")


HAVE = ["Arc Melter", "Muffle Furnace", "Ball Mill"]


@check("equipment_ok", "SELECT s.material_id, s.method_key, len(list_filter(m.equipment_needed, lambda e: NOT list_contains(['Arc Melter', 'Muffle Furnace', 'Ball Mill'], e))) = 0 AS equipment_ok FROM method_scores s JOIN methods m ON s.method_key = m.method_key")
def equipment_ok(spark, d):
    long = methods.method_scores(scored(spark, d))
    table = refdata.synthesis_methods(spark).select("method_key", "equipment_needed")
    have = F.array(*[F.lit(e) for e in HAVE])
    joined = long.join(F.broadcast(table), "method_key")
    return joined.select("material_id", "method_key", methods.equipment_ok(F.col("equipment_needed"), have).alias("equipment_ok"))


@check("method_score", f"SELECT material_id, method_key, {r('method_score', 'method_score')} FROM method_scores")
def method_score(spark, d):
    return rounded(methods.method_scores(scored(spark, d)))


COST = ["total_cost", "expected_cost", "expected_value", "net_benefit", "benefit_cost_ratio"]


@check("cost_benefit", f"SELECT material_id, method_key, method_name AS recommended_method, {r('adjusted', 'success_probability', 8)}, " + ", ".join(r(c, c, 5) for c in COST) + " FROM costed")
def cost_benefit(spark, d):
    out = methods.with_cost_benefit(scored(spark, d)).select("material_id", "method_key", "recommended_method", "success_probability", *COST)
    return out.withColumns({"success_probability": F.round("success_probability", 8), **{c: F.round(c, 5) for c in COST}})


@check("cost_benefit_simple", "SELECT material_id, method AS simple_method, success AS simple_success_probability, CAST(total_cost AS DOUBLE) AS simple_total_cost, "
       "expected_cost AS simple_expected_cost, expected_value AS simple_expected_value, expected_value - expected_cost AS simple_net_benefit FROM simple_costed")
def cost_benefit_simple(spark, d):
    """Unrounded: both engines compute the same products in the same order."""
    return methods.with_simple_cost_benefit(raw(spark, d)).select(
        "material_id", "simple_method", "simple_total_cost", "simple_success_probability", "simple_expected_cost",
        "simple_expected_value", "simple_net_benefit",
    )


MIX = ["melting_point", "boiling_point", "density", "electronegativity", "atomic_radius"]
MIXED_SQL = """SELECT material_id, composition_1, composition_2, composition_3, """ + ", ".join(
    f"list_sum(list_transform(props, lambda p: p.fraction * p.{c})) / list_sum(list_transform(props, lambda p: p.fraction)) AS {c}" for c in MIX
) + """, CASE WHEN len(props) = 2 THEN abs(props[1].electronegativity - props[2].electronegativity) ELSE 0 END AS electronegativity_difference FROM (
    SELECT m.material_id, any_value(m.composition_1) AS composition_1, any_value(m.composition_2) AS composition_2, any_value(m.composition_3) AS composition_3,
      list(struct_pack(fraction := s.fraction, """ + ", ".join(f"{c} := e.{c}" for c in MIX) + """)) FILTER (WHERE e.symbol IS NOT NULL) AS props
    FROM materials m JOIN (SELECT material_id, element_1 AS element, composition_1 AS fraction FROM materials UNION ALL SELECT material_id, element_2, composition_2 FROM materials
      UNION ALL SELECT material_id, element_3, composition_3 FROM materials WHERE element_3 IS NOT NULL) s ON m.material_id = s.material_id AND s.fraction > 0
    LEFT JOIN alloy_elements e ON e.symbol = s.element GROUP BY m.material_id)"""


@check("rule_of_mixtures", "SELECT material_id, " + ", ".join(r(c, c, 7) for c in [*MIX, "electronegativity_difference"]) + f" FROM ({MIXED_SQL})")
def rule_of_mixtures(spark, d):
    out = aggregates.rule_of_mixtures(raw(spark, d)).select("material_id", *MIX, "electronegativity_difference")
    return rounded(out, 7)


@check("interaction_features", f"""SELECT material_id, {r('composition_1 * composition_2', 'comp_1_2')}, {r('composition_1 * composition_3', 'comp_1_3')}, {r('composition_2 * composition_3', 'comp_2_3')},
    {r('melting_point / (boiling_point + 1e-6)', 'mp_bp_ratio', 7)}, {r('electronegativity * electronegativity', 'electroneg_sq', 7)}, {r('atomic_radius * atomic_radius', 'radius_sq', 7)} FROM ({MIXED_SQL})""")
def interaction_features(spark, d):
    out = composition.with_interactions(aggregates.rule_of_mixtures(raw(spark, d)))
    first, second = ["comp_1_2", "comp_1_3", "comp_2_3"], ["mp_bp_ratio", "electroneg_sq", "radius_sq"]
    return out.select("material_id", *[F.round(c, 9).alias(c) for c in first], *[F.round(c, 7).alias(c) for c in second])


def _even(c: str, places: int) -> str:
    """Halves to even, on whole numbers of the ninth place."""
    unit = 10 ** (9 - places)
    return f"(n_{c} // {unit} + CASE WHEN n_{c} % {unit} * 2 > {unit} OR (n_{c} % {unit} * 2 = {unit} AND n_{c} // {unit} % 2 = 1) THEN 1 ELSE 0 END) / CAST({10 ** places} AS DOUBLE) AS {c}"


SHOWN = ["thermodynamic_stability_score", "ensemble_probability", "energy_above_hull", "density"]


@check("display_round", f"SELECT material_id, formula, thermodynamic_stability_category, {', '.join(_even(c, 3) for c in SHOWN)}, {_even('half', 2)} FROM (SELECT *, "
       + ", ".join(f"CAST(round({c} * 1e9) AS BIGINT) AS n_{c}" for c in SHOWN) + ", CAST(nsites AS BIGINT) * 5000000 AS n_half FROM ens)")
def display_round(spark, d):
    """Display tables; a column of halves as well."""
    out = scored(spark, d).withColumn("half", F.col("nsites") / 200).select("material_id", "formula", "thermodynamic_stability_category", *SHOWN, "half")
    return out.withColumns({**{c: basics.display_round(F.col(c)) for c in SHOWN}, "half": basics.display_round(F.col("half"), 2)})


@check("slots_from_list", "SELECT material_id, elements[1] AS element_1, elements[2] AS element_2 FROM full_materials")
def slots_from_list(spark, d):
    return composition.with_slots_from_elements(full(spark, d).select("material_id", "elements")).drop("elements")


@check("pair_key", "SELECT material_id, concat(element_1, '-', element_2) AS pair_key FROM materials")
def pair_key(spark, d):
    return raw(spark, d).select("material_id", composition.pair_key(F.col("element_1"), F.col("element_2")).alias("pair_key"))
