from __future__ import annotations

from pyspark.sql import functions as F

from alloyscreen.checks.core import check, full, outcomes, r, raw, rounded, scored
from alloyscreen.functions import methods
from alloyscreen.operators import features, joins, ranking


@check("feature_raw_join", f"SELECT f.material_id, f.formula, array_to_string(f.elements, ',') AS elements, {r('a.density', 'density')} FROM full_materials f JOIN full_materials a ON a.material_id = f.material_id")
def feature_raw_join(spark, d):
    table = full(spark, d)
    out = joins.join_features(table.select("material_id", "density"), table)
    return out.withColumn("elements", F.array_join("elements", ","))


@check("align_features", "SELECT material_id, formula, density FROM full_materials WHERE nsites <= 20")
def align_features(spark, d):
    """The two sides differ in length and order; the key, not the position, aligns them."""
    table = full(spark, d)
    short = table.filter("nsites <= 20").select("material_id", "density").repartition("density")
    return joins.join_features(short, table, ["formula"])


@check("has_outcome", "SELECT material_id, formula FROM full_materials WHERE formula IN (SELECT formula FROM outcomes WHERE formula IS NOT NULL AND outcome = 'Successful' AND ml_pred > 0.9)")
def has_outcome(spark, d):
    logged = outcomes(spark, d).filter("outcome = 'Successful' AND ml_pred > 0.9")
    return joins.filter_by_outcome(full(spark, d), logged, "Has Outcome Logged").select("material_id", "formula")


@check("no_outcome", "SELECT material_id, formula FROM full_materials WHERE formula NOT IN (SELECT formula FROM outcomes WHERE formula IS NOT NULL AND outcome = 'Successful' AND ml_pred > 0.9)")
def no_outcome(spark, d):
    logged = outcomes(spark, d).filter("outcome = 'Successful' AND ml_pred > 0.9")
    return joins.filter_by_outcome(full(spark, d), logged, "No Outcome Logged").select("material_id", "formula")


@check("outcome_enrich", f"""SELECT o.outcome_id, o.formula, o.outcome, {r('p.ml', 'ml_pred')}, {r('p.rule', 'llm_pred')}, {r('p.hull', 'e_hull')} FROM outcomes o LEFT JOIN
    (SELECT formula, arg_min(synthesizability_probability, material_id) AS ml, arg_min(rule_probability, material_id) AS rule, arg_min(energy_above_hull, material_id) AS hull FROM ruled GROUP BY formula) p
    ON o.formula = p.formula""")
def outcome_enrich(spark, d):
    out = joins.enrich_outcomes(outcomes(spark, d), scored(spark, d))
    return rounded(out.select("outcome_id", "formula", "outcome", "ml_pred", "llm_pred", "e_hull"))


@check("map_net_benefit", f"""SELECT f.material_id, f.formula, {r('b.net_benefit', 'estimated_net_benefit', 5)} FROM full_materials f LEFT JOIN
    (SELECT formula, arg_max(net_benefit, material_id) AS net_benefit FROM costed WHERE net_benefit > 0 GROUP BY formula) b ON f.formula = b.formula""")
def map_net_benefit(spark, d):
    benefits = scored(spark, d).transform(methods.with_cost_benefit).filter("net_benefit > 0")
    out = joins.map_net_benefit(full(spark, d), benefits.select("formula", "material_id", "net_benefit"))
    return out.select("material_id", "formula", F.round("estimated_net_benefit", 5).alias("estimated_net_benefit"))


@check("topup_anti", f"""SELECT material_id, formula, {r('synthesis_priority_score', 'synthesis_priority_score')} FROM prio WHERE formula NOT IN (SELECT formula FROM prio WHERE ensemble_confidence >= 0.6)
    ORDER BY round(synthesis_priority_score, 9) DESC, material_id LIMIT 25""")
def topup_anti(spark, d):
    table = scored(spark, d).transform(ranking.with_priority_score)
    order = [F.desc(F.round("synthesis_priority_score", 9)), F.col("material_id")]
    out = joins.top_up(table.filter("ensemble_confidence >= 0.6"), table, 25, order)
    return rounded(out.select("material_id", "formula", "synthesis_priority_score"))


@check("element_lookup", """SELECT s.material_id, s.slot, s.element AS symbol, s.fraction, e.atomic_number, e.electronegativity, e.atomic_radius, e.melting_point FROM (
    SELECT material_id, 1 AS slot, element_1 AS element, composition_1 AS fraction FROM materials UNION ALL SELECT material_id, 2, element_2, composition_2 FROM materials
    UNION ALL SELECT material_id, 3, element_3, composition_3 FROM materials) s JOIN alloy_elements e ON s.element = e.symbol WHERE s.fraction > 0""")
def element_lookup(spark, d):
    return joins.slot_properties(raw(spark, d)).select(
        "material_id", "slot", "symbol", "fraction", "atomic_number", "electronegativity", "atomic_radius", "melting_point"
    )


@check("material_method", "SELECT m.material_id, k.method_key FROM materials m CROSS JOIN methods k")
def material_method(spark, d):
    return joins.material_methods(raw(spark, d)).select("material_id", "method_key")


@check("feature_table_join", f"SELECT f.material_id, t.formula, {r('f.electronegativity', 'electronegativity', 8)} FROM pair_features f JOIN pair_train_all t ON f.material_id = t.material_id")
def feature_table_join(spark, d):
    table, rows = features.training_dataset(full(spark, d).withColumnRenamed("formula", "formula_pretty"))
    out = joins.join_features(table, rows, ["formula"])
    return rounded(out.select("material_id", "formula", "electronegativity"), 8)
