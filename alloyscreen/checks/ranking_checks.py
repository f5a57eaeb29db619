from __future__ import annotations

from pyspark.sql import functions as F

from alloyscreen.checks.aggregate_checks import CURVE, WORKFLOW, _judged
from alloyscreen.checks.core import check, full, outcomes, r, raw, rounded, scored
from alloyscreen.functions import methods
from alloyscreen.operators import features, metrics, novelty, ordered, ranking
from alloyscreen.plans import screening

SCORE = r("synthesis_priority_score", "synthesis_priority_score")
TOP = "ORDER BY round(synthesis_priority_score, 9) DESC, material_id LIMIT 20"


@check("screen_top20", f"""SELECT material_id, formula, thermodynamic_stability_category, {r('thermodynamic_stability_score', 'thermodynamic_stability_score')}, {r('rule_probability', 'rule_probability')},
    {r('ensemble_probability', 'ensemble_probability')}, {r('ensemble_confidence', 'ensemble_confidence')}, energy_above_hull, {SCORE} FROM prio {TOP}""")
def screen_top20(spark, d):
    return rounded(screening.top_candidates(full(spark, d)).select(
        "material_id", "formula", "thermodynamic_stability_category", "thermodynamic_stability_score", "rule_probability",
        "ensemble_probability", "ensemble_confidence", "energy_above_hull", "synthesis_priority_score",
    ))


@check("screen_all", f"""SELECT c.material_id, {r('synthesis_priority_score', 'synthesis_priority_score')}, c.method_key, {r('c.net_benefit', 'net_benefit', 5)}, {r('w.weight_percent_1', 'weight_percent_1', 8)}
    FROM costed c JOIN weighed w ON c.material_id = w.material_id""")
def screen_all(spark, d):
    out = screening.screen(full(spark, d))
    return out.select("material_id", F.round("synthesis_priority_score", 9).alias("synthesis_priority_score"), "method_key",
                      F.round("net_benefit", 5).alias("net_benefit"), F.round("weight_percent_1", 8).alias("weight_percent_1"))


@check("priority_rank", f"""SELECT material_id, {SCORE}, CAST(floor(rank() OVER (ORDER BY round(synthesis_priority_score, 9) DESC) + (count(*) OVER (PARTITION BY round(synthesis_priority_score, 9)) - 1) / 2) AS BIGINT) AS synthesis_priority_rank FROM prio""")
def priority_rank(spark, d):
    return rounded(ranking.priority_rank(scored(spark, d)).select("material_id", "synthesis_priority_score", "synthesis_priority_rank"))


@check("final_rank", f"SELECT material_id, {r('final_priority_score', 'final_priority_score')}, row_number() OVER (ORDER BY round(final_priority_score, 9) DESC, material_id) AS final_priority_rank FROM route")
def final_rank(spark, d):
    return rounded(ranking.final_rank(screening.safety_first(full(spark, d))).select("material_id", "final_priority_score", "final_priority_rank"))


@check("last_n_hit_rate", f"""SELECT count(*) AS recent_experiments, {r("count(*) FILTER (WHERE outcome = 'Successful') / count(*)", 'hit_rate_last_10')} FROM (SELECT * FROM outcomes ORDER BY attempted_date DESC, outcome_id DESC LIMIT 10)""")
def last_n_hit_rate(spark, d):
    return rounded(ranking.last_hit_rate(outcomes(spark, d)))


NOVELTY_FEATURES = ["formation_energy_per_atom", "energy_above_hull", "nsites", "density", "electronegativity", "atomic_radius", "band_gap"]


def _z(prefix: str, alias: str) -> str:
    return ", ".join(f"({prefix}.{c} - s.{c}_m) / s.{c}_s AS {alias}{i}" for i, c in enumerate(NOVELTY_FEATURES))


_D = "sqrt(" + " + ".join(f"(a{i} - b{i}) * (a{i} - b{i})" for i in range(7)) + ")"
NOVELTY_SQL = f"""WITH train AS (SELECT * FROM train_features), s AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in NOVELTY_FEATURES)} FROM train),
    b AS (SELECT {_z('t', 'b')} FROM train t CROSS JOIN s), a AS (SELECT t.material_id, {_z('t', 'a')} FROM {{source}} t CROSS JOIN s), ta AS (SELECT t.material_id, {_z('t', 'a')} FROM train t CROSS JOIN s),
    near AS (SELECT material_id, list_avg(min({_D}, 5)) AS d FROM a CROSS JOIN b GROUP BY material_id), own AS (SELECT material_id, list_avg(min({_D}, 5)) AS d FROM ta CROSS JOIN b GROUP BY material_id)
    SELECT material_id, {r('d', 'nn_distance', 7)}, CASE WHEN d <= (SELECT quantile_cont(d, 0.95) FROM own) THEN 'in-dist' ELSE 'out-dist' END AS in_distribution FROM near"""


def _train(spark, d):
    table, _ = features.training_dataset(full(spark, d).withColumnRenamed("formula", "formula_pretty"), 1000)
    return table.select("material_id", *NOVELTY_FEATURES)


@check("novelty_distance", "SELECT * FROM (" + NOVELTY_SQL.format(source="std") + ")")
def novelty_distance(spark, d):
    from alloyscreen.session import materialize

    train = materialize(_train(spark, d))
    candidates = scored(spark, d).select("material_id", *NOVELTY_FEATURES)
    return rounded(novelty.with_novelty(candidates, train, NOVELTY_FEATURES).select("material_id", "nn_distance", "in_distribution"), 7)


@check("nearest_neighbours", "SELECT material_id, nn_distance FROM (" + NOVELTY_SQL.format(source="train") + ")")
def nearest_neighbours(spark, d):
    """A hundred rows are held by every task, the others lie in cells that a row visits where they may hold nearer ones."""
    from alloyscreen.session import materialize

    train = materialize(_train(spark, d))
    ready = novelty.scaled(train, novelty.scaling(train, NOVELTY_FEATURES))
    out = novelty.with_nearest(ready, ready, NOVELTY_FEATURES, "material_id", 5, limit=100)
    return rounded(out.select("material_id", "nn_distance"), 7)


@check("calibration_status", f"""SELECT material_id, {r('error', 'calibration_error', 8)}, CASE WHEN error < 0.1 THEN 'well-calibrated' WHEN error < 0.2 THEN 'overconfident' ELSE 'underconfident' END AS calibration_status FROM (
    SELECT material_id, abs(p - arg_min(fy, struct_pack(d := abs(mp - p), bin := bin))) AS error FROM (SELECT m.material_id, m.synthesizability_probability AS p, c.mp, c.fy, c.bin FROM materials m CROSS JOIN {CURVE} c) GROUP BY material_id, p)""")
def calibration_status(spark, d):
    out = metrics.with_calibration_status(raw(spark, d), metrics.reliability_curve(_judged(spark, d)))
    return rounded(out.select("material_id", "calibration_error", "calibration_status"), 8)


@check("experimental_workflow", f"""SELECT material_id, CAST(step AS INT) AS workflow_step, CAST((step - 1) // 5 + 1 AS INT) AS batch_number, CASE WHEN step <= 3 THEN 'High' WHEN step <= 7 THEN 'Medium' ELSE 'Low' END AS priority_level,
    {SCORE}, {r('ensemble_probability', 'ensemble_probability')}, energy_above_hull, formation_energy_per_atom, CAST(days AS DOUBLE) AS estimated_time_days, 'Arc Melter/Furnace' AS required_equipment FROM {WORKFLOW.format(n=10)}""")
def experimental_workflow(spark, d):
    return rounded(ranking.experimental_workflow(scored(spark, d)))


@check("safety_first_sort", f"""SELECT material_id, safety_rating, {r('composite_priority_score', 'composite_priority_score')}, row_number() OVER (ORDER BY safety_rating DESC, round(composite_priority_score, 9) DESC, round(ensemble_confidence, 9) DESC, material_id) AS place FROM route""")
def safety_first_sort(spark, d):
    out = ordered.with_row_rank(screening.safety_first(full(spark, d)), ranking.safety_first_values(), "place")
    return rounded(out.select("material_id", "safety_rating", "composite_priority_score", "place"))


@check("shortlist", f"""SELECT material_id, safety_check_passed, {r('composite_priority_score', 'composite_priority_score')} FROM route WHERE CASE WHEN (SELECT bool_or(safety_check_passed) FROM route) THEN safety_check_passed ELSE requires_human_override END
    ORDER BY safety_rating DESC, round(composite_priority_score, 9) DESC, round(ensemble_confidence, 9) DESC, material_id LIMIT 20""")
def shortlist(spark, d):
    return rounded(ranking.shortlist(screening.safety_first(full(spark, d))).select("material_id", "safety_check_passed", "composite_priority_score"))


POOL = """WITH best AS (SELECT formula, arg_max_null(expected_value - expected_cost, material_id) AS b FROM {source} GROUP BY formula),
    confident AS (SELECT t.*, best.b FROM route t LEFT JOIN best ON t.formula = best.formula WHERE ensemble_confidence >= {c}),
    more AS (SELECT *, CAST(NULL AS DOUBLE) AS b FROM route WHERE formula NOT IN (SELECT formula FROM confident) ORDER BY round(final_priority_score, 9) DESC, material_id LIMIT (SELECT greatest(10 - count(*), 0) FROM confident))"""


@check("candidate_pool", f"""SELECT * FROM ({POOL.format(c=0.6, source="route_costed")} SELECT material_id, formula, {r('final_priority_score', 'final_priority_score')}, {r('b', 'estimated_net_benefit', 5)} FROM (SELECT * FROM confident WHERE (SELECT count(*) FROM confident WHERE b > 0) < 10 OR b > 0 UNION ALL SELECT * FROM more))""")
def candidate_pool(spark, d):
    out = screening.safety_first_pool(full(spark, d))
    return out.select("material_id", "formula", F.round("final_priority_score", 9).alias("final_priority_score"), F.round("estimated_net_benefit", 5).alias("estimated_net_benefit"))


@check("candidate_pool_topped_up", f"""SELECT * FROM ({POOL.format(c=0.99999, source="route_costed")} SELECT material_id, formula, {r('final_priority_score', 'final_priority_score')} FROM (SELECT * FROM confident WHERE (SELECT count(*) FROM confident WHERE b > 0) < 10 OR b > 0 UNION ALL SELECT * FROM more))""")
def candidate_pool_topped_up(spark, d):
    out = screening.safety_first_pool(full(spark, d), confidence=0.99999)
    return rounded(out.select("material_id", "formula", "final_priority_score"))


BEST_FIVE = "(SELECT * FROM route_costed ORDER BY round(final_priority_score, 9) DESC, material_id LIMIT 5)"


@check("candidate_pool_of_five", f"""SELECT * FROM ({POOL.format(c=0.6, source=BEST_FIVE)} SELECT material_id, formula, {r('final_priority_score', 'final_priority_score')}, {r('b', 'estimated_net_benefit', 5)} FROM (SELECT * FROM confident WHERE (SELECT count(*) FROM confident WHERE b > 0) < 10 OR b > 0 UNION ALL SELECT * FROM more))""")
def candidate_pool_of_five(spark, d):
    """The pool when only the five best candidates have a net benefit."""
    out = screening.safety_first_pool(full(spark, d), 5)
    return out.select("material_id", "formula", F.round("final_priority_score", 9).alias("final_priority_score"), F.round("estimated_net_benefit", 5).alias("estimated_net_benefit"))


@check("topn", f"SELECT material_id, {r('ensemble_probability', 'ensemble_probability')} FROM ens WHERE ensemble_confidence > 0.8 ORDER BY round(ensemble_probability, 9) DESC, material_id LIMIT 10")
def topn(spark, d):
    return rounded(ranking.most_probable(scored(spark, d)).select("material_id", "ensemble_probability"))


@check("top5_cost_benefit", f"""SELECT material_id, method_name AS recommended_method, {r('net_benefit', 'net_benefit', 5)} FROM costed ORDER BY round(synthesis_priority_score, 9) DESC, material_id LIMIT 5""")
def top5_cost_benefit(spark, d):
    top = screening.top_candidates(full(spark, d), 5)
    out = methods.with_cost_benefit(top).select("material_id", "recommended_method", "net_benefit")
    return out.withColumn("net_benefit", F.round("net_benefit", 5))
