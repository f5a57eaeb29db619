from __future__ import annotations

from pyspark.sql import functions as F

from alloyscreen.checks.core import check, full, outcomes, r, raw, rounded, scored
from alloyscreen.functions import methods, safety
from alloyscreen.operators import aggregates, bootstrap, isotonic, metrics, ordered, ranking, sampling

PROPERTIES = ["energy_above_hull", "density", "electronegativity", "atomic_radius", "band_gap"]


@check("tertiary_coverage", f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE composition_3 > 1e-6) AS tertiary_rows, {r('count(*) FILTER (WHERE composition_3 > 1e-6) / count(*)', 'tertiary_fraction')},
    count(*) >= 50 AND count(*) FILTER (WHERE composition_3 > 1e-6) / count(*) >= 0.15 AS recommended FROM materials""")
def tertiary_coverage(spark, d):
    return rounded(aggregates.tertiary_coverage(raw(spark, d)))


@check("value_counts", "SELECT element_1, element_2, count(*) AS n FROM materials GROUP BY ALL ORDER BY n DESC, element_1, element_2 LIMIT 10")
def value_counts(spark, d):
    return aggregates.value_counts(raw(spark, d), ["element_1", "element_2"], 10)


@check("class_balance", "SELECT CASE WHEN energy_above_hull <= 0.1 THEN 1 ELSE 0 END AS synthesizable, count(*) AS n FROM materials GROUP BY ALL")
def class_balance(spark, d):
    from alloyscreen.functions.stability import label_proxy

    return aggregates.value_counts(label_proxy(raw(spark, d)), ["synthesizable"])


@check("describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS field, count({c}) AS "count", {r(f'avg({c})', 'mean', 7)}, {r(f'stddev_samp({c})', 'std', 7)}, {r(f'min({c})', '"min"')}, {r(f'max({c})', '"max"')},
    {r(f'quantile_cont({c}, 0.25)', 'q25')}, {r(f'quantile_cont({c}, 0.5)', 'q50')}, {r(f'quantile_cont({c}, 0.75)', 'q75')} FROM materials""" for c in PROPERTIES))
def describe(spark, d):
    out = rounded(aggregates.describe(raw(spark, d), PROPERTIES))
    return out.withColumns({"mean": F.round("mean", 7), "std": F.round("std", 7)})


@check("element_means", "SELECT m.material_id, " + ", ".join(
    r(f"coalesce(list_avg(list_filter([e1.{c}, e2.{c}, e3.{c}], lambda x: x IS NOT NULL)), 0)", a)
    for c, a in (("atomic_number", "avg_atomic_number"), ("electronegativity", "electronegativity"), ("atomic_radius", "atomic_radius"))
) + " FROM full_materials m LEFT JOIN alloy_elements e1 ON m.element_1 = e1.symbol LEFT JOIN alloy_elements e2 ON m.element_2 = e2.symbol LEFT JOIN alloy_elements e3 ON m.element_3 = e3.symbol")
def element_means(spark, d):
    out = aggregates.element_means(full(spark, d).select("material_id", "elements"))
    return rounded(out.drop("elements"))


@check("element_totals", f"""SELECT t.element, CAST(w.atomic_number AS INT) AS atomic_number, CAST(w.atomic_weight AS DOUBLE) AS atomic_mass, {r('t.total', 'total_fraction', 4)}, {r('t.total / sum(t.total) OVER () * 100', 'atomic_percent', 7)} FROM (
    SELECT element, sum(fraction) AS total FROM (SELECT element_1 AS element, composition_1 AS fraction FROM materials UNION ALL SELECT element_2, composition_2 FROM materials
    UNION ALL SELECT element_3, composition_3 FROM materials) WHERE element IS NOT NULL AND fraction IS NOT NULL GROUP BY element) t LEFT JOIN weights w ON w.symbol = t.element""")
def element_totals(spark, d):
    out = aggregates.element_totals(raw(spark, d))
    return out.withColumns({"total_fraction": F.round("total_fraction", 4), "atomic_percent": F.round("atomic_percent", 7)})


RULES = ["radius", "electronegativity", "valence", "structure"]
HUME = """(SELECT m.material_id, abs(a.radius - b.radius) / greatest(a.radius, b.radius) > 0.15 AS radius_bad, abs(a.chi - b.chi) > 0.4 AS electronegativity_bad, abs(a.valence - b.valence) > 1 AS valence_bad,
    (a.structure = 'FCC' AND b.structure = 'BCC') OR (a.structure = 'BCC' AND b.structure = 'FCC') AS structure_bad
    FROM materials m LEFT JOIN solution_elements a ON m.element_1 = a.symbol LEFT JOIN solution_elements b ON m.element_2 = b.symbol)"""


@check("hume_rothery", "SELECT *, CASE WHEN valid_percent > 70 THEN 'good' WHEN valid_percent > 50 THEN 'moderate' ELSE 'low' END AS compliance FROM (SELECT count(*) AS total_materials, "
       "count(*) FILTER (WHERE NOT (radius_bad OR electronegativity_bad OR valence_bad OR structure_bad)) AS valid_compositions, "
       "count(*) FILTER (WHERE radius_bad OR electronegativity_bad OR valence_bad OR structure_bad) AS violating_compositions, "
       + ", ".join(f"count(*) FILTER (WHERE {x}_bad) AS {x}_violations, {r(f'count(*) FILTER (WHERE {x}_bad) * 100.0 / count(*)', f'{x}_percent')}" for x in RULES)
       + f", {r('count(*) FILTER (WHERE NOT (radius_bad OR electronegativity_bad OR valence_bad OR structure_bad)) * 100.0 / count(*)', 'valid_percent')} FROM {HUME})")
def hume_rothery(spark, d):
    return rounded(aggregates.hume_rothery(raw(spark, d)))


@check("best_method", f"SELECT material_id, method_key, {r('method_score', 'method_score')} FROM best_method")
def best_method(spark, d):
    return rounded(methods.with_best_method(scored(spark, d)).select("material_id", "method_key", "method_score"))


@check("best_method_none", "SELECT material_id, CAST(NULL AS VARCHAR) AS method_key, 'No suitable method available' AS recommended_method, CAST(0 AS DOUBLE) AS net_benefit FROM materials")
def best_method_none(spark, d):
    return methods.with_cost_benefit(scored(spark, d), []).select("material_id", "method_key", "recommended_method", "net_benefit")


@check("safety_summary", """SELECT count(*) AS total_materials, count(*) FILTER (WHERE safety_class = 'safe') AS safe_materials, count(*) FILTER (WHERE safety_class = 'unsafe') AS unsafe_materials,
    count(*) FILTER (WHERE safety_class = 'human_review') AS human_review_materials, count(*) FILTER (WHERE safety_class = 'safe') AS exported_materials FROM classed""")
def safety_summary(spark, d):
    return aggregates.safety_summary(safety.with_safety_class(scored(spark, d)))


@check("generation_summary", f"""SELECT count(*) AS total_materials, CAST(sum(ensemble_prediction) AS BIGINT) AS predicted_synthesizable, count(*) FILTER (WHERE ensemble_confidence > 0.8) AS high_confidence,
    count(*) FILTER (WHERE ensemble_probability >= 0.8 AND energy_above_hull <= 0.15 AND in_distribution = 'in-dist') AS gate_passing, count(*) FILTER (WHERE synthesis_priority_score > 0.7) AS high_priority,
    count(*) FILTER (WHERE net_benefit > 0) AS positive_net_benefit, {r('avg(net_benefit)', 'mean_net_benefit', 4)} FROM costed""")
def generation_summary(spark, d):
    from alloyscreen.plans.screening import summary

    return rounded(summary(full(spark, d)), 4)


WORKFLOW = """(SELECT p.*, row_number() OVER (ORDER BY round(synthesis_priority_score, 9) DESC, p.material_id) AS step, round((m.prep_time_hours + m.synthesis_time_hours + m.cooling_time_hours) / 24, 1) AS days
    FROM prio p JOIN best_method b ON p.material_id = b.material_id JOIN methods m ON b.method_key = m.method_key
    ORDER BY round(synthesis_priority_score, 9) DESC, p.material_id LIMIT {n})"""


@check("workflow_summary", f"""SELECT count(*) AS total_steps, CAST(max((step - 1) // 5 + 1) AS INT) AS batches, count(*) FILTER (WHERE step <= 3) AS high_priority, count(*) FILTER (WHERE step BETWEEN 4 AND 7) AS medium_priority,
    count(*) FILTER (WHERE step BETWEEN 8 AND 10) AS low_priority, {r('sum(days)', 'total_days', 6)}, {r('avg(days)', 'mean_days', 6)} FROM {WORKFLOW.format(n=12)}""")
def workflow_summary(spark, d):
    return rounded(aggregates.workflow_summary(ranking.experimental_workflow(scored(spark, d), 12)), 6)


FLAGS = """(SELECT *, ml_pred >= 0.5 OR llm_pred >= 0.5 AS p, outcome IN ('Successful', 'Partial success') AS a, ml_pred * 0.7 + llm_pred * 0.3 AS e FROM outcomes)"""


@check("validation_metrics", f"""SELECT count(*) AS total_experiments, {r("count(*) FILTER (WHERE outcome = 'Successful') / count(*)", 'success_rate')}, {r('count(*) FILTER (WHERE p AND a) / count(*) FILTER (WHERE p)', 'precision')},
    {r('count(*) FILTER (WHERE p AND a) / count(*) FILTER (WHERE a)', 'recall')} FROM {FLAGS}""")
def validation_metrics(spark, d):
    return rounded(metrics.validation_metrics(outcomes(spark, d)))


@check("outcome_calibration", f"""SELECT {r('avg(abs(p - a))', 'calibration_error', 8)}, count(*) AS bins_used FROM (SELECT ceil(e * 10 - 1e-9) AS b, avg(e) AS p, avg(CAST(a AS INT)) AS a FROM {FLAGS} WHERE e > 0 AND e <= 1 GROUP BY b)""")
def outcome_calibration(spark, d):
    return rounded(metrics.outcome_calibration(outcomes(spark, d)), 8)


JUDGED = "(SELECT material_id, CASE WHEN energy_above_hull <= 0.1 THEN 1 ELSE 0 END AS y, synthesizability_probability AS p FROM materials)"


def _judged(spark, d):
    label = F.when(F.col("energy_above_hull") <= 0.1, 1).otherwise(0)
    p = F.col("synthesizability_probability")
    return raw(spark, d).select("material_id", label.alias("label"), p.alias("probability"), F.when(p >= 0.5, 1).otherwise(0).alias("prediction"))


@check("confusion_metrics", f"""SELECT n, tp, fp, fn, tn, {r('(tp + tn) / n', 'accuracy')}, {r('tp / (tp + fp)', 'precision')}, {r('tp / (tp + fn)', 'recall')}, {r('2 * tp / (2 * tp + fp + fn)', 'f1_score')} FROM (
    SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn FROM {JUDGED})""")
def confusion_metrics(spark, d):
    return rounded(metrics.confusion_metrics(_judged(spark, d)))


CURVE = f"(SELECT CAST(least(greatest(ceil(p * 10 - 1e-9) - 1, 0), 9) AS INT) AS bin, avg(p) AS mp, avg(y) AS fy, count(*) AS n, sum((p - y) * (p - y)) AS se FROM {JUDGED} GROUP BY 1)"


@check("reliability_curve", f"SELECT bin, {r('mp', 'mean_predicted', 8)}, {r('fy', 'fraction_positive', 8)}, n FROM {CURVE}")
def reliability_curve(spark, d):
    return rounded(metrics.reliability_curve(_judged(spark, d)).drop("squared_error"), 8)


CALIBRATION = f"(SELECT avg(abs(fy - mp)) AS ece, sum(se) / sum(n) AS brier, max(abs(fy - mp)) AS worst FROM {CURVE})"


@check("calibration_metrics", f"SELECT {r('ece', 'expected_calibration_error', 8)}, {r('brier', 'brier_score', 8)}, {r('worst', 'max_calibration_error', 8)} FROM {CALIBRATION}")
def calibration_metrics(spark, d):
    return rounded(metrics.calibration_metrics(_judged(spark, d)), 8)


@check("calibration_grade", f"SELECT {r('ece', 'expected_calibration_error', 8)}, CASE WHEN ece < 0.05 THEN 'well_calibrated' WHEN ece < 0.1 THEN 'moderately_calibrated' ELSE 'poorly_calibrated' END AS calibration_status, ece < 0.15 AS reliable FROM {CALIBRATION}")
def calibration_grade(spark, d):
    out = metrics.with_calibration_grade(metrics.calibration_metrics(_judged(spark, d)))
    return rounded(out.select("expected_calibration_error", "calibration_status", "reliable"), 8)


@check("reweight", f"SELECT {r('w', 'ml_weight', 8)}, {r('1 - w', 'rule_weight', 8)} FROM (SELECT CASE WHEN ece > 0.1 THEN greatest(0.4, 0.7 - least(0.3, 2 * ece)) ELSE 0.7 END AS w FROM {CALIBRATION})")
def reweight(spark, d):
    return rounded(metrics.with_ensemble_weights(metrics.calibration_metrics(_judged(spark, d))).select("ml_weight", "rule_weight"), 8)


@check("best_threshold", f"""SELECT {r('least(greatest(t, 0.2), 0.8)', 'decision_threshold')}, {r('f1', 'best_f1')}, {r('t', 'raw_threshold')} FROM (SELECT t, round(2 * pr * re / greatest(pr + re, 1e-8), 12) AS f1 FROM (
    SELECT p AS t, sum(sum(y)) OVER w / sum(count(*)) OVER w AS pr, sum(sum(y)) OVER w / sum(sum(y)) OVER () AS re FROM {JUDGED} GROUP BY p WINDOW w AS (ORDER BY p DESC)) ORDER BY f1 DESC, t LIMIT 1)""")
def best_threshold(spark, d):
    return rounded(metrics.best_threshold(_judged(spark, d)))


BUCKET = "CAST(concat('0x', substr(md5(material_id), {start}, 5)) AS INT)"


@check("class_rebalance", f"""SELECT material_id, label, CASE WHEN label = minority THEN CAST(floor(ratio) AS INT) + CASE WHEN {BUCKET.format(start=11)} < (ratio - floor(ratio)) * 1048576 THEN 1 ELSE 0 END ELSE 1 END AS copies
    FROM (SELECT material_id, CASE WHEN energy_above_hull <= 0.025 THEN 1 ELSE 0 END AS label FROM materials WHERE energy_above_hull <= 0.025 OR energy_above_hull >= 0.1) CROSS JOIN
    (SELECT CASE WHEN pos < neg THEN 1 ELSE 0 END AS minority, greatest(pos, neg) / least(pos, neg) AS ratio FROM (SELECT count(*) FILTER (WHERE energy_above_hull <= 0.025) AS pos, count(*) FILTER (WHERE energy_above_hull >= 0.1) AS neg FROM materials))""")
def class_rebalance(spark, d):
    from alloyscreen.functions.stability import label_stability

    table = label_stability(raw(spark, d), "label").select("material_id", "label")
    return sampling.rebalance(table, "label").groupBy("material_id", "label").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@check("stratified_split", f"""SELECT material_id, label, upto <= n * 0.2 AS is_test FROM (SELECT *, sum(1) OVER (PARTITION BY label ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, count(*) OVER (PARTITION BY label) AS n FROM (
    SELECT material_id, CASE WHEN energy_above_hull <= 0.025 THEN 1 ELSE 0 END AS label, {BUCKET.format(start=1)} AS b FROM materials WHERE energy_above_hull <= 0.025 OR energy_above_hull >= 0.1))""")
def stratified_split(spark, d):
    from alloyscreen.functions.stability import label_stability

    table = label_stability(raw(spark, d), "label").select("material_id", "label")
    return sampling.stratified_split(table, "label", 0.2)


def _histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""SELECT bin, {r('lo + bin * w', 'bin_start', 8)}, {r('lo + (bin + 1) * w', 'bin_end', 8)}, count(*) AS n FROM (SELECT CAST(least(floor(({column} - lo) / w), {bins - 1}) AS INT) AS bin, lo, w
    FROM {source} CROSS JOIN (SELECT min({column}) AS lo, (max({column}) - min({column})) / {bins} AS w FROM {source})) GROUP BY bin, lo, w"""


@check("histogram", _histogram_sql("prio", "ensemble_probability", 20))
def histogram(spark, d):
    return rounded(aggregates.histogram(scored(spark, d), "ensemble_probability", 20), 8)


@check("histogram_priority", _histogram_sql("prio", "synthesis_priority_score", 15))
def histogram_priority(spark, d):
    return rounded(aggregates.histogram(ranking.with_priority_score(scored(spark, d)), "synthesis_priority_score", 15), 8)


KS_FIELDS = ["density", "electronegativity", "atomic_radius", "energy_above_hull"]


@check("ks_two_sample", " UNION ALL ".join(
    f"""SELECT '{c}' AS field, {r('max(abs(sa / na - sb / nb))', 'ks_stat')}, CAST(max(na) AS BIGINT) AS n_first, CAST(max(nb) AS BIGINT) AS n_second FROM (SELECT sum(a) OVER w AS sa, sum(b) OVER w AS sb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM (
    SELECT {c} AS v, count(*) FILTER (WHERE composition_3 = 0) AS a, count(*) FILTER (WHERE composition_3 > 0) AS b FROM materials GROUP BY 1) WINDOW w AS (ORDER BY v))""" for c in KS_FIELDS))
def ks_two_sample(spark, d):
    table = raw(spark, d)
    out = ordered.ks_statistics(table.filter("composition_3 = 0"), table.filter("composition_3 > 0"), KS_FIELDS)
    return rounded(out.drop("p_value"))


_CDF = "[" + ", ".join("[" + ", ".join(f"CAST({p!r} AS DOUBLE)" for p in row) + "]" for row in bootstrap.poisson_table()) + "]"
_UNIFORM = "(CAST(CAST(concat('0x', substr(h, {start}, 13)) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496"
_KOLMOGOROV = " + ".join(f"({2.0 * (-1) ** (k - 1)}) * exp({-2.0 * k * k} * x * x)" for k in range(1, 21))
BOOTSTRAP = f"""(SELECT field, avg(p) AS mean_p, 1 - stddev_pop(p) AS p_stability, quantile_cont(p, 0.025) AS ci_low, quantile_cont(p, 0.975) AS ci_high FROM (
    SELECT field, CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, {_KOLMOGOROV})) END AS p FROM (SELECT field, replicate, max(abs(sa / na - sb / nb)) * sqrt(any_value(na) * any_value(nb) / (any_value(na) + any_value(nb))) AS x FROM (
    SELECT field, replicate, CAST(sum(a) OVER w AS DOUBLE) AS sa, CAST(sum(b) OVER w AS DOUBLE) AS sb, CAST(sum(a) OVER (PARTITION BY field, replicate) AS DOUBLE) AS na, CAST(sum(b) OVER (PARTITION BY field, replicate) AS DOUBLE) AS nb FROM (
    SELECT *, CASE WHEN n = 0 THEN 0 WHEN n <= {bootstrap.TABLE_RATE} THEN len(list_filter(list_extract({_CDF}, CAST(n AS INT)), lambda q: q <= u1)) ELSE greatest(0, floor(n + sqrt(n) * z + (z * z - 1) / 6 + 0.5)) END AS b FROM (
    SELECT *, sqrt(-2 * ln(u1)) * cos(u2 * 2 * pi()) AS z FROM (SELECT *, {_UNIFORM.format(start=1)} AS u1, {_UNIFORM.format(start=14)} AS u2 FROM (
    SELECT *, md5(concat_ws('|', field, CAST(CAST(value AS DECIMAL(38, 12)) AS VARCHAR), CAST(replicate + 42000000 AS VARCHAR))) AS h FROM (SELECT *, unnest(generate_series(1, 100)) AS replicate FROM (
    {" UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) FILTER (WHERE composition_3 = 0) AS a, count(*) FILTER (WHERE composition_3 > 0) AS n FROM materials GROUP BY 2" for c in KS_FIELDS)})))))) WINDOW w AS (PARTITION BY field, replicate ORDER BY value))
    GROUP BY field, replicate)) GROUP BY field)"""


def _bootstrap(spark, d):
    table = raw(spark, d)
    return bootstrap.ks_bootstrap(table.filter("composition_3 = 0"), table.filter("composition_3 > 0"), KS_FIELDS)


@check("ks_bootstrap", f"""SELECT field, {r('mean_p', 'mean_p_value', 7)}, {r('p_stability', 'p_stability', 7)}, {r('ci_low', 'ci_low', 7)}, {r('ci_high', 'ci_high', 7)},
    CASE WHEN mean_p > 0.05 THEN 'good' ELSE 'poor' END AS distribution_similarity FROM {BOOTSTRAP}""")
def ks_bootstrap(spark, d):
    return rounded(_bootstrap(spark, d), 7)


@check("ks_bootstrap_overall", f"""SELECT {r('stability', 'average_stability', 7)}, good_matches, fields, CASE WHEN stability > 0.8 AND good_matches >= 3 THEN 'high' WHEN stability > 0.6 AND good_matches >= 2 THEN 'moderate' ELSE 'low' END AS robustness
    FROM (SELECT avg(p_stability) AS stability, count(*) FILTER (WHERE mean_p > 0.05) AS good_matches, count(*) AS fields FROM {BOOTSTRAP})""")
def ks_bootstrap_overall(spark, d):
    return rounded(bootstrap.overall_assessment(_bootstrap(spark, d)), 7)


# The fit as greatest of least means: over all runs of scores that begin at or before a score and end at or after it.
FIT = """(SELECT x, value, lead(x) OVER (ORDER BY x) AS next_x, lead(value) OVER (ORDER BY x) AS next_value FROM (SELECT x, max(lowest) AS value FROM (
    SELECT b.x AS x, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.x ORDER BY b.x DESC) AS lowest FROM {scores} a JOIN {scores} b ON a.x <= b.x) GROUP BY x))""".replace(
    "{scores}", """(SELECT x, n, s, CAST(sum(n) OVER (ORDER BY x) AS DOUBLE) AS cn, CAST(sum(s) OVER (ORDER BY x) AS DOUBLE) AS cs FROM (SELECT synthesizability_probability AS x, count(*) AS n, count(*) FILTER (WHERE energy_above_hull <= 0.025) AS s
    FROM materials WHERE energy_above_hull <= 0.025 OR energy_above_hull >= 0.1 GROUP BY 1))""")


@check("isotonic_fit", f"""SELECT x AS score, {r('value', 'calibrated')}, {r('CASE WHEN next_x IS NULL THEN value ELSE value + (next_value - value) * least(1, (x + 0.0004 - x) / (next_x - x)) END', 'between', 7)} FROM {FIT}""")
def isotonic_fit(spark, d):
    """The fitted value at each score, held by every task, and a little above it, by range slices."""
    from alloyscreen.functions.stability import label_stability

    table = label_stability(raw(spark, d), "label").select("synthesizability_probability", "label")
    blocks = isotonic.fit_isotonic(table, "synthesizability_probability", "label", slices=16)
    asked = table.select(F.col("synthesizability_probability").alias("score")).distinct().withColumn("above", F.col("score") + 0.0004)
    out = isotonic.calibrated(isotonic.calibrated(asked, blocks, "score", "calibrated"), blocks, "above", "between", held_blocks=0)
    return out.select("score", F.round("calibrated", 9).alias("calibrated"), F.round("between", 7).alias("between"))


NOVEL_FIELDS = ["density", "electronegativity", "atomic_radius"]
RANGE_SQL = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in NOVEL_FIELDS)


@check("range_novelty", "SELECT count(*) AS total_materials, count(*) FILTER (WHERE novel) AS novel_materials, " + r("count(*) FILTER (WHERE novel) * 100.0 / count(*)", "novel_percent") + " FROM (SELECT "
       + " OR ".join(f"{c} < {c}_lo * 0.9 OR {c} > {c}_hi * 1.1" for c in NOVEL_FIELDS)
       + f" AS novel FROM materials CROSS JOIN (SELECT {RANGE_SQL} FROM materials WHERE energy_above_hull <= 0.1 AND density BETWEEN 5 AND 20) WHERE energy_above_hull > 0.1)")
def range_novelty(spark, d):
    table = raw(spark, d)
    known = table.filter("energy_above_hull <= 0.1 AND density BETWEEN 5 AND 20")
    return rounded(aggregates.range_novelty(table.filter("energy_above_hull > 0.1"), known, NOVEL_FIELDS))


@check("coverage_ratio", "SELECT " + r("(" + " + ".join(f"(max(m.{c}) - min(m.{c})) / any_value(s.{c})" for c in NOVEL_FIELDS) + ") / 3", "range_coverage", 8) + ", "
       + r("(" + " + ".join(f"stddev_pop(m.{c})" for c in NOVEL_FIELDS) + ") / 3", "mean_std", 7)
       + " FROM materials m CROSS JOIN (SELECT " + ", ".join(f"max({c}) - min({c}) AS {c}" for c in NOVEL_FIELDS) + " FROM materials) s WHERE m.energy_above_hull <= 0.01")
def coverage_ratio(spark, d):
    table = raw(spark, d)
    out = aggregates.coverage_ratio(table.filter("energy_above_hull <= 0.01"), table, NOVEL_FIELDS)
    return out.select(F.round("range_coverage", 8).alias("range_coverage"), F.round("mean_std", 7).alias("mean_std"))


@check("outcome_table", f"""SELECT formula, outcome, {r('ml_pred * 0.7 + llm_pred * 0.3', 'predicted_probability')}, CASE WHEN outcome IN ('Successful', 'Partial success') THEN 1 ELSE 0 END AS actual_success, notes
    FROM outcomes ORDER BY attempted_date DESC, outcome_id DESC LIMIT 10""")
def outcome_table(spark, d):
    return rounded(ranking.outcome_table(outcomes(spark, d)))
