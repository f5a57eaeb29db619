from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from alloyscreen import schema
from alloyscreen.checks.core import ORACLES, check, full, outcomes, r, raw, rounded
from alloyscreen.operators import aggregates, features
from alloyscreen.plans import candidates, training
from alloyscreen.session import materialize, run_folder

FEATURE_COLUMNS = ["composition_1", "composition_2", "composition_3", "density", "electronegativity", "atomic_radius", "band_gap",
                   "energy_above_hull", "formation_energy_per_atom"]


def _source(spark, d):
    return full(spark, d).withColumnRenamed("formula", "formula_pretty")


@cache
def _table(spark, d):
    table, rows = features.training_dataset(_source(spark, d), 1000)
    return materialize(features.training_table(table, rows))


@cache
def _fitted(spark, d):
    return training.fit(_table(spark, d), features.feature_set(_table(spark, d), False))


@check("union_all", "SELECT material_id, 1 AS label FROM materials WHERE energy_above_hull <= 0.1 UNION ALL SELECT material_id, 0 FROM materials WHERE energy_above_hull > 0.1")
def union_all(spark, d):
    table = raw(spark, d).select("material_id", "energy_above_hull")
    good = table.filter("energy_above_hull <= 0.1").withColumn("label", F.lit(1))
    return good.unionByName(table.filter("energy_above_hull > 0.1").withColumn("label", F.lit(0))).drop("energy_above_hull")


@check("union_missing", "SELECT material_id, element_1, element_2, element_3, CASE WHEN element_3 IS NULL THEN 'binary' ELSE 'ternary' END AS alloy_type FROM materials")
def union_missing(spark, d):
    table = raw(spark, d)
    binary = table.filter("element_3 IS NULL").select("material_id", "element_1", "element_2", F.lit("binary").alias("alloy_type"))
    ternary = table.filter("element_3 IS NOT NULL").select("material_id", "element_1", "element_2", "element_3", F.lit("ternary").alias("alloy_type"))
    return binary.unionByName(ternary, allowMissingColumns=True)


@check("melt", "SELECT outcome_id, 'ml_pred' AS split, ml_pred AS loss FROM outcomes UNION ALL SELECT outcome_id, 'llm_pred', llm_pred FROM outcomes")
def melt(spark, d):
    return outcomes(spark, d).unpivot(["outcome_id"], ["ml_pred", "llm_pred"], "split", "loss")


VOCABULARY = ["Al", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Cd", "Pb"]


@check("one_hot_slots", "SELECT material_id, " + ", ".join(
    f"CASE WHEN coalesce(element_{i}, 'None') = '{e}' THEN 1 ELSE 0 END AS element_{i}_{e}" for i in (1, 2, 3) for e in [*VOCABULARY, "None"]) + " FROM materials")
def one_hot_slots(spark, d):
    out, names = features.one_hot_slots(raw(spark, d))
    return out.select("material_id", *names)


SCALED = ["density", "electronegativity", "atomic_radius"]


@check("scale", "SELECT material_id, " + ", ".join(r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c, 7) for c in SCALED) + " FROM materials")
def scale(spark, d):
    table = raw(spark, d)
    return rounded(features.scale(table, SCALED, features.fit_scaler(table, SCALED)).select("material_id", *SCALED), 7)


@check("scale_min_max", "SELECT material_id, " + ", ".join(r(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())", c) for c in SCALED) + " FROM materials")
def scale_min_max(spark, d):
    table = raw(spark, d)
    return rounded(features.scale(table, SCALED, features.fit_scaler(table, SCALED, "minmax")).select("material_id", *SCALED))


SELECT = ", ".join(r(f"f.{c}", c, 8) for c in FEATURE_COLUMNS)


@check("ml_features", "SELECT material_id, " + ", ".join(r(c, c, 8) for c in FEATURE_COLUMNS) + """, nsites FROM (SELECT m.material_id, c[1] / total AS composition_1, c[2] / total AS composition_2, coalesce(c[3], 0) / total AS composition_3, m.density,
    coalesce(list_avg(list_filter([e1.electronegativity, e2.electronegativity, e3.electronegativity], lambda x: x IS NOT NULL)), 0) AS electronegativity,
    coalesce(list_avg(list_filter([e1.atomic_radius, e2.atomic_radius, e3.atomic_radius], lambda x: x IS NOT NULL)), 0) AS atomic_radius,
    coalesce(m.band_gap, avg(m.band_gap) OVER ()) AS band_gap, m.energy_above_hull, m.formation_energy_per_atom, m.nsites
    FROM (SELECT *, list_sum(c) AS total FROM (SELECT *, list_sort(list_filter([composition_1, composition_2, composition_3], lambda x: x > 0), 'DESC') AS c FROM full_materials)) m
    LEFT JOIN alloy_elements e1 ON m.element_1 = e1.symbol LEFT JOIN alloy_elements e2 ON m.element_2 = e2.symbol LEFT JOIN alloy_elements e3 ON m.element_3 = e3.symbol)""")
def ml_features(spark, d):
    out = features.ml_features(full(spark, d))
    return rounded(out.select("material_id", *FEATURE_COLUMNS, "nsites"), 8)


@check("training_table", f"""SELECT f.material_id, {r('f.composition_1', 'composition_1', 8)}, {r('f.electronegativity', 'electronegativity', 8)}, t.band_gap, t.nsites, t.energy_above_hull, CASE WHEN t.energy_above_hull <= 0.025 THEN 1 ELSE 0 END AS synthesizable
    FROM train_features f JOIN train_rows t ON f.material_id = t.material_id WHERE t.energy_above_hull <= 0.025 OR t.energy_above_hull >= 0.1""")
def training_table(spark, d):
    out = _table(spark, d).select("material_id", "composition_1", "electronegativity", "band_gap", "nsites", "energy_above_hull", "synthesizable")
    return out.withColumns({c: F.round(c, 8) for c in ("composition_1", "electronegativity")})


@check("alloy_table", f"""SELECT f.material_id, t.formula, 'binary' AS alloy_type, t.elements[1] AS element_1, t.elements[2] AS element_2, {r('least(greatest(f.composition_1, 0.05), 0.95)', 'composition_1', 8)},
    {r('least(greatest(f.composition_2, 0.05), 0.95)', 'composition_2', 8)}, {r('f.electronegativity', 'electronegativity', 8)}, f.density FROM pair_features f JOIN pair_train_all t ON f.material_id = t.material_id WHERE len(t.elements) = 2""")
def alloy_table(spark, d):
    table, rows = features.training_dataset(_source(spark, d))
    out = features.alloy_table(table, rows)
    return rounded(out.select("material_id", "formula", "alloy_type", "element_1", "element_2", "composition_1", "composition_2", "electronegativity", "density"), 8)


@check("feature_set", "SELECT material_id, formation_energy_per_atom, energy_above_hull, band_gap, nsites, density, electronegativity, atomic_radius, composition_1, composition_2, composition_3 FROM materials")
def feature_set(spark, d):
    table = raw(spark, d)
    chosen = features.feature_set(table)
    return table.select("material_id", *chosen)


@check("fit_classifier")
def fit_classifier(spark, d):
    """Test metrics, with and without the column that the label is made from."""
    rows = []
    for name, fitted in (("all features", _fitted(spark, d)), ("without energy_above_hull", _blind(spark, d))):
        m = fitted.metrics
        rows.append((name, m["n"], m["accuracy"], m["precision"], m["recall"], m["f1_score"], m["expected_calibration_error"], m["brier_score"], fitted.threshold))
    return spark.createDataFrame(
        rows, "feature_choice string, test_rows long, accuracy double, precision double, recall double, f1_score double, "
        "expected_calibration_error double, brier_score double, decision_threshold double")


@cache
def _blind(spark, d):
    return training.fit(_table(spark, d), [f for f in schema.CLASSIFIER_FIELDS if f != "energy_above_hull"])


@check("fit_boosting")
def fit_boosting(spark, d):
    m = training.fit(_table(spark, d), features.feature_set(_table(spark, d), False), kind="gradient_boosting", maxIter=20).metrics
    return spark.createDataFrame([(m["n"], m["accuracy"], m["f1_score"])], "test_rows long, accuracy double, f1_score double")


@check("cross_validate")
def cross_validate(spark, d):
    result = training.cross_validate(_table(spark, d), schema.CLASSIFIER_FIELDS, 5)
    spread = training.fold_spread(result["cv_mean"], result["cv_std"])
    return spark.createDataFrame([(result["cv_mean"], result["cv_std"], spread["coefficient_of_variation"], spread["stability"])],
                                 "cv_mean double, cv_std double, coefficient_of_variation double, stability string")


@check("calibrate")
def calibrate(spark, d):
    """Calibrated probability of every material under both calibrations."""
    table = full(spark, d)
    fitted = _fitted(spark, d)
    platt = training.recalibrate(fitted, _table(spark, d), "platt")
    # one pass through the forest serves both
    table = materialize(training.raw_scores(table, fitted).select("material_id", "_raw"))
    one = training.score_batch(table, fitted, with_distance=False, passed=True).select("material_id", F.col("synthesizability_probability").alias("isotonic"))
    two = training.score_batch(table, platt, with_distance=False, passed=True).select("material_id", F.col("synthesizability_probability").alias("platt"))
    return one.join(two, "material_id")


@check("score_batch")
def score_batch(spark, d):
    """A saved and reloaded model scores every material."""
    path = run_folder(spark, "model")
    _fitted(spark, d).save(path)
    out = training.score_batch(full(spark, d).drop("synthesizability_probability", "in_distribution"), training.ScreeningModel.load(spark, path))
    return out.select("material_id", "synthesizability_prediction", "synthesizability_probability", "synthesizability_confidence",
                      "calibration_status", "nn_distance", "in_distribution")


@check("mode_comparison")
def mode_comparison(spark, d):
    return training.compare_modes(_table(spark, d))


def _components_sql(k: int) -> str:
    """Covariances of the standard-scaled columns (c_0), and for each component its direction v, its variance l and what is left of the
    covariances. A matrix squared forty times over is, but for its scale, the product of its main direction with itself."""
    columns = schema.CLASSIFIER_FIELDS
    n = range(1, len(columns) + 1)
    scaled = ", ".join(f"coalesce(CAST((({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) AS DOUBLE), 0)" for c in columns)
    steps = [f"z AS MATERIALIZED (SELECT material_id, [{scaled}] AS x FROM materials)",
             "c_0 AS MATERIALIZED (SELECT [" + ", ".join("[" + ", ".join(f"avg(x[{a}] * x[{b}])" for b in n) + "]" for a in n) + "] AS c FROM z)"]
    trace = lambda m: " + ".join(f"{m}[{a}][{a}]" for a in n)
    for i in range(k):
        squared = "list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q)))"
        steps += [
            f"s_{i} AS (SELECT 0 AS i, c AS m FROM c_{i} UNION ALL SELECT i + 1, list_transform(m, lambda r: list_transform(r, lambda x: x / ({trace('m')}))) FROM (SELECT i, {squared} AS m FROM s_{i} WHERE i < 40))",
            f"d_{i} AS (SELECT m, list_position(d, list_max(d)) AS p FROM (SELECT m, [{', '.join(f'm[{a}][{a}]' for a in n)}] AS d FROM s_{i} WHERE i = 40))",
            f"v_{i} AS MATERIALIZED (SELECT list_transform(m[p], lambda x: x / sqrt(m[p][p])) AS w FROM d_{i})",
            f"u_{i} AS MATERIALIZED (SELECT list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM v_{i})",
            f"l_{i} AS MATERIALIZED (SELECT v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS l FROM u_{i}, c_{i})",
            f"c_{i + 1} AS MATERIALIZED (SELECT [{', '.join('[' + ', '.join(f'c[{a}][{b}] - l * v[{a}] * v[{b}]' for b in n) + ']' for a in n)}] AS c FROM c_{i}, l_{i})",
        ]
    return ", ".join(steps)


def _with_components(sql: str, k: int) -> str:
    """A whole text of its own: the steps refer to each other."""
    from alloyscreen.checks.core import CTES

    return f"WITH RECURSIVE materials AS ({CTES['materials']}), {_components_sql(k)} {sql}"


@check("pca")
def pca(spark, d):
    return rounded(training.with_pca(raw(spark, d), schema.CLASSIFIER_FIELDS).select("material_id", "pca_1", "pca_2"), 6)


ORACLES["pca"] = _with_components(f"SELECT material_id, {r('list_dot_product(x, l_0.v)', 'pca_1', 6)}, {r('list_dot_product(x, l_1.v)', 'pca_2', 6)} FROM z, l_0, l_1", 2)


@check("pca_reconstruction")
def pca_reconstruction(spark, d):
    return rounded(training.pca_reconstruction(raw(spark, d), schema.CLASSIFIER_FIELDS, 5), 7)


_KEPT = " + ".join(f"l_{i}.l" for i in range(5))
_WHOLE = " + ".join(f"c[{a}][{a}]" for a in range(1, len(schema.CLASSIFIER_FIELDS) + 1))
ORACLES["pca_reconstruction"] = _with_components(
    f"SELECT {r(f'({_WHOLE} - ({_KEPT})) / {len(schema.CLASSIFIER_FIELDS)}', 'reconstruction_mse', 7)}, {r(f'({_KEPT}) / ({_WHOLE})', 'explained_variance', 7)} FROM c_0, " + ", ".join(f"l_{i}" for i in range(5)), 5)


@check("kmeans_select")
def kmeans_select(spark, d):
    return training.with_best_clusters(raw(spark, d), schema.CLASSIFIER_FIELDS).select("material_id", "cluster", "pca_1", "pca_2", "cluster_count")


@check("property_regressors")
def property_regressors(spark, d):
    columns = ["composition_1", "composition_2", "density", "electronegativity", "atomic_radius", "energy_above_hull"]
    return training.property_regressors(raw(spark, d), columns, ["density", "electronegativity", "atomic_radius", "energy_above_hull"])


GRID = """WITH known AS (SELECT DISTINCT e.* FROM alloy_elements e JOIN (SELECT element_1 AS s FROM materials UNION SELECT element_2 FROM materials UNION SELECT element_3 FROM materials) o ON o.s = e.symbol),
    grid AS (SELECT 'binary' AS alloy_type, a.symbol AS element_1, b.symbol AS element_2, CAST(NULL AS VARCHAR) AS element_3, p / 100 AS composition_1, (100 - p) / 100 AS composition_2, CAST(0 AS DOUBLE) AS composition_3,
        p / 100 * a.density + (100 - p) / 100 * b.density AS density, p / 100 * a.melting_point + (100 - p) / 100 * b.melting_point AS melting_point, abs(a.electronegativity - b.electronegativity) AS electronegativity_difference
      FROM known a JOIN known b ON a.symbol < b.symbol CROSS JOIN (SELECT unnest(generate_series(5, 95, 5)) AS p)
      UNION ALL SELECT 'ternary', a.symbol, b.symbol, c.symbol, p / 100, q / 100, (100 - p - q) / 100, p / 100 * a.density + q / 100 * b.density + (100 - p - q) / 100 * c.density,
        p / 100 * a.melting_point + q / 100 * b.melting_point + (100 - p - q) / 100 * c.melting_point, 0
      FROM known a JOIN known b ON a.symbol < b.symbol JOIN known c ON b.symbol < c.symbol CROSS JOIN (SELECT unnest(generate_series(5, 90, 5)) AS p) CROSS JOIN (SELECT unnest(generate_series(5, 90, 5)) AS q) WHERE p + q <= 95)"""


@check("candidate_grid", f"""SELECT * FROM ({GRID} SELECT alloy_type, element_1, element_2, element_3, concat(element_1, format('{{:.3f}}', composition_1), element_2, format('{{:.3f}}', composition_2),
    CASE WHEN element_3 IS NOT NULL THEN concat(element_3, format('{{:.3f}}', composition_3)) ELSE '' END) AS formula, {r('density', 'density', 7)}, {r('melting_point', 'melting_point', 6)},
    {r('electronegativity_difference', 'electronegativity_difference', 8)} FROM grid WHERE density BETWEEN 4 AND 8.123456)""")
def candidate_grid(spark, d):
    out = candidates.candidate_grid(raw(spark, d), 5, {"density": (4.0, 8.123456)})
    return out.select("alloy_type", "element_1", "element_2", "element_3", "formula", F.round("density", 7).alias("density"),
                      F.round("melting_point", 6).alias("melting_point"), F.round("electronegativity_difference", 8).alias("electronegativity_difference"))


@check("alloy_features")
def alloy_features(spark, d):
    out, names = features.alloy_features(aggregates.rule_of_mixtures(raw(spark, d)))
    return out.select("material_id", *names)
