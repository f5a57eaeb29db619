from unittest.mock import Mock

import pytest
from pyspark.sql import functions as F

from alloyscreen import refdata, schema
from alloyscreen.checks import core
from alloyscreen.functions import composition
from alloyscreen.operators import aggregates, features, joins, ranking
from alloyscreen.plans import candidates, export, screening, training
from alloyscreen.session import run_folder, shared_folder
from alloyscreen.sources import scans, sinks
from alloyscreen.streaming import streams


@pytest.fixture(scope="module")
def materials(spark, sf_dir):
    return core.full(spark, sf_dir).withColumnRenamed("formula", "formula_pretty")


@pytest.fixture(scope="module")
def table(materials):
    made, raw = features.training_dataset(materials, 1000)
    return features.training_table(made, raw).cache()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _session(named, current, master):
    session = Mock()
    session.conf.get.side_effect = lambda key, default: named
    session.sparkContext.getCheckpointDir.return_value = current
    session.sparkContext.master = master
    return session


def test_shared_folder_is_the_named_one():
    session = _session("/shared/x", None, "yarn")
    assert shared_folder(session) == "/shared/x" and run_folder(session, "y").startswith("/shared/x/y-")
    session.sparkContext.setCheckpointDir.assert_called_with("/shared/x")
    with pytest.raises(RuntimeError):
        shared_folder(_session(None, None, "yarn"))
    assert shared_folder(_session(None, "/already/set", "yarn")) == "/already/set"


def test_scoring_needs_no_shuffle_and_no_python(materials):
    plan = plan_of(screening.screen(materials.withColumnRenamed("formula_pretty", "formula")))
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("BroadcastHashJoin") == 3
    # The only exchange that is not a broadcast spreads the small test file over the cores.
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 1


def test_filters_and_columns_reach_the_scan(spark, materials):
    path = run_folder(spark, "pushed")
    materials.write.parquet(path)
    scan = lambda **v: plan_of(scans.summary_scan(spark.read.parquet(path), **{"nsites_max": None, **v}))
    assert "LessThanOrEqual(energy_above_hull,0.1)" in scan()
    assert "GreaterThanOrEqual(band_gap,0.2)" in scan(energy_above_hull_max=None, band_gap_min=0.2)
    plan = scan(elements=["Al"])
    assert "composition_1" not in plan


def test_top_candidates_use_a_bounded_sort(materials):
    assert "TakeOrderedAndProject" in plan_of(screening.top_candidates(materials))


def test_pair_scan_limits_and_first_pair(spark):
    rows = [(f"m{i:02d}", ["Al", "Ti", "V"], 0.01, 4) for i in range(9)] + [("z", ["Al", "Ti"], 0.3, 4)]
    df = spark.createDataFrame(rows, "material_id string, elements array<string>, energy_above_hull double, nsites int")
    got = scans.pair_scan(df, [("Al", "Ti"), ("Al", "V")], 5).collect()
    assert [r["material_id"] for r in sorted(got)] == [f"m{i:02d}" for i in range(5)] and {r["element_2"] for r in got} == {"Ti"}
    assert "z" in {r["material_id"] for r in scans.training_scan(df, [("Al", "Ti")], 50).collect()}


def test_missing_log_is_an_empty_table(spark, tmp_path):
    log = scans.read_outcomes(spark, str(tmp_path / "none"))
    assert log.count() == 0 and log.schema == schema.OUTCOME_SCHEMA


def test_outcomes_append(spark):
    path = run_folder(spark, "log")
    for name in ("Successful", "Failed"):
        sinks.append_outcomes(spark.createDataFrame([("Al0.5Ti0.5", name)], "formula string, outcome string"), path)
    rows = scans.read_outcomes(spark, path).collect()
    assert len(rows) == 2 and all(r["attempted_date"] is not None for r in rows)


def test_filter_by_outcome(spark):
    m = spark.createDataFrame([("A",), ("B",), (None,)], "formula string")
    o = spark.createDataFrame([("A",), (None,)], "formula string")
    assert joins.filter_by_outcome(m, o, "Has Outcome Logged").count() == 1
    assert joins.filter_by_outcome(m, o, "No Outcome Logged").count() == 2
    assert joins.filter_by_outcome(m, o, "All Materials").count() == 3


def test_csv_round_trip_hardens_cells(spark):
    path = run_folder(spark, "cells")
    df = composition.with_neutral_cells(spark.createDataFrame([('=HYPERLINK("x")', 1.5, None), ('a,"b"', None, "")], "a string, b double, c string"))
    sinks.write_csv(df, path)
    got = {(r["a"], r["b"]) for r in scans.read_csv(spark, path, df.schema).collect()}
    assert got == {("'=HYPERLINK(\"x\")", 1.5), ('a,"b"', None)}


def test_lab_file_without_optional_columns(spark):
    df = spark.createDataFrame([("Al0.5Ti0.5", 0.01)], "formula string, energy_above_hull double")
    row = sinks.lab_projection(df).first()
    assert list(row.asDict()) == sinks.LAB_COLUMNS and row["ID"] == "Al0.5Ti0.5" and row["Priority"] == "N/A"


def test_export_summary_equals_the_file(spark, sf_dir):
    path = run_folder(spark, "lab")
    counts = export.export_for_lab(core.scored(spark, sf_dir), path).first()
    assert counts["exported_materials"] == spark.read.option("header", True).csv(path).count() == counts["safe_materials"]
    assert counts["total_materials"] == 6000


def test_intake_package_has_a_manifest(spark):
    path = run_folder(spark, "intake")
    pool = spark.createDataFrame([("m1", "A", 0.5), ("m2", "=B", 0.7)], "material_id string, formula string, final_priority_score double")
    sinks.write_intake_package(pool, path)
    manifest = spark.read.json(f"{path}/manifest").first()
    assert manifest["candidate_count"] == 2 and manifest["columns"] == sinks.INTAKE_COLUMNS
    assert spark.read.option("header", True).csv(f"{path}/candidates").filter("formula = \"'=B\"").count() == 1


def test_one_hot(spark):
    df = spark.createDataFrame([("Al", "Ti", None, 0.5, 0.5, None)], "element_1 string, element_2 string, element_3 string, composition_1 double, composition_2 double, composition_3 double")
    out, names = features.one_hot_slots(df)
    row = out.first()
    assert names[:3] == ["element_1_Al", "element_1_None", "element_1_Ti"] and row["element_3_None"] == 1 and row["composition_3"] == 0.0


def test_scaling_needs_a_fit(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    with pytest.raises(ValueError):
        features.scale(df, ["x"], None)
    fitted = features.fit_scaler(df, ["x"])
    assert [r[0] for r in features.scale(df, ["x"], fitted).collect()] == [-1.0, 1.0]


def test_solution_rules(spark):
    df = spark.createDataFrame([("Al", "Fe"), ("Ni", "Cu"), ("Al", "Pb")], "element_1 string, element_2 string")
    iron, copper, lead = aggregates.with_solution_rules(df).collect()
    assert iron["structure_violation"] and not iron["composition_valid"] and copper["composition_valid"] and lead["composition_valid"] is None
    counts = aggregates.hume_rothery(df).first()
    assert (counts["total_materials"], counts["valid_compositions"], counts["violating_compositions"]) == (3, 1, 1)


def test_candidate_grid(spark):
    df = spark.createDataFrame([("Al", "Ti", None), ("Ni", "Xx", None)], "element_1 string, element_2 string, element_3 string")
    grid = candidates.candidate_grid(df, 5)
    assert grid.filter("alloy_type = 'binary'").count() == 3 * 19
    assert grid.filter("alloy_type = 'ternary'").count() == 171
    assert grid.filter("abs(composition_1 + composition_2 + composition_3 - 1) > 1e-9").count() == 0
    kept = candidates.candidate_grid(df, 5, {"density": (4.0, 5.0)}, ternary=False)
    assert 0 < kept.count() < 57 and kept.filter("NOT density BETWEEN 4 AND 5").count() == 0


def test_candidate_pool_shapes(spark):
    shape = "material_id string, formula string, ensemble_confidence double, final_priority_score double"
    df = spark.createDataFrame([(f"m{i:02d}", f"F{i}", 0.9 if i < 4 else 0.1, 1 - i / 100) for i in range(30)], shape)
    none = spark.createDataFrame([], "formula string, material_id string, net_benefit double")
    pool = ranking.candidate_pool(df, none)
    assert sorted(r["material_id"] for r in pool.collect()) == [f"m{i:02d}" for i in range(10)]
    benefits = spark.createDataFrame([(f"F{i}", "x", 5.0) for i in range(3)], "formula string, material_id string, net_benefit double")
    assert sorted(r["material_id"] for r in ranking.candidate_pool(df, benefits, minimum=3).collect()) == ["m00", "m01", "m02"]


def test_a_pool_that_is_topped_up_moves_no_more_rows_than_it_has(spark, monkeypatch):
    shape = "material_id string, formula string, ensemble_confidence double, final_priority_score double"
    rows = [(f"m{i:02d}", None if i % 7 == 3 else f"F{i % 9}", 0.9 if i in (2, 3, 20) else 0.1, 1 - i / 100) for i in range(30)]
    df = spark.createDataFrame(rows, shape)
    benefits = spark.createDataFrame([("F2", "a", 1.0), ("F2", "b", -2.0), ("F4", "a", 3.0), (None, "c", 5.0)], "formula string, material_id string, net_benefit double")
    sure = [r for r in rows if r[2] >= 0.6]
    known = {r[1] for r in sure if r[1] is not None}
    want = [(r[0], -2.0 if r[1] == "F2" else None) for r in sure] + [(r[0], None) for r in rows if r[1] is None or r[1] not in known][: 10 - len(sure)]
    moved, join = [], joins.hot_join

    def counted(left, *more):
        moved.append(left.count())
        return join(left, *more)

    def pool():
        return sorted(((r["material_id"], r["estimated_net_benefit"]) for r in ranking.candidate_pool(df, benefits).collect()), key=str)

    monkeypatch.setattr(joins, "hot_join", counted)
    assert pool() == sorted(want, key=str) and max(moved) == len(sure)
    monkeypatch.setattr(joins, "HELD_ROWS", 0)
    assert pool() == sorted(want, key=str)


def test_training_table_has_two_clear_classes(table):
    labels = {r["synthesizable"] for r in table.select("synthesizable").distinct().collect()}
    assert labels == {0, 1} and table.filter("energy_above_hull > 0.025 AND energy_above_hull < 0.1").count() == 0


def test_feature_set(table, spark):
    assert features.feature_set(table, False) == schema.CLASSIFIER_FIELDS
    assert len(features.feature_set(table, True)) == 10
    assert len(features.feature_set(spark.createDataFrame([(0.0,)], "composition_3 double"))) == 7


def test_classifier_from_fit_to_reload(spark, table, materials):
    fitted = training.fit(table, schema.CLASSIFIER_FIELDS, numTrees=20)
    assert fitted.metrics["accuracy"] > 0.9 and 0.2 <= fitted.threshold <= 0.8
    assert fitted.metrics["tp"] + fitted.metrics["fp"] + fitted.metrics["tn"] + fitted.metrics["fn"] == fitted.metrics["n"]
    path = run_folder(spark, "model")
    fitted.save(path)
    again = training.ScreeningModel.load(spark, path)
    one = training.score_batch(materials.drop("in_distribution"), fitted)
    p = F.col("synthesizability_probability")
    assert one.count() == 6000 and one.filter(p.isNull() | (p < 0) | (p > 1)).count() == 0
    two = training.score_batch(materials.drop("in_distribution"), again)
    columns = ["material_id", "synthesizability_prediction", "in_distribution", "calibration_status"]
    assert one.select(columns).exceptAll(two.select(columns)).count() == 0
    platt = training.recalibrate(fitted, table, "platt")
    assert training.score_batch(materials, platt, with_distance=False).filter(p.between(0, 1)).count() == 6000
    with pytest.raises(ValueError):
        training.recalibrate(fitted, table, "other")


def test_a_table_without_a_feature_is_scored_with_the_training_median(spark, table):
    fitted = training.fit(table, schema.CLASSIFIER_FIELDS, numTrees=5)
    out = training.score_batch(spark.createDataFrame([("m", 0.01)], "material_id string, energy_above_hull double"), fitted)
    assert out.count() == 1


def test_one_class_is_an_error(table):
    with pytest.raises(ValueError):
        training.fit(table.filter("synthesizable = 1"), schema.CLASSIFIER_FIELDS, numTrees=2)
    with pytest.raises(ValueError):
        training.classifier("other")


def test_cross_validation(table):
    result = training.cross_validate(table.fillna(0.0), schema.CLASSIFIER_FIELDS, 3, numTrees=5)
    assert 0.8 < result["cv_mean"] <= 1 and result["cv_std"] >= 0
    assert training.fold_spread(1.0, 0.05)["stability"] == "high"


def test_stream_drops_repeated_outcomes(spark):
    root = run_folder(spark, "stream")

    def arrive(ids):
        rows = spark.createDataFrame([(i,) for i in ids], "i long").selectExpr(
            "i AS outcome_id", "timestamp_seconds(1700000000 + i) AS attempted_date", "'Successful' AS outcome", "0.9D AS ml_pred", "0.1D AS llm_pred")
        rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        table_schema = spark.read.parquet(f"{root}/in").schema
        stream = streams.distinct_outcomes(streams.read_stream(spark, f"{root}/in", table_schema))
        streams.append_to(stream, f"{root}/log", f"{root}/progress").awaitTermination()
        return streams.refresh_metrics(spark.read.parquet(f"{root}/log")).first()

    assert arrive([1, 2, 2])["total_experiments"] == 2
    after = arrive([2, 3])
    assert after["total_experiments"] == 3 and after["success_rate"] == 1.0 and after["hit_rate_last_10"] == 1.0


def test_reference_tables(spark):
    assert len(refdata.ATOMIC_WEIGHTS) == 118 and list(refdata.ATOMIC_WEIGHTS)[25] == "Fe"
    assert refdata.alloy_elements(spark).count() == 48 and refdata.equipment_list(spark).count() == 12
    needed = {e for m in refdata.METHODS for e in m[7]}
    assert needed <= {e for items in refdata.EQUIPMENT.values() for e in items}
