import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alloyscreen.operators import aggregates, bootstrap, metrics, novelty, ordered, ranking, sampling


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    # A third of all rows share one value.
    return [(f"m{i}", 0.5 if i % 3 == 0 else round(rng.random(), 2)) for i in range(900)]


def test_average_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0)], "material_id string, s double")
    assert {r["material_id"]: r["rank"] for r in ordered.with_average_rank(df, "s", "rank").collect()} == {"a": 4, "b": 2, "c": 2, "d": 1}


def test_average_rank_with_a_hot_value(spark, values):
    df = spark.createDataFrame(values, "material_id string, s double")
    got = {r["material_id"]: r["rank"] for r in ordered.with_average_rank(df, "s", "rank").collect()}
    frame = pd.DataFrame(values, columns=["id", "s"])
    assert got == dict(zip(frame["id"], frame["s"].rank(ascending=False).astype(int)))


def test_row_rank(spark, values):
    df = spark.createDataFrame(values, "material_id string, s double")
    got = [r["material_id"] for r in ordered.with_row_rank(df, [(F.col("s"), True), (F.col("material_id"), False)], "place").orderBy("place").collect()]
    assert got == [i for i, _ in sorted(values, key=lambda v: (-v[1], v[0]))]


def test_row_rank_of_nulls_and_equal_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, 2.0), ("b", None), (None, None), ("a", 1.0)], "k string, s double")
    got = sorted((r.place, r.s, r.k) for r in ordered.with_row_rank(df, [(F.col("s"), True), (F.col("k"), False)], "place").collect())
    assert got == [(1, 2.0, None), (2, 1.0, "a"), (3, 1.0, "a"), (4, 1.0, "a"), (5, None, None), (6, None, "b")]


def test_row_rank_writes_only_the_order(spark, values, monkeypatch):
    kept = []
    monkeypatch.setattr(ordered, "materialize", lambda df: kept.append(df.columns) or df.checkpoint())
    wide = spark.createDataFrame(values, "material_id string, s double").withColumn("payload", F.repeat(F.lit("x"), 50))
    ranked = ordered.with_row_rank(wide, [(F.col("s"), True), (F.col("material_id"), False)], "place")
    assert ranked.count() == len(values) and ranked.columns == ["material_id", "s", "payload", "place"]
    assert kept == [["_order_0", "_order_1", "_position"]]


def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for _, v in values] + [(None,)], "s double")
    row = ordered.quantiles(df, ["s"], [0.0, 0.25, 0.5, 0.95, 1.0]).first()
    assert list(row)[1:] == pytest.approx(np.percentile([v for _, v in values], [0, 25, 50, 95, 100]))


def test_ks_statistic(spark):
    a, b = [0.1, 0.2, 0.3, 0.4], [0.3, 0.4, 0.5, 0.6]
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "v double")
    row = ordered.ks_statistics(frame(a), frame(b), ["v"]).first()
    assert row["ks_stat"] == pytest.approx(0.5)
    assert ordered.ks_statistics(frame(a), frame(a), ["v"]).first()["p_value"] == 1.0


def test_bootstrap_tells_equal_from_shifted(spark):
    rng = np.random.default_rng(1)
    base, same, far = rng.normal(0, 1, 400), rng.normal(0, 1, 400), rng.normal(2, 1, 400)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    good = bootstrap.ks_bootstrap(frame(base), frame(same), ["v"], 40).first()
    poor = bootstrap.ks_bootstrap(frame(base), frame(far), ["v"], 40).first()
    assert good["ci_low"] <= good["mean_p_value"] <= good["ci_high"] and good["p_stability"] <= 1
    assert poor["distribution_similarity"] == "poor"
    assert bootstrap.ks_bootstrap(frame(base), frame(same), ["v"], 40).first() == good


def test_nearest_distances_by_brute_force():
    rng = np.random.default_rng(0)
    points, train = rng.normal(size=(30, 3)), rng.normal(size=(50, 3))
    full = np.sort(np.linalg.norm(points[:, None] - train[None], axis=2), axis=1)[:, :5]
    assert np.allclose(novelty.nearest_distances(points, train, 5), full)


@pytest.mark.parametrize("limit", [1000, 7])
def test_novelty_by_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    train = [(f"t{i}", *map(float, rng.normal(size=2))) for i in range(60)] + [(f"c{i}", 1.0, 1.0) for i in range(30)]
    asked = [(f"q{i}", *map(float, rng.normal(size=2) * 2)) for i in range(40)] + [("null", None, 1.0)]
    shape = "material_id string, a double, b double"
    out = novelty.with_novelty(spark.createDataFrame(asked, shape), spark.createDataFrame(train, shape), ["a", "b"], limit=limit)
    got = {r["material_id"]: (r["nn_distance"], r["in_distribution"]) for r in out.collect()}
    x = np.array([r[1:] for r in train])
    x = (x - x.mean(0)) / x.std(0)
    raw = np.array([r[1:] for r in train])
    q = (np.array([r[1:] for r in asked[:-1]]) - raw.mean(0)) / raw.std(0)
    near = lambda p: np.sort(np.linalg.norm(p[:, None] - x[None], axis=2), axis=1)[:, :5].mean(1)
    cut = np.percentile(near(x), 95)
    assert len(got) == 41 and got["null"] == (None, "out-dist")
    for (name, *_), d in zip(asked, near(q)):
        assert got[name][0] == pytest.approx(d) and got[name][1] == ("in-dist" if d <= cut else "out-dist")


def test_priority_prefers_low_hull_and_needs_no_probability(spark):
    df = spark.createDataFrame([("a", 0.01, 4), ("b", 0.2, 4), ("c", 0.9, 4)], "material_id string, energy_above_hull double, nsites int")
    ranks = {r["material_id"]: r["synthesis_priority_rank"] for r in ranking.priority_rank(df).collect()}
    assert ranks["a"] < ranks["c"]


def test_top_per_group(spark):
    df = spark.createDataFrame([("k" if i % 4 else "j", i) for i in range(100)], "k string, n int").repartition(5)
    got = sorted(ranking.top_per_group(df, ["k"], [F.col("n")], 2).collect())
    assert got == [("j", 0), ("j", 4), ("k", 1), ("k", 2)]


def test_split_is_stratified_and_stable(spark):
    df = spark.createDataFrame([(f"m{i}", i % 3 == 0) for i in range(3000)], "material_id string, y boolean")
    marked = sampling.stratified_split(df, "y").groupBy("y").agg(F.avg(F.col("is_test").cast("int")).alias("share")).collect()
    assert all(0.19 < r["share"] <= 0.2 for r in marked)
    first = {r[0] for r in sampling.stratified_split(df, "y").filter("is_test").select("material_id").collect()}
    again = {r[0] for r in sampling.stratified_split(df.repartition(7), "y").filter("is_test").select("material_id").collect()}
    assert first == again


def test_rebalance_and_weights(spark):
    df = spark.createDataFrame([(f"m{i}", int(i < 400)) for i in range(1400)], "material_id string, y int")
    counts = sampling.class_counts(sampling.rebalance(df, "y"), "y")
    assert counts[0] == 1000 and abs(counts[1] - 1000) < 60
    weights = sampling.with_class_weight(df, "y").groupBy("y").agg(F.sum("class_weight").alias("w")).collect()
    assert weights[0]["w"] == pytest.approx(weights[1]["w"])


@pytest.mark.parametrize("p, expected", [(0.0, None), (0.05, 0), (0.1, 0), (0.3, 2), (0.30000000000000004, 2), (0.31, 3), (1.0, 9), (1.1, None)])
def test_right_closed_bins(spark, p, expected):
    assert spark.range(1).select(metrics.right_closed_bin(F.lit(p)).alias("b")).first()["b"] == expected


def test_metrics_of_an_empty_log(spark):
    from alloyscreen import schema

    empty = spark.createDataFrame([], schema.OUTCOME_SCHEMA)
    assert tuple(metrics.validation_metrics(empty).first()) == (0, 0.0, 0.0, 0.0)
    assert metrics.outcome_calibration(empty).first()["calibration_error"] == 0.0


def test_threshold(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.1)]
    best = metrics.best_threshold(spark.createDataFrame(rows, "label int, probability double")).first()
    assert best["decision_threshold"] == 0.6
    low = metrics.best_threshold(spark.createDataFrame([(1, 0.05), (0, 0.01)], "label int, probability double")).first()
    assert (low["raw_threshold"], low["decision_threshold"]) == (0.05, 0.2)


def test_calibration_grade_and_weights(spark):
    df = spark.createDataFrame([(0.01,), (0.07,), (0.2,), (None,)], "expected_calibration_error double")
    assert [r["calibration_status"] for r in metrics.with_calibration_grade(df).collect()] == [
        "well_calibrated", "moderately_calibrated", "poorly_calibrated", "not_calibrated"]
    assert [r["ml_weight"] for r in metrics.with_ensemble_weights(df).collect()] == pytest.approx([0.7, 0.7, 0.4, 0.7])


def test_tertiary_coverage(spark):
    make = lambda n, k: spark.createDataFrame([(0.2 if i < k else 0.0,) for i in range(n)], "composition_3 double")
    assert tuple(aggregates.tertiary_coverage(make(60, 60)).first()) == (60, 60, 1.0, True)
    assert aggregates.tertiary_coverage(make(60, 3)).first()["recommended"] is False
    assert tuple(aggregates.tertiary_coverage(make(3, 0).limit(0)).first()) == (0, 0, 0.0, False)
    assert aggregates.tertiary_coverage(spark.range(5)).first()["tertiary_rows"] == 0


def test_mixtures(spark):
    shape = "element_1 string, element_2 string, element_3 string, composition_1 double, composition_2 double, composition_3 double"
    rows = [("Al", "Cu", None, 0.5, 0.5, 0.0), ("Al", "Cu", "Ni", 0.4, 0.3, 0.3), ("Pb", "Al", None, 0.5, 0.5, 0.0)]
    two, three, unknown = aggregates.rule_of_mixtures(spark.createDataFrame(rows, shape)).collect()
    assert two["electronegativity_difference"] == pytest.approx(0.29) and three["electronegativity_difference"] == 0
    assert two["density"] == pytest.approx((2.70 + 8.92) / 2) and unknown["density"] == pytest.approx(2.70)


def test_histogram_keeps_the_greatest_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert [r["n"] for r in aggregates.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert aggregates.histogram(flat, "v", 5).first()["n"] == 2


def test_shortlist_falls_back_to_override_rows(spark):
    shape = "material_id string, safety_rating double, composite_priority_score double, ensemble_confidence double, safety_check_passed boolean, requires_human_override boolean"
    rows = [("a", 0.5, 0.9, 0.9, False, True), ("b", 0.0, 0.8, 0.9, False, False)]
    assert [r[0] for r in ranking.shortlist(spark.createDataFrame(rows, shape)).collect()] == ["a"]
    rows.append(("c", 1.0, 0.1, 0.1, True, False))
    assert [r[0] for r in ranking.shortlist(spark.createDataFrame(rows, shape)).collect()] == ["c"]
