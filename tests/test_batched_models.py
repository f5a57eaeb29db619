"""Model fits that share their passes over the data, against Spark's own."""

import threading

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor

from alloyscreen.checks import core, model_checks
from alloyscreen.operators import features
from alloyscreen.plans import training


def test_rounds_of_many_fits_end_where_kmeans_ends(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(900, 2)) + rng.integers(0, 4, (900, 1)) * [3.0, -1.0]
    points = spark.createDataFrame(rows.tolist(), "a double, b double").repartition(2).cache()
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(points)
    asked = [(k, seed) for k in (2, 4) for seed in (1, 2)]
    first = [np.array(KMeans(k=k, seed=seed, maxIter=0).fit(data).clusterCenters()) for k, seed in asked]
    for (k, seed), (centres, cost) in zip(asked, training._lloyd(points, ["a", "b"], first), strict=True):
        own = KMeans(k=k, seed=seed).fit(data)
        assert np.allclose(centres, np.array(own.clusterCenters()), atol=1e-9)
        assert cost == pytest.approx(own.summary.trainingCost)
        near = own.transform(data).withColumn("near", training._nearest(["a", "b"], centres))
        assert near.where("near <> prediction").count() == 0


def test_an_empty_cluster_keeps_its_centre(spark):
    points = spark.createDataFrame([(0.0,), (1.0,)], "a double")
    (centres, cost), = training._lloyd(points, ["a"], [np.array([[0.5], [9.0]])])
    assert centres.tolist() == [[0.5], [9.0]] and cost == pytest.approx(0.5)


def test_blocks_hold_all_points_near_each_other(spark, monkeypatch):
    """Every point is in one block; the blocks of a stretch cover little of it, so that most count as a whole."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(4000, 2)) * [1.0, 50.0]
    monkeypatch.setattr(training, "STRETCH", 1500)
    found = training._blocks(spark.createDataFrame(rows.tolist(), "a double, b double").coalesce(1), ["a", "b"]).collect()
    points = np.concatenate([np.array([np.frombuffer(r["held0"]), np.frombuffer(r["held1"])]).T for r in found])
    assert sorted(map(tuple, points)) == sorted(map(tuple, rows))
    for r in found:
        for m in (0, 1):
            held = np.frombuffer(r[f"held{m}"])
            assert len(held) == r["n"] <= 2 * training.BLOCK
            assert r[f"low{m}"] == held.min() and r[f"high{m}"] == held.max() and r[f"sum{m}"] == pytest.approx(held.sum(), abs=1e-9)
        assert r["apart"] == pytest.approx(sum(((h := np.frombuffer(r[f"held{m}"])) - h.mean()) ** 2 for m in (0, 1)).sum())
    areas = [(r["high0"] - r["low0"]) * (r["high1"] - r["low1"]) for r in found]
    assert np.median(areas) < 0.05 * np.prod(rows.max(axis=0) - rows.min(axis=0))


@pytest.mark.parametrize("columns", [["a"], ["a", "b"]])
def test_rounds_over_blocks_equal_rounds_over_points(spark, columns):
    """Also with few points, equal points and points on the border of two clusters."""
    rng = np.random.default_rng(6)
    for rows in (rng.integers(-3, 4, (3000, 2)) * 1.0, rng.normal(size=(2500, 2)) * 1e6, rng.normal(size=(5, 2)), np.ones((70, 2))):
        x = rows[:, : len(columns)]
        first = [x[:k] + np.arange(k)[:, None] * 1e-3 for k in (1, 2, 4)] + [np.array([[-1.0], [1.0]]) * np.ones(len(columns))]
        points = spark.createDataFrame(rows.tolist(), "a double, b double").repartition(2)
        for start, (centres, cost) in zip(first, training._lloyd(points, columns, first, rounds=4), strict=True):
            c = start.copy()
            for _ in range(4):
                apart = ((x[:, None, :] - c) ** 2).sum(axis=2)
                near = apart.argmin(axis=1)
                moved = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
                done, c = (((moved - c) ** 2).sum(axis=1) <= 1e-8).all(), moved
                if done:
                    break
            assert np.allclose(centres, c, rtol=1e-9, atol=1e-9) and cost == pytest.approx(apart.min(axis=1).sum(), rel=1e-9, abs=1e-9)


def test_property_forests_share_the_time(spark, monkeypatch):
    """Each forest waits for another one to begin; they come to what a forest alone comes to."""
    meet = threading.Barrier(2, timeout=60)

    class Forest(RandomForestRegressor):
        def fit(self, data):
            meet.wait()
            return super().fit(data)

    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 3))
    rows[:, 2] += rows[:, 0]
    df = spark.createDataFrame(rows.tolist(), "a double, b double, c double").coalesce(1)
    monkeypatch.setattr(training, "RandomForestRegressor", Forest)
    found = {r["target"]: r["mse"] for r in training.property_regressors(df, ["a", "b", "c"], ["a", "c"], trees=4).collect()}
    data = features.scale(df, ["a", "b", "c"], features.fit_scaler(df, ["a", "b", "c"]))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)
    alone = RandomForestRegressor(featuresCol="features", labelCol="c", numTrees=4, maxDepth=10, seed=42).fit(data).transform(data)
    assert found["c"] == pytest.approx(alone.selectExpr("avg((prediction - c) * (prediction - c))").first()[0])
    assert found["all columns"] == pytest.approx((found["a"] + found["c"]) / 3)


def test_calibrate_passes_the_forest_once(spark, sf_dir, monkeypatch):
    table = model_checks._table(spark, sf_dir)
    fitted = training.fit(table, features.feature_set(table, False), numTrees=5, maxDepth=4)
    passes, own = [], training._raw_probability
    monkeypatch.setattr(model_checks, "_fitted", lambda spark, d: fitted)
    monkeypatch.setattr(training, "_raw_probability", lambda model, df: passes.append(df) or own(model, df))
    out = model_checks.calibrate(spark, sf_dir).cache()
    assert len(passes) == 2  # the labelled rows for the second calibration, the materials
    alone = training.score_batch(core.full(spark, sf_dir), fitted, with_distance=False).select("material_id", "synthesizability_probability")
    both = out.join(alone, "material_id")
    assert both.count() == out.count() == 6000 and both.where("isotonic <> synthesizability_probability").count() == 0
