"""Quantiles and gaps by narrowing, bootstrap draws and isotonic fits against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alloyscreen.operators import aggregates, bootstrap, cleaning, isotonic, narrowing, ordered


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(4)
    wide = rng.lognormal(0, 3, 3000)
    hot = np.where(rng.random(3000) < 0.4, 7.5, rng.normal(size=3000))
    whole = rng.integers(0, 9, 3000).astype(float)
    return wide, hot, whole


@pytest.fixture(scope="module")
def table(spark, numbers):
    rows = [tuple(map(float, r)) + (None, 1.0 if i % 2 else float("nan")) for i, r in enumerate(zip(*numbers))]
    return spark.createDataFrame([*rows, (None, None, None, None, None)], "wide double, hot double, whole double, nothing double, nan double").repartition(5)


@pytest.mark.parametrize("few, accuracy", [(20_000, 10_000), (30, 50), (2, 20)])
def test_quantiles_by_narrowing(table, numbers, monkeypatch, few, accuracy):
    monkeypatch.setattr(narrowing, "FEW", few)
    monkeypatch.setattr(narrowing, "ACCURACY", accuracy)
    shares = [0.0, 0.01, 0.25, 0.5, 0.7531, 0.95, 1.0]
    got = narrowing.quantile_values(table, ["wide", "hot", "whole", "nothing", "nan"], shares)
    assert "nothing" not in got and set(got["nan"].values()) == {1.0}
    for name, values in zip(("wide", "hot", "whole"), numbers):
        assert [got[name][p] for p in shares] == pytest.approx(np.quantile(values, shares).tolist())


def test_quantiles_survive_a_sketch_that_is_off(table, numbers, monkeypatch):
    monkeypatch.setattr(narrowing.F, "percentile_approx", lambda x, shares, accuracy, real=F.percentile_approx: real(x, [min(1.0, s + 0.3) for s in shares], accuracy))
    got = narrowing.quantile_values(table, ["wide", "hot"], [0.1, 0.5])
    assert [got["wide"][p] for p in (0.1, 0.5)] == pytest.approx(np.quantile(numbers[0], [0.1, 0.5]).tolist())


def test_medians_and_description_need_two_passes(spark, table, numbers):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles", "two passes")
    ordered.quantiles(table, ["wide", "hot", "whole"], [0.25, 0.5])
    spark.sparkContext.setJobGroup("other", "")
    # with adaptive execution a pass is three jobs: the table's own repartition, the partial counts, and the single row made of them
    assert len(tracker.getJobIdsForGroup("quantiles")) <= 6
    assert cleaning.medians(table, ["wide", "nothing"]) == {"wide": pytest.approx(float(np.median(numbers[0])))}
    told = {r["field"]: r for r in aggregates.describe(table, ["wide", "hot"]).collect()}
    assert told["hot"]["q50"] == pytest.approx(float(np.median(numbers[1]))) and told["wide"]["count"] == 3000


def brute_gap(a, b):
    values = np.unique(np.concatenate((a, b)))
    return np.abs(np.searchsorted(np.sort(a), values, "right") / len(a) - np.searchsorted(np.sort(b), values, "right") / len(b)).max()


@pytest.mark.parametrize("few", [20_000, 5])
def test_gaps_by_narrowing(spark, numbers, monkeypatch, few):
    monkeypatch.setattr(narrowing, "FEW", few)
    rng = np.random.default_rng(8)
    seconds = rng.lognormal(0.1, 3, 1000), np.where(rng.random(1000) < 0.3, 7.5, rng.normal(size=1000)), rng.integers(0, 7, 1000).astype(float)
    frame = lambda vs: spark.createDataFrame([tuple(map(float, r)) for r in zip(*vs)], "wide double, hot double, whole double")
    got = narrowing.greatest_gaps(frame(numbers), frame(seconds), ["wide", "hot", "whole"])
    for name, a, b in zip(("wide", "hot", "whole"), numbers, seconds):
        assert got[name] == (pytest.approx(brute_gap(a, b)), 3000, 1000)


def test_gaps_of_constant_and_one_sided_fields(spark):
    a = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None)], "same double, apart double, empty double")
    b = spark.createDataFrame([(1.0, 9.0, 1.0)], "same double, apart double, empty double")
    assert narrowing.greatest_gaps(a, b, ["same", "apart", "empty"]) == {"same": (0.0, 2, 1), "apart": (1.0, 2, 1)}


def test_poisson_draws(spark):
    rates = spark.createDataFrame([(n, f"{n}|{i}") for n in (0, 1, 3, 16, 40, 1000) for i in range(3000)], "n long, key string")
    drawn = rates.withColumn("k", bootstrap.poisson_draw(F.col("n"), F.md5("key"))).groupBy("n").agg(F.avg("k").alias("mean"), F.variance("k").alias("var"), F.min("k").alias("least"))
    for r in drawn.collect():
        assert r["least"] >= 0 and r["mean"] == pytest.approx(r["n"], abs=4 * math.sqrt(r["n"] / 3000) + 1e-9) and r["var"] == pytest.approx(r["n"], rel=0.12, abs=1e-9)


def test_bootstrap_runs_without_python(spark):
    frame = spark.createDataFrame([(float(i % 7),) for i in range(50)], "v double")
    reps = bootstrap.ks_replicates(frame, frame, ["v"], 5)
    assert "Python" not in plan_of(reps) and reps.count() == 5
    found = bootstrap.ks_bootstrap(frame, frame.unionByName(frame), ["v"], 30)
    again = bootstrap.ks_bootstrap(frame.repartition(7), frame.unionByName(frame).repartition(3), ["v"], 30)
    assert found.collect() == again.collect()


def test_overall_assessment(spark):
    make = lambda *rows: spark.createDataFrame(rows, "p_stability double, distribution_similarity string")
    grade = lambda *rows: bootstrap.overall_assessment(make(*rows)).first()["robustness"]
    assert grade((0.9, "good"), (0.9, "good"), (0.9, "good")) == "high"
    assert grade((0.9, "good"), (0.9, "good"), (0.9, "poor")) == "moderate"
    assert grade((0.5, "good"), (0.6, "good"), (0.6, "good")) == "low" and grade((0.9, "good"),) == "low"


def brute_isotonic(pairs):
    """Greatest of least means over all runs."""
    scores = sorted({s for s, _ in pairs})
    n = [sum(1 for s, _ in pairs if s == x) for x in scores]
    t = [sum(y for s, y in pairs if s == x) for x in scores]
    mean = lambda j, k: sum(t[j : k + 1]) / sum(n[j : k + 1])
    return {x: max(min(mean(j, k) for k in range(i, len(scores))) for j in range(i + 1)) for i, x in enumerate(scores)}


CASES = {
    "noisy": lambda p: [(round(p.random(), 2), int(p.random() < 0.5)) for _ in range(400)],
    "falling": lambda p: [(i / 50, int(i < 25)) for i in range(50)],
    "rising": lambda p: [(i / 50, int(i >= 25)) for i in range(50)],
    "zigzag": lambda p: [(i / 60, (i // 7) % 2) for i in range(60)],
    "constant score": lambda p: [(0.3, i % 3 == 0) for i in range(30)],
    "ties": lambda p: [(p.choice([0.1, 0.5, 0.9]), p.randint(0, 1)) for _ in range(90)],
    "one row": lambda p: [(0.7, 1)],
}


@pytest.mark.parametrize("name", CASES)
def test_isotonic_equals_the_greatest_of_least_means(spark, name):
    pairs = [(float(s), int(y)) for s, y in CASES[name](random.Random(2))]
    df = spark.createDataFrame([*pairs, (None, 1), (0.5, None), (float("nan"), 1)], "score double, label int")
    blocks = isotonic.fit_isotonic(df, slices=6)
    want = brute_isotonic(pairs)
    asked = spark.createDataFrame([(s,) for s in want] + [(None,)], "score double")
    for held in (isotonic.HELD_BLOCKS, 0):
        got = {r.score: r.v for r in isotonic.calibrated(asked, blocks, "score", "v", held).collect()}
        assert got == {**{s: pytest.approx(v) for s, v in want.items()}, None: None}
    rows = blocks.orderBy("low").collect()
    assert [r.value for r in rows] == sorted(r.value for r in rows) and sum(r.n for r in rows) == len(pairs)


@pytest.mark.parametrize("held", [isotonic.HELD_BLOCKS, 0])
def test_isotonic_between_and_beyond_the_blocks(spark, held):
    blocks = isotonic.fit_isotonic(spark.createDataFrame([(0.2, 0), (0.4, 0), (0.6, 1)], "score double, label int"), slices=3)
    asked = spark.createDataFrame([(0.0,), (0.3,), (0.45,), (0.5,), (0.5,), (0.9,)], "score double")
    got = sorted((r.score, r.v) for r in isotonic.calibrated(asked, blocks, "score", "v", held).collect())
    assert got == [(s, pytest.approx(v)) for s, v in [(0.0, 0), (0.3, 0), (0.45, 0.25), (0.5, 0.5), (0.5, 0.5), (0.9, 1)]]


def test_isotonic_with_weights_and_without_rows(spark):
    df = spark.createDataFrame([(0.1, 1.0, 3.0), (0.2, 0.0, 1.0), (0.3, 1.0, 0.0)], "score double, label double, w double")
    assert [(r.n, r.value) for r in isotonic.fit_isotonic(df, weight="w").collect()] == [(4.0, 0.75)]
    none = isotonic.fit_isotonic(df.limit(0))
    assert none.count() == 0
    for held in (isotonic.HELD_BLOCKS, 0):
        assert {r.v for r in isotonic.calibrated(df, none, "score", "v", held).collect()} == {None}
