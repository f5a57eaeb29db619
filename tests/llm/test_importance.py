"""Importance resampling against sums over each text by itself, on nulls, empty and long texts, repeated rows and clashing names."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from alloyscreen.llm import importance

SCHEMA = "doc_id long, text string, noise double, n_features long, log_weight double, bucket long, raw long, good boolean"
LABELS = "doc_id long, quality int, toxic int, text string"
GOOD, BAD = "calm river stone bridge light", "buy cheap now click offer"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 9.0, 9, 9.0, 9, 9, True) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def case():
    pick = np.random.default_rng(3)
    text = lambda words, n: " ".join(pick.choice(words.split(), n))
    rows = [(i, text(GOOD if i % 2 else BAD, int(pick.integers(5, 60)))) for i in range(200)]
    rows += [(None, None), (None, GOOD), (500, ""), (501, " \n"), (502, BAD + " x" * 20_000), rows[0], rows[0], (-1, BAD)]
    labels = [(i, int(i % 2), 0, "z") for i in range(0, 100)] + [(7, 0, 0, "z"), (9, 1, 1, "z"), (None, 1, 0, "z"), (11, None, 0, "z"), (888, 1, 0, "z")]
    return rows, labels


def test_ratios_and_weights(spark, case):
    rows, labels = case
    model = importance.fitted(table(spark, rows), spark.createDataFrame(labels, LABELS))
    by_id = collections.defaultdict(list)
    for i, q, toxic, _ in labels:
        if i is not None and q is not None:
            by_id[i].append(q == 1 and not toxic)
    good = {i for i, told in by_id.items() if all(told)}
    assert model.share == len(good) / len(by_id) and 7 not in good and 9 not in good
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, t in rows:
        found, _ = importance.features(pa.array([t], pa.string()))
        np.add.at(raw, found, 1)
        if i in good:
            np.add.at(target, found, 1)
    assert np.allclose(model.ratio, importance.log_ratio(target, raw)) and model.temperature in importance.TEMPERATURES
    got = importance.resampled(table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    mean = lambda t: model.ratio[f].mean() if len(f := importance.features(pa.array([t], pa.string()))[0]) else 0.0
    key = lambda x: (str(x[0]), round(x[1], 9))
    assert sorted(((r.doc_id, r.log_weight) for r in got), key=key) == [(i, pytest.approx(w)) for i, w in sorted(((i, mean(t)) for i, t in rows), key=key)]


def test_the_greatest_keys_are_kept(spark, case):
    rows, labels = case
    for share in (None, 0.0, 0.25, 1.0):
        got = importance.resampled(table(spark, rows), spark.createDataFrame(labels, LABELS), share).collect()
        asked = share if share is not None else importance.fitted(table(spark, rows), spark.createDataFrame(labels, LABELS)).share
        keys = sorted((r.sample_key for r in got), reverse=True)
        n = round(asked * len(keys))
        assert len(got) == len(rows) and all(r.kept == bool(n and r.sample_key >= keys[n - 1]) for r in got)
    kept = importance.resampled(table(spark, rows), spark.createDataFrame(labels, LABELS)).where("doc_id >= 100 AND doc_id < 200").selectExpr("avg(int(kept = (doc_id % 2 = 1)))").first()[0]
    assert kept > 0.85
    twins = importance.resampled(table(spark, rows), spark.createDataFrame(labels, LABELS)).where("doc_id = 0").collect()
    assert len(twins) == 3 and len({(r.sample_key, r.kept) for r in twins}) == 1


def test_without_labels_or_documents(spark, case):
    rows, labels = case
    none = importance.resampled(table(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert all(r.kept and abs(r.log_weight) < 1e-9 for r in none)
    assert importance.resampled(table(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []
    one_kind = importance.resampled(table(spark, rows), spark.createDataFrame([(1, 1, 0, "z")], LABELS)).collect()
    assert len(one_kind) == len(rows)
