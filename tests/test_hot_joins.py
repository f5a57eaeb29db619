"""Joins with hot, null and repeated keys against plain joins."""

import statistics

import pytest
from pyspark.sql import functions as F

from alloyscreen.operators import joins
from alloyscreen.operators.hot_joins import hot_join, hot_keys


def rows(spark, n=4000):
    hot = F.when(F.col("id") % 2 == 0, F.lit("AlTi")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("f"), (F.col("id") % 900).cast("string")))
    return spark.range(n).select(hot.alias("formula"), F.col("id"), F.create_map(F.lit("a"), F.col("id")).alias("m"))


def other(spark):
    return spark.createDataFrame([("AlTi", 1), ("f1", 2), ("f1", 3), (None, 4), ("none", 5), ("f899", 6)], "formula string, v int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [1, 64, 100_000])
def test_equals_the_plain_join(spark, how, hot):
    left, right = rows(spark), other(spark)
    got, want = hot_join(left, right, ["formula"], how, hot), left.join(right, "formula", how)
    assert got.columns == want.columns
    key = lambda r: str(r)
    assert sorted(got.drop("m").collect(), key=key) == sorted(want.drop("m").collect(), key=key)


def test_keys_of_several_columns_and_types(spark):
    left = spark.createDataFrame([(1.5, True, i) for i in range(50)] + [(2.5, None, 50), (None, True, 51), (0.0, False, 52)], "x double, b boolean, i int")
    right = spark.createDataFrame([(1.5, True, "a"), (0.0, False, "b"), (None, True, "c")], "x double, b boolean, name string")
    got = {r.i: r.name for r in hot_join(left, right, ["x", "b"], "left", 4).collect()}
    assert got == {**{i: "a" for i in range(50)}, 50: None, 51: None, 52: "b"}


def test_number_of_hot_keys_is_bounded(spark):
    assert hot_keys(rows(spark), ["formula"], 8).count() <= 8
    found = {r["_hot_0"]: r["_salts"] for r in hot_keys(rows(spark), ["formula"], 8).collect()}
    assert set(found) == {"AlTi"} and found["AlTi"] >= 5
    assert hot_keys(rows(spark, 0), ["formula"], 8).count() == 0


def test_no_task_gets_a_hot_key_alone(spark):
    """Half of all rows have one formula, another part none."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "8", "-1")):
            spark.conf.set(k, v)
        joined = hot_join(rows(spark, 40_000), other(spark), ["formula"], "left").withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * statistics.median(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_joins_by_formula(spark):
    materials, outcomes = rows(spark), other(spark)
    kept = joins.has_outcome(materials, outcomes).count()
    assert kept and kept + joins.no_outcome(materials, outcomes).count() == 4000
    benefits = spark.createDataFrame([("AlTi", "b", 2.0), ("AlTi", "a", 1.0)], "formula string, material_id string, net_benefit double")
    assert {r.estimated_net_benefit for r in joins.map_net_benefit(materials.filter("formula = 'AlTi'"), benefits).collect()} == {2.0}


def test_unknown_kind_of_join(spark):
    with pytest.raises(ValueError):
        hot_join(rows(spark), other(spark), ["formula"], "full")
