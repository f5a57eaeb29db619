"""Outcome metrics kept up batch by batch, and the log that takes each batch once."""

import pytest
from pyspark.sql import functions as F

from alloyscreen.session import finished, folders, run_folder
from alloyscreen.sources import scans, sinks
from alloyscreen.streaming import outcome_state, streams

SCHEMA = "outcome_id long, attempted_date timestamp, outcome string, ml_pred double, llm_pred double, formula string"


def outcomes(spark, ids):
    names = F.array(*[F.lit(n) for n in ("Successful", "Partial success", "Failed", "Not yet attempted")])
    ids = spark.createDataFrame([(i,) for i in ids], "outcome_id long")
    return ids.select(
        "outcome_id", F.timestamp_seconds(1_700_000_000 + F.col("outcome_id") * 9_000).alias("attempted_date"), F.get(names, (F.col("outcome_id") % 4).cast("int")).alias("outcome"),
        F.when(F.col("outcome_id") % 11 != 0, F.col("outcome_id") * 37 % 101 / 100).alias("ml_pred"), (F.col("outcome_id") * 53 % 101 / 100).alias("llm_pred"), F.lit("Al0.500Ti0.500").alias("formula"),
    )


def values(df):
    return tuple(x if not isinstance(x, float) else pytest.approx(x) for x in df.first())


def test_batches_and_a_replay_equal_the_whole_log(spark):
    path = run_folder(spark, "state")
    parts = [outcomes(spark, range(0, 40)), outcomes(spark, range(70, 90)), outcomes(spark, range(40, 70))]
    assert [outcome_state.apply_batch(p, i, path) for i, p in enumerate(parts)] == [True] * 3
    assert not outcome_state.apply_batch(parts[2], 2, path) and not outcome_state.apply_batch(parts[0], 0, path)
    state = outcome_state.read_state(spark, path)
    assert outcome_state.metrics_of(state).first() == values(streams.refresh_metrics(outcomes(spark, range(90))))
    assert state.filter("part = 'recent'").count() == 10
    # only the newest version and the one before it are kept
    assert sorted(folders(spark, path)) == ["v1", "v2"]


def test_a_version_cut_off_in_writing_is_made_anew(spark):
    path = run_folder(spark, "state")
    outcome_state.apply_batch(outcomes(spark, range(10)), 0, path)
    outcome_state.state_of(outcomes(spark, range(500))).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/v1")
    assert outcome_state.metrics_of(outcome_state.read_state(spark, path)).first()["total_experiments"] == 10
    assert outcome_state.apply_batch(outcomes(spark, range(10, 30)), 1, path)
    assert outcome_state.metrics_of(outcome_state.read_state(spark, path)).first() == values(streams.refresh_metrics(outcomes(spark, range(30))))


def test_the_order_of_merging_does_not_matter(spark):
    a, b, c = (outcome_state.state_of(outcomes(spark, r)) for r in (range(0, 13), range(13, 14), range(14, 60)))
    left = outcome_state.merged(outcome_state.merged(a, b), c)
    right = outcome_state.merged(c, outcome_state.merged(b, a))
    rows = lambda s: sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in s.collect()), key=str)
    assert rows(left) == rows(right)


def test_only_state_and_batch_are_read(spark):
    path, batch = run_folder(spark, "state"), run_folder(spark, "batch")
    outcome_state.apply_batch(outcomes(spark, range(10)), 0, path)
    outcomes(spark, range(10, 20)).write.parquet(batch)
    read = outcome_state.merged(outcome_state.read_state(spark, path), outcome_state.state_of(spark.read.parquet(batch))).inputFiles()
    assert read and all(batch in f or f"{path}/v0" in f for f in read)


def test_state_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    path = run_folder(spark, "state")
    want = values(streams.refresh_metrics(empty))
    assert outcome_state.metrics_of(outcome_state.read_state(spark, path)).first() == want
    assert outcome_state.apply_batch(empty, 0, path)
    assert outcome_state.metrics_of(outcome_state.read_state(spark, path)).first() == want


def test_stream_with_bounded_batches(spark):
    root = run_folder(spark, "follow")
    for i in range(3):
        outcomes(spark, range(i * 20, i * 20 + 20)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    shape = outcomes(spark, [0]).schema
    stream = lambda: streams.read_stream(spark, f"{root}/in", shape, files=1)
    outcome_state.follow(stream(), f"{root}/state", f"{root}/progress").awaitTermination()
    assert folders(spark, f"{root}/state") and finished(spark, f"{root}/state/v2")
    outcomes(spark, range(60, 65)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    outcome_state.follow(stream(), f"{root}/state", f"{root}/progress").awaitTermination()
    assert outcome_state.metrics_of(outcome_state.read_state(spark, f"{root}/state")).first() == values(streams.refresh_metrics(outcomes(spark, range(65))))


def test_a_batch_is_logged_once(spark):
    path = run_folder(spark, "log")
    for _ in range(2):
        sinks.append_outcomes(outcomes(spark, range(10)), path, "first")
    name = sinks.append_outcomes(outcomes(spark, [8, 9, 10, 11, 11]), path)
    assert sinks.append_outcomes(outcomes(spark, [11, 11, 10, 9, 8]), path) == name != "first"
    assert scans.read_outcomes(spark, path).count() == 12
    unknown = outcomes(spark, [1, 1]).withColumn("outcome_id", F.lit(None).cast("long"))
    sinks.append_outcomes(unknown, path)
    assert scans.read_outcomes(spark, path).count() == 14


def test_a_batch_cut_off_in_writing_is_written_anew(spark):
    path = run_folder(spark, "log")
    outcomes(spark, range(3)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=x")
    sinks.append_outcomes(outcomes(spark, range(5)), path, "x")
    assert scans.read_outcomes(spark, path).count() == 5
