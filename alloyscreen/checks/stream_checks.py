from __future__ import annotations

from pyspark.sql import functions as F

from alloyscreen.checks.aggregate_checks import FLAGS
from alloyscreen.checks.core import check, r, rounded
from alloyscreen.functions.composition import element_array
from alloyscreen.operators import metrics
from alloyscreen.session import run_folder
from alloyscreen.sources import driver_tables as tables
from alloyscreen.streaming import outcome_state, streams

STREAM_FLAGS = FLAGS.replace("FROM outcomes", "FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in tables.OUTCOME_COLUMNS.items()) + " FROM events)")


def _arriving(spark, d, name):
    shape = tables.table(spark, d, name).schema
    return streams.read_stream(spark, d, shape, f"{name}.parquet")


def _arriving_outcomes(spark, d):
    sent = tables.as_outcomes(_arriving(spark, d, "events"))
    return sent.withColumn("attempted_date", F.col("attempted_date").cast("timestamp"))


OUTCOME_METRICS = f"""SELECT count(*) AS total_experiments, {r("count(*) FILTER (WHERE outcome = 'Successful') / count(*)", 'success_rate')}, {r('count(*) FILTER (WHERE p AND a) / count(*) FILTER (WHERE p)', 'precision')},
    {r('count(*) FILTER (WHERE p AND a) / count(*) FILTER (WHERE a)', 'recall')},
    (SELECT {r('avg(abs(x - y))', 'v', 8)} FROM (SELECT avg(e) AS x, avg(CAST(a AS INT)) AS y FROM {STREAM_FLAGS} WHERE e > 0 AND e <= 1 GROUP BY ceil(e * 10 - 1e-9))) AS calibration_error,
    (SELECT {r("count(*) FILTER (WHERE outcome = 'Successful') / count(*)", 'v')} FROM (SELECT * FROM {STREAM_FLAGS} ORDER BY attempted_date DESC, outcome_id DESC LIMIT 10)) AS hit_rate_last_10 FROM {STREAM_FLAGS}"""


@check("outcome_stream", OUTCOME_METRICS)
def outcome_stream(spark, d):
    """Every outcome is sent twice; the stream stores it once, and the metrics follow from the stored log."""
    root = run_folder(spark, "outcome_stream")
    sent = _arriving_outcomes(spark, d).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    streams.append_to(streams.distinct_outcomes(sent), f"{root}/log", f"{root}/progress").awaitTermination()
    out = rounded(streams.refresh_metrics(spark.read.parquet(f"{root}/log")))
    return out.withColumn("calibration_error", F.round("calibration_error", 8))


@check("outcome_state_stream", OUTCOME_METRICS)
def outcome_state_stream(spark, d):
    """Outcomes arrive in three batches, each outcome twice; the metrics follow from the stored state. The last batch is sent
    again and changes nothing."""
    root = run_folder(spark, "outcome_state_stream")
    sent = tables.as_outcomes(tables.table(spark, d, "events")).withColumn("attempted_date", F.col("attempted_date").cast("timestamp"))
    sent.repartitionByRange(3, "attempted_date").write.parquet(f"{root}/in")
    stream = streams.read_stream(spark, f"{root}/in", sent.schema, files=1).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    # files arrive in any order, so that none may be late
    outcome_state.follow(streams.distinct_outcomes(stream, "100000 days"), f"{root}/state", f"{root}/progress").awaitTermination()
    outcome_state.apply_batch(sent, 2, f"{root}/state")
    out = rounded(outcome_state.metrics_of(outcome_state.read_state(spark, f"{root}/state")))
    return out.withColumn("calibration_error", F.round("calibration_error", 8))


@check("outcome_state_days", f"""SELECT date_trunc('day', attempted_date) AS day, count(*) AS total_experiments, count(*) FILTER (WHERE outcome = 'Successful') AS successes, count(*) FILTER (WHERE p) AS predicted, count(*) FILTER (WHERE a) AS actual,
    count(*) FILTER (WHERE p AND a) AS hits FROM {STREAM_FLAGS} GROUP BY 1""")
def outcome_state_days(spark, d):
    """Daily counters of a state merged from two halves of the log."""
    sent = tables.as_outcomes(tables.table(spark, d, "events")).withColumn("attempted_date", F.col("attempted_date").cast("timestamp"))
    halves = [outcome_state.state_of(sent.filter(F.col("outcome_id") % 2 == i)) for i in (0, 1)]
    days = outcome_state.daily_metrics(outcome_state.merged(*halves))
    return days.withColumn("day", F.col("day").cast("timestamp_ntz"))


@check("outcome_counters", f"""SELECT day, count(*) AS total_experiments, count(*) FILTER (WHERE outcome = 'Successful') AS successes, count(*) FILTER (WHERE p) AS predicted, count(*) FILTER (WHERE a) AS actual, count(*) FILTER (WHERE p AND a) AS hits
    FROM (SELECT *, date_trunc('day', attempted_date) AS day FROM {STREAM_FLAGS}) WHERE day + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY day""")
def outcome_counters(spark, d):
    """Counters of the days that the watermark has closed."""
    root = run_folder(spark, "outcome_counters")
    streams.append_to(streams.daily_counters(_arriving_outcomes(spark, d)), f"{root}/days", f"{root}/progress").awaitTermination()
    return spark.read.parquet(f"{root}/days").select(F.col("day").cast("timestamp_ntz").alias("day"), *metrics.COUNTERS)


@check("candidate_stream", f"SELECT material_id, {r('ensemble_probability', 'ensemble_probability')}, {r('thermodynamic_stability_score', 'thermodynamic_stability_score')}, rule_score, safety_class FROM classed")
def candidate_stream(spark, d):
    root = run_folder(spark, "candidate_stream")
    arriving = tables.as_materials(_arriving(spark, d, "lineitem"))
    arriving = arriving.withColumn("elements", element_array(arriving))
    streams.append_to(streams.score_candidates(arriving), f"{root}/scored", f"{root}/progress").awaitTermination()
    out = spark.read.parquet(f"{root}/scored")
    return rounded(out.select("material_id", "ensemble_probability", "thermodynamic_stability_score", "rule_score", "safety_class"))
