"""Outcome metrics that are kept up to date batch by batch: the log is never read again.

The state is a small table that adds up: counters per day, ten calibration bins, and the last outcomes. It has one version per
batch of the stream, each made from the version before and the batch alone. A batch that arrives again after a failure finds its
version there and changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alloyscreen.operators import metrics
from alloyscreen.session import finished, folders, remove

LAST = 10
#: Rows of the three parts lie in one table: ``part`` tells which columns are in use.
DAY = ["day", *metrics.COUNTERS]
BIN = ["bin", "n", "predicted_sum", "positive"]
RECENT = ["outcome_id", "attempted_date", "successful"]
STATE = (
    "part string, day timestamp, total_experiments long, successes long, predicted long, actual long, hits long, "
    "bin int, n long, predicted_sum double, positive long, outcome_id long, attempted_date timestamp, successful boolean"
)


def _part(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("part", F.lit(name))


def _put_together(days: DataFrame, bins: DataFrame, recent: DataFrame) -> DataFrame:
    parts = _part(days, "day").unionByName(_part(bins, "bin"), allowMissingColumns=True).unionByName(_part(recent, "recent"), allowMissingColumns=True)
    return parts.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in STATE.split(", ")])


def _last(recent: DataFrame) -> DataFrame:
    return recent.orderBy(F.desc("attempted_date"), F.desc("outcome_id")).limit(LAST)


def state_of(outcomes: DataFrame) -> DataFrame:
    """The state that these outcomes alone make."""
    flagged = metrics.outcome_flags(outcomes)
    days = metrics.outcome_counters(flagged, F.date_trunc("day", "attempted_date").alias("day"))
    binned = flagged.withColumn("bin", metrics.right_closed_bin(F.col("ensemble_pred"))).filter(F.col("bin").isNotNull())
    bins = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ensemble_pred").alias("predicted_sum"), F.count_if("actual_positive").alias("positive")
    )
    return _put_together(days, bins, _last(flagged.select(*RECENT)))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """The state of the outcomes of both: counts and sums add up, the later outcomes stay. The order of merging does not matter."""
    both = first.unionByName(second)
    sums = lambda part, key, names: both.filter(F.col("part") == part).groupBy(key).agg(*[F.sum(c).alias(c) for c in names])
    recent = _last(both.filter(F.col("part") == "recent").select(*RECENT))
    return _put_together(sums("day", "day", metrics.COUNTERS), sums("bin", "bin", BIN[1:]), recent)


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(f[1:]) for f in folders(spark, path) if f[:1] == "v" and f[1:].isdigit() and finished(spark, f"{path}/{f}"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; without one, an empty state."""
    known = _versions(spark, path)
    return spark.read.schema(STATE).parquet(f"{path}/v{known[-1]}") if known else spark.createDataFrame([], STATE)


def apply_batch(batch: DataFrame, batch_id: int, path: str) -> bool:
    """Makes version ``batch_id`` of the state from the one before and ``batch``; False if that batch has been applied before.

    Of the older versions the last one stays, in case the newest is lost with a store that is not durable yet."""
    spark = batch.sparkSession
    known = _versions(spark, path)
    if known and known[-1] >= batch_id:
        return False
    merged(read_state(spark, path), state_of(batch)).coalesce(1).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
    for old in known[:-1]:
        remove(spark, f"{path}/v{old}")
    return True


def metrics_of(state: DataFrame) -> DataFrame:
    """Validation metrics, calibration error and recent hit rate in one row."""
    part = lambda name: state.filter(F.col("part") == name)
    gap = F.abs(F.col("predicted_sum") / F.col("n") - F.col("positive") / F.col("n"))
    error = part("bin").agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("calibration_error")).scalar()
    hits = part("recent").agg(F.coalesce(F.try_divide(F.count_if("successful"), F.count(F.lit(1))), F.lit(0.0)).alias("rate")).scalar()
    return metrics.metrics_from_counters(part("day")).withColumns({"calibration_error": error, "hit_rate_last_10": hits})


def daily_metrics(state: DataFrame) -> DataFrame:
    """The counters of each day."""
    return state.filter(F.col("part") == "day").select(*DAY)


def follow(stream: DataFrame, path: str, progress: str) -> StreamingQuery:
    """Applies what has arrived so far, batch by batch, and stops; the next call continues from there.

    ``progress`` numbers the batches, so the two folders belong together."""
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, path) and None)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
