"""Outcomes and candidates as file streams. Sinks are parquet tables with exactly-once file commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from alloyscreen.operators import metrics, ranking
from alloyscreen.plans import screening
from alloyscreen.functions import safety


def read_stream(
    spark: SparkSession, folder: str, table_schema: StructType, pattern: str = "*.parquet", files: int | None = None, size: str | None = None
) -> DataFrame:
    """Files as they arrive. ``files`` or ``size`` (such as ``10g``) bound what one batch takes on, so that a long backlog is
    worked off in steps of that size."""
    reader = spark.readStream.schema(table_schema).option("pathGlobFilter", pattern)
    bounds = {"maxFilesPerTrigger": files, "maxBytesPerTrigger": size}
    for name, bound in bounds.items():
        if bound is not None:
            reader = reader.option(name, bound)
    return reader.parquet(folder)


def distinct_outcomes(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each outcome once, even when it is sent again within the delay; the state is dropped behind the watermark."""
    return stream.withWatermark("attempted_date", delay).dropDuplicatesWithinWatermark(["outcome_id"])


def daily_counters(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Metric counters per day; ``metrics.metrics_from_counters`` adds them up."""
    flagged = metrics.outcome_flags(stream.withWatermark("attempted_date", delay))
    counted = metrics.outcome_counters(flagged, F.window("attempted_date", "1 day"))
    return counted.select(F.col("window.start").alias("day"), *metrics.COUNTERS)


def score_candidates(stream: DataFrame) -> DataFrame:
    """Stability, rules, ensemble and safety of arriving candidates; no state."""
    return screening.score(stream).transform(safety.with_safety_class)


def append_to(stream: DataFrame, path: str, progress: str) -> StreamingQuery:
    """Appends what has arrived so far to a parquet table and stops; the next call continues from there."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress)
        .trigger(availableNow=True).start(path)
    )


def refresh_metrics(log: DataFrame) -> DataFrame:
    """Validation metrics, calibration error and recent hit rate of the whole log: three one-row tables side by side.

    ``outcome_state`` keeps the same figures up to date without reading the log."""
    calibration = metrics.outcome_calibration(log).select("calibration_error").scalar()
    recent = ranking.last_hit_rate(log).select("hit_rate_last_10").scalar()
    return metrics.validation_metrics(log).withColumns({"calibration_error": calibration, "hit_rate_last_10": recent})
