"""Validation, classification and calibration metrics. All reduce to counts and sums that combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen import schema
from alloyscreen.functions.basics import clip
from alloyscreen.operators import ordered

BINS = 10


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def outcome_flags(outcomes: DataFrame) -> DataFrame:
    predicted = (F.col("ml_pred") >= 0.5) | (F.col("llm_pred") >= 0.5)
    return outcomes.withColumns(
        {
            "successful": F.coalesce(F.col("outcome") == schema.OUTCOME_SUCCESS, F.lit(False)),
            "predicted_positive": F.coalesce(predicted, F.lit(False)),
            "actual_positive": F.coalesce(F.col("outcome").isin(schema.OUTCOME_POSITIVE), F.lit(False)),
            "ensemble_pred": F.col("ml_pred") * 0.7 + F.col("llm_pred") * 0.3,
        }
    )


COUNTERS = ["total_experiments", "successes", "predicted", "actual", "hits"]


def outcome_counters(flagged: DataFrame, *keys: Column) -> DataFrame:
    """Counts from which the validation metrics follow; they add up over days, files or streams."""
    p, a = F.col("predicted_positive"), F.col("actual_positive")
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_experiments"),
        F.count_if(F.col("successful")).alias("successes"),
        F.count_if(p).alias("predicted"),
        F.count_if(a).alias("actual"),
        F.count_if(p & a).alias("hits"),
    )


def metrics_from_counters(counters: DataFrame) -> DataFrame:
    total = counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
    return total.select(
        "total_experiments",
        _ratio(F.col("successes"), F.col("total_experiments")).alias("success_rate"),
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("actual")).alias("recall"),
    )


def validation_metrics(outcomes: DataFrame) -> DataFrame:
    return metrics_from_counters(outcome_counters(outcome_flags(outcomes)))


def right_closed_bin(p: Column, bins: int = BINS) -> Column:
    """Index of the bin (i/bins, (i+1)/bins] that holds ``p``; null for values at or below 0 and above 1."""
    index = F.ceil(p * bins - 1e-9) - 1
    return F.when((p > 0) & (p <= 1), F.greatest(index, F.lit(0)).cast("int"))


def outcome_calibration(outcomes: DataFrame) -> DataFrame:
    """Mean over non-empty bins of the gap between mean prediction and success rate."""
    binned = outcome_flags(outcomes).withColumn("bin", right_closed_bin(F.col("ensemble_pred"))).filter(F.col("bin").isNotNull())
    per_bin = binned.groupBy("bin").agg(
        F.avg("ensemble_pred").alias("predicted"), F.avg(F.col("actual_positive").cast("double")).alias("actual")
    )
    return per_bin.agg(
        F.coalesce(F.avg(F.abs(F.col("predicted") - F.col("actual"))), F.lit(0.0)).alias("calibration_error"),
        F.count(F.lit(1)).alias("bins_used"),
    )


def confusion_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp = F.col("tp")
    return c.select(
        "n", "tp", "fp", "fn", "tn",
        _ratio(tp + F.col("tn"), F.col("n")).alias("accuracy"),
        _ratio(tp, tp + F.col("fp")).alias("precision"),
        _ratio(tp, tp + F.col("fn")).alias("recall"),
        _ratio(tp * 2, tp * 2 + F.col("fp") + F.col("fn")).alias("f1_score"),
    )


def reliability_curve(df: DataFrame, label: str = "label", probability: str = "probability", bins: int = BINS) -> DataFrame:
    """Mean prediction and fraction of positives of each non-empty uniform bin; a bin holds its right edge, the first
    bin also 0."""
    p = F.col(probability)
    index = F.least(F.greatest(F.ceil(p * bins - 1e-9) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(p.isNotNull() & F.col(label).isNotNull()).groupBy(index.alias("bin")).agg(
        F.avg(probability).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("fraction_positive"),
        F.count(F.lit(1)).alias("n"),
        F.sum((p - F.col(label)) * (p - F.col(label))).alias("squared_error"),
    )


def calibration_metrics(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Calibration error with equal weight per bin, Brier score and greatest bin error."""
    gap = F.abs(F.col("fraction_positive") - F.col("mean_predicted"))
    return reliability_curve(df, label, probability).agg(
        F.avg(gap).alias("expected_calibration_error"),
        F.try_divide(F.sum("squared_error"), F.sum("n")).alias("brier_score"),
        F.max(gap).alias("max_calibration_error"),
    )


# Calibration grades.
ECE_WELL, ECE_MODERATE, ECE_ADVICE = 0.05, 0.1, 0.15


def with_calibration_grade(metrics: DataFrame) -> DataFrame:
    ece = F.col("expected_calibration_error")
    grade = (
        F.when(ece.isNull(), "not_calibrated").when(ece < ECE_WELL, "well_calibrated")
        .when(ece < ECE_MODERATE, "moderately_calibrated").otherwise("poorly_calibrated")
    )
    return metrics.withColumns({"calibration_status": grade, "reliable": F.coalesce(ece < ECE_ADVICE, F.lit(False))})


def with_ensemble_weights(metrics: DataFrame) -> DataFrame:
    """Classifier weight after a penalty for poor calibration."""
    ece = F.col("expected_calibration_error")
    cut = F.greatest(F.lit(0.4), F.lit(0.7) - F.least(F.lit(0.3), ece * 2))
    out = metrics.withColumn("ml_weight", F.when(ece > ECE_MODERATE, cut).otherwise(F.lit(0.7)))
    return out.withColumn("rule_weight", F.lit(1.0) - F.col("ml_weight"))


def best_threshold(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Score with the best F1 when used as threshold (the lowest of equals), limited to [0.2, 0.8]."""
    scores = df.filter(F.col(probability).isNotNull()).groupBy(F.col(probability).alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positive")
    )
    totals = ordered.running_totals(scores, "threshold", ["n", "positive"])
    # Rows at or above the threshold are predicted positive.
    chosen = F.col("n_total") - F.col("n_upto") + F.col("n")
    hits = F.col("positive_total") - F.col("positive_upto") + F.col("positive")
    precision, recall = hits / chosen, F.try_divide(hits, F.col("positive_total"))
    f1 = F.lit(2.0) * precision * recall / F.greatest(precision + recall, F.lit(1e-8))
    best = totals.select("threshold", F.round(f1, 12).alias("f1")).agg(
        F.max(F.struct("f1", (-F.col("threshold")).alias("negative"))).alias("b")
    )
    raw = -F.col("b.negative")
    return best.select(
        F.coalesce(clip(raw, 0.2, 0.8), F.lit(0.5)).alias("decision_threshold"), F.col("b.f1").alias("best_f1"), raw.alias("raw_threshold")
    )


def with_calibration_status(df: DataFrame, curve: DataFrame, probability: str = "synthesizability_probability") -> DataFrame:
    """Status by the reliability-curve bin whose mean prediction is nearest (the lower bin on a tie).

    The curve has at most ten rows; it reaches each row as one array."""
    points = curve.agg(F.sort_array(F.collect_list(F.struct("bin", "mean_predicted", "fraction_positive"))).alias("c")).scalar()
    p = F.col(probability)
    out = df.withColumn("_curve", points)
    near = F.array_min(
        F.transform(
            F.col("_curve"),
            lambda b: F.struct(F.abs(b["mean_predicted"] - p).alias("d"), b["bin"].alias("bin"), b["fraction_positive"].alias("f")),
        )
    )
    error = F.abs(p - near["f"])
    status = F.when(error < 0.1, "well-calibrated").when(error < 0.2, "overconfident").otherwise("underconfident")
    return out.withColumns({"calibration_error": error, "calibration_status": status}).drop("_curve")
