"""Export of safe candidates to the laboratory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloyscreen.functions import composition, safety
from alloyscreen.operators import aggregates
from alloyscreen.sources import sinks


def exportable(predictions: DataFrame, safe_mode: bool = True, human_override: bool = False) -> DataFrame:
    """Safe rows; with an override also the rows that only an override allows. ``export_status`` tells them apart."""
    classed = predictions.transform(safety.with_safety_class, safe_mode, False)
    wanted = [safety.SAFE, safety.REVIEW] if human_override else [safety.SAFE]
    status = F.when(F.col("safety_class") == safety.SAFE, "safe").otherwise("human_override")
    return classed.filter(F.col("safety_class").isin(wanted)).withColumn("export_status", status)


def export_for_lab(predictions: DataFrame, path: str, safe_mode: bool = True, human_override: bool = False) -> DataFrame:
    """Writes the laboratory file under ``path`` and returns the summary counts."""
    rows = exportable(predictions, safe_mode, human_override).transform(composition.with_composition_text)
    sinks.write_lab_csv(rows, path)
    classed = predictions.transform(safety.with_safety_class, safe_mode, False)
    return aggregates.safety_summary(classed, human_override)
