"""Range and policy files, from any store that Spark reads. JSON always, YAML where its reader is installed."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from alloyscreen import refdata
from alloyscreen.operators import cleaning

try:
    import yaml
except ImportError:  # JSON files are read all the same
    yaml = None


def read_settings(spark: SparkSession, path: str) -> dict | None:
    """The file's content; None if there is no such file. A file that cannot be read is an error."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    content = (text["value"] if text else "").strip()
    found = json.loads(content or "{}") if yaml is None or content[:1] in ("", "{", "[") else yaml.safe_load(content)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no names with settings")
    return found


def read_ranges(spark: SparkSession, path: str) -> dict[str, tuple[float | None, float | None]] | None:
    """Least and greatest value of the numeric columns of a range file (``type`` float or integer, ``range`` [least, greatest]; a missing
    bound is none); None if there is no file."""
    settings = read_settings(spark, path)
    if settings is None:
        return None
    found = {}
    for name, rules in settings.items():
        if isinstance(rules, dict) and rules.get("type") in ("float", "integer"):
            low, high = rules.get("range") or (None, None)
            found[name] = None if low is None else float(low), None if high is None else float(high)
    return found


def clean_by_file(df: DataFrame, path: str) -> DataFrame:
    """``cleaning.schema_clean`` by a range file. Without the file the table stays as it is; columns that only one of both has are left alone."""
    ranges = read_ranges(df.sparkSession, path)
    return df if ranges is None else cleaning.schema_clean(df, ranges)


def read_policy(spark: SparkSession, path: str) -> dict:
    """The hazard policy of a file; the usual one for settings that it lacks, and without a file. ``safety`` functions take it as ``policy``.

    Settings may lie below ``safety_thresholds`` or beside it."""
    settings = read_settings(spark, path) or {}
    told = {**settings, **(settings.get("safety_thresholds") or {})}
    return {name: told.get(name, usual) for name, usual in refdata.HAZARD_POLICY.items()}
