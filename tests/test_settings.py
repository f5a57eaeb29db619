"""Range and policy files."""

import json

import pytest
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.functions import safety
from alloyscreen.sources import settings

RANGES = {"a": {"type": "float", "range": [0.0, 1.0]}, "b": {"type": "integer"}, "c": {"type": "string", "range": [0, 1]}, "absent": {"type": "float", "range": [0, 1]}, "d": {"type": "float", "range": [None, 2]}}


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(0.2, 1, "x", -7.0), (None, None, "y", 9.0), (3.4, 3, None, None)], "a double, b int, c string, d double")


@pytest.mark.parametrize("kind", ["json", "yml"])
def test_ranges_from_a_file(spark, table, tmp_path, kind):
    path = tmp_path / f"ranges.{kind}"
    if kind == "yml":
        yaml = pytest.importorskip("yaml")
        path.write_text("# ranges\n" + yaml.safe_dump(RANGES))
    else:
        path.write_text(json.dumps(RANGES, indent=1))
    got = [tuple(r) for r in settings.clean_by_file(table, str(path)).collect()]
    assert got == [(0.2, 1.0, "x", -7.0), (1.0, 2.0, "y", 2.0), (1.0, 3.0, None, 1.0)]


def test_without_a_file_nothing_changes(table, tmp_path):
    assert settings.clean_by_file(table, str(tmp_path / "none.yml")) is table


def test_a_file_without_settings(spark, table, tmp_path):
    (tmp_path / "empty.json").write_text("{}")
    assert settings.clean_by_file(table, str(tmp_path / "empty.json")).collect() == table.collect()
    (tmp_path / "list.json").write_text("[1, 2]")
    with pytest.raises(ValueError):
        settings.read_settings(spark, str(tmp_path / "list.json"))


def test_policy_from_a_file(spark, tmp_path):
    path = tmp_path / "hazards.json"
    path.write_text(json.dumps({"blacklist_elements": ["Al"], "safety_thresholds": {"ensemble_probability_min": 0.1}}))
    policy = settings.read_policy(spark, str(path))
    assert policy["blacklist_elements"] == ["Al"] and policy["ensemble_probability_min"] == 0.1
    assert policy["human_override_allowed"] is refdata.HAZARD_POLICY["human_override_allowed"]
    assert settings.read_policy(spark, str(tmp_path / "none.yml")) == refdata.HAZARD_POLICY
    row = spark.createDataFrame([("Al", "Ti", 0.9, "highly_stable", "in-dist", ["Al", "Ti"])],
                                "element_1 string, element_2 string, ensemble_probability double, thermodynamic_stability_category string, in_distribution string, elements array<string>")
    passes = lambda p: safety.with_safety_check(row, policy=p).select(F.col("safety_check_passed")).first()[0]
    assert passes(refdata.HAZARD_POLICY) and not passes(policy)
