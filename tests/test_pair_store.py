"""The layout by element pairs."""

import pytest

from alloyscreen.session import run_folder
from alloyscreen.sources import pair_store, scans

PAIRS = [("Al", "Ti"), ("Al", "V"), ("Ti", "V")]
SHAPE = "material_id string, elements array<string>, energy_above_hull double, nsites int, density string, payload string"


@pytest.fixture(scope="module")
def store(spark):
    kinds = [["Al", "Ti"], ["V", "Al"], ["Al", "Ti", "V"], ["Fe"], ["Ti", "V"], [], None]
    rows = [(f"m{i:03d}", kinds[i % 7], (i % 10) / 100, i % 12, "n/a" if i % 9 == 0 else "2.5", "x" * 50) for i in range(210)]
    frame = spark.createDataFrame(rows, SHAPE)
    path = run_folder(spark, "pairs")
    pair_store.write_pairs(frame, path, PAIRS, 3)
    return frame, path


@pytest.mark.parametrize("pairs", [PAIRS, PAIRS[::-1], [("Ti", "V")], [("Al", "V"), ("Al", "Ti")]])
def test_equals_a_scan_of_all_materials(spark, store, pairs):
    frame, path = store
    got, want = pair_store.stored_pair_scan(spark, path, pairs), scans.pair_scan(frame, pairs)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_only_the_folders_asked_for_are_read(spark, store):
    scan = pair_store.stored_pair_scan(spark, store[1], [("Ti", "V")])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pair" in plan or "PartitionFilters: [pair" in plan
    assert "LessThanOrEqual(energy_above_hull,0.05)" in plan and "payload" not in plan and "Exchange" not in plan
    read = scan.selectExpr("input_file_name() AS f").distinct().collect()
    assert read and all("pair=Ti-V" in r["f"] for r in read)


def test_nothing_is_left_out_by_default(spark):
    rows = [(f"m{i:04d}", ["Al", "Ti"], 0.01, 4, "1.0", "") for i in range(300)]
    frame = spark.createDataFrame(rows, SHAPE)
    assert scans.pair_scan(frame, PAIRS).count() == scans.training_scan(frame, PAIRS).count() == scans.summary_scan(frame).count() == 300
    assert scans.pair_scan(frame, PAIRS, 50).count() == 50 and scans.summary_scan(frame, limit=7).count() == 7
