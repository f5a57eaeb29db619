import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, table

QUICK = [
    "screen_top20", "safety_gate", "cost_benefit", "weight_percent", "quality_report", "priority_rank", "final_rank", "describe",
    "best_threshold", "hume_rothery", "pair_scan", "novelty_distance", "outcome_stream", "lab_csv", "candidate_pool",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 120


def test_entry(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    result = duck.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in result.description], result.fetchall())
