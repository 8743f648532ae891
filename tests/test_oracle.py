"""Registered queries against their SQL on DuckDB at the smallest scale.

By default a quick set; LEDGERLENS_ORACLE=all runs every query.
"""

import os
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUICK = (
    "quarterly_composition parse_dates income_ratios temporal_split store_manifest cv_folds "
    "application_status dashboard_summary decision_intake experiment_arms review_bundle "
    "metrics_by_quarter f1_threshold ks_statistic ks_trend_top adwin_scores"
).split()
CHOSEN = list(contract.queries()) if os.environ.get("LEDGERLENS_ORACLE") == "all" else QUICK

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_its_sql(spark, connection, name):
    status, rows, _, detail = compare(
        spark, connection, name, SF_DIR, contract.queries()[name], contract.oracle_sql().get(name))
    assert status in ("ok", "rows-only"), detail
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "issue_quarter", "resolved_loans", "defaults", "default_rate"]
