"""Checks of physical plans: pruning, pushdown, joins, and where Python runs."""

import os
import re
from datetime import date

import pytest

from usagelens.operators import reprice
from usagelens.functions.pricing import default_prices
from usagelens.plans import filters, reports, reshape
from usagelens.sources.ledger import append_usage, read_usage
from usagelens_checks import tables
from usagelens_checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")

# Rules that depend on earlier decisions of the same key.
SEQUENTIAL = {"admission_replay", "admission_dense", "admission_over_midnight", "request_outcome", "request_outcome_login",
              "users_after_changes", "user_change_counts", "stream_admission"}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "ledger")
    append_usage(tables.ledger(spark, SF_DIR), path)
    return read_usage(spark, path)


def columns_read(plan):
    """Columns of each scan, without the partition column."""
    lists = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    return [{column.split("#")[0] for column in text.split(",") if column} - {"day"} for text in lists]


def test_reports_prune_days_and_columns(stored):
    plan = plan_of(reports.by_user(filters.select_usage(stored, date(2024, 1, 31), "7", "u5")))
    assert "day#" in re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "2024-01-25" in plan and "EqualTo(username,u5)" in plan
    assert columns_read(plan) == [
        {"username", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cost_micros"}]
    assert plan.count("FileScan") == 1 and "partial_sum" in plan


def test_rolling_range_prunes_days(stored):
    plan = plan_of(reports.by_user(filters.rolling_days(stored, tables.NOW_MS, 2, tables.TZ)))
    assert "2024-01-28" in re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "GreaterThanOrEqual(ts_ms" in plan


def test_newest_days_are_a_top_k(stored):
    assert "TakeOrderedAndProject" in plan_of(reports.by_day(stored))


def test_day_axis_reads_no_columns(stored):
    scans = columns_read(plan_of(reshape.series_user_day(stored)))
    assert set() in scans and {"username", "input_tokens", "output_tokens", "cost_micros"} in scans


def test_reprice_is_one_scan_and_one_small_exchange(stored):
    plan = plan_of(reprice.reprice_preview(stored, default_prices()))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan
    assert "Exchange" not in plan_of(reprice.reprice_apply(stored, default_prices()))


def test_ledger_files_are_sorted(stored):
    import glob
    import pyarrow.parquet as pq

    folder = stored.inputFiles()[0].split("/day=")[0].replace("file://", "")
    for name in glob.glob(f"{folder}/day=*/*.parquet")[:5]:
        rows = pq.ParquetFile(name).read(columns=["username", "ts_ms"]).to_pylist()
        assert [tuple(row.values()) for row in rows] == sorted(tuple(row.values()) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_rows_blindly(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = re.search(r"MapInPandas|PythonUDF|ArrowEvalPython|FlatMap\w*Pandas|BatchEvalPython", plan)
    assert python is None or name in SEQUENTIAL
