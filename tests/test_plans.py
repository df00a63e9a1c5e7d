"""Plan shape checks: pushdown, pruning, no row-at-a-time Python, no cartesian products."""

import pytest

from conftest import SMALL
from labledger.plans.registry import REGISTRY

PYTHON_OK = {"anomalies", "fit_anomaly_model", "refit_anomaly_model", "score_new_orders", "stream_score_orders"}
SKIP = {"stream_import", "delete_all", "write_snapshot", "verify_after_write", "export_csv", "detect_export_format"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_visible_rows_prunes_lab_partition(spark):
    p = plan(REGISTRY["visible_rows"](spark, SMALL))
    assert "PartitionFilters: [isnotnull(lab" in p and "AMERICA" in p


def test_spend_by_grant_prunes_columns(spark):
    p = plan(REGISTRY["spend_by_grant"](spark, SMALL))
    assert "ReadSchema: struct<req_id:string,total:decimal(18,2),grant:string>" in p
    assert "PushedFilters: [IsNotNull(grant), Not(EqualTo(grant,))]" in p


def test_pending_filter_reaches_the_scan(spark):
    assert "PushedFilters: [IsNull(date_received)]" in plan(REGISTRY["pending_orders"](spark, SMALL))


@pytest.mark.parametrize("key", sorted(k for k in REGISTRY if k not in SKIP))
def test_no_python_rows_and_no_cartesian(spark, key):
    p = plan(REGISTRY[key](spark, SMALL))
    assert "BatchEvalPython" not in p
    assert "CartesianProduct" not in p
    if key not in PYTHON_OK:
        assert "ArrowEvalPython" not in p and "MapInPandas" not in p and "FlatMapGroupsInPandas" not in p
