"""Physical plans: what must not appear in them, and what must."""

import pytest

from parcelsight.plans import prepare
from parcelsight.plans.catalog import queries
from parcelsight.plans.catalog.registry import Inputs


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "r6_category_rank_shares", "r13_speed_groups", "r22_sub_category_quadrants",
    "k5_spearman_matrix", "k10_delay_threshold_test", "v3_w6_threshold_sweep",
    "g2_stratified_folds", "w5_k1_midranks_of_prices", "a16_histogram", "e1_analysis_table"])
def test_no_cross_joins_and_no_python_rows(spark, sf_dir, name):
    text = plan_text(queries()[name](spark, sf_dir))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython"):
        assert forbidden not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    q = Inputs(spark, sf_dir)
    items = prepare.analysis_items(q.tables, ["order_id", "price"])
    text = plan_text(items)
    line = next(l for l in text.splitlines() if "FileScan" in l and "l_extendedprice" in l)
    assert "l_tax" not in line and "l_shipdate" not in line
    status = next(l for l in text.splitlines() if "FileScan" in l and "o_orderstatus" in l)
    assert "o_totalprice" not in status


def test_order_reports_never_read_items(spark, sf_dir):
    text = plan_text(queries()["r18_delay_rate_by_dispatch_speed"](spark, sf_dir))
    assert "l_orderkey" not in text and "c_custkey" not in text
