"""Registered queries against their SQL twins, on plain and on skewed tables."""

import duckdb
import pytest

from oracle_check import compare, connect
from parcelsight.plans.catalog import oracles, queries

SAMPLE = [
    "e1_analysis_table", "a2_deterministic_mode", "a4_item_arrays_per_order",
    "a7_exact_quantiles_by_group", "d2_latest_review", "d4_top_scored_item_per_order",
    "g2_stratified_folds", "g4_leak_report", "k2_continuous_price_of_delayed_items",
    "k5_spearman_matrix", "k10_delay_threshold_test", "r4_delay_by_distance",
    "r18_delay_rate_by_dispatch_speed", "r21_customer_state_statistics",
    "v3_w6_threshold_sweep",
]


@pytest.fixture(scope="module")
def skewed_dir(sf_dir, tmp_path_factory):
    """The same tables with one order, customer, product, seller and price on every third row."""
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in ("nation", "customer", "supplier", "part"):
        con.execute(f"COPY (SELECT * FROM '{sf_dir}/{name}.parquet') "
                    f"TO '{out}/{name}.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT * REPLACE (
        CASE WHEN o_orderkey % 3 = 0 THEN 12 ELSE o_custkey END AS o_custkey)
      FROM '{sf_dir}/orders.parquet') TO '{out}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT * EXCLUDE (r) REPLACE (
        CASE WHEN r % 3 = 0 THEN 4 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN r % 3 = 1 THEN 1 ELSE l_partkey END AS l_partkey,
        CASE WHEN r % 3 = 2 THEN 1 ELSE l_suppkey END AS l_suppkey,
        CASE WHEN r % 3 = 0 THEN 100.5 ELSE l_extendedprice END AS l_extendedprice)
      FROM (SELECT *, row_number() OVER () AS r FROM '{sf_dir}/lineitem.parquet'))
      TO '{out}/lineitem.parquet' (FORMAT parquet)""")
    return str(out)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf_dir, name):
    assert compare(queries()[name](spark, sf_dir), connect(sf_dir), oracles()[name]) == ""


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql_with_hot_keys(spark, skewed_dir, name):
    assert compare(queries()[name](spark, skewed_dir), connect(skewed_dir), oracles()[name]) == ""


def test_registry_is_complete():
    names = set(queries())
    assert set(oracles()) <= names
    for prefix in ("s1", "f13", "d1", "j4", "a1", "w1", "l4", "c4", "i1", "r30", "k10", "g1", "m5",
                   "v10", "p6", "st1", "st2"):
        assert any(n.startswith(prefix) for n in names), prefix
