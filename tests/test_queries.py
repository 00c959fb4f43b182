"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

import pytest

import tidemark.queries  # noqa: F401
from tests.oracle import compare
from tidemark.plans.registry import QUERIES

SF, NEXT_SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WITH_SQL = [n for n, q in QUERIES.items() if q.oracle()]
#: Fits and windows that need more rows than the smallest tables have run on the next larger ones.
LARGER = {"e06_engle_granger_by_period", "e16_train_test_backtest", "f19_rolling_adf_gate", "g03_weight_grid", "g04_config_evaluation", "m20_importance_stability", "m22_grid_search", "m24_stability", "m24_learning_curve"}


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, name):
    compare(spark, QUERIES[name], QUERIES[name].oracle(), SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WITH_SQL])
def test_rows_hold_values(spark, name):
    """Queries without SQL give rows, every column of which holds values; what they compute is tested in test_operators."""
    rows = QUERIES[name](spark, NEXT_SF if name in LARGER else SF).toPandas()
    assert len(rows) and rows.columns.is_unique
    assert rows.notna().any().all(), rows.columns[~rows.notna().any()].tolist()
