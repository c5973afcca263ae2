"""Every registered query against its DuckDB SQL on the smallest tables."""
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import _rows, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(s_cols, s_rows) == _rows(d_cols, d_rows)


def test_every_query_has_oracle_or_is_listed():
    # Training-data queries without a SQL form are tested against brute force in tests/llm.
    rest = {q for q in set(E.queries()) - set(E.oracle_sql()) if not q.startswith("op") and q != "pipeline"}
    assert not rest


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["debit_credit_indicator", "posting_month", "amount_sum", "amount_count"]
    assert df.count() >= 0


def test_transformed_column_order_matches_spark(spark):
    from ledgerlens.plans.views import TRANSFORMED_COLUMNS
    assert E._transformed(spark, SF).columns == TRANSFORMED_COLUMNS
