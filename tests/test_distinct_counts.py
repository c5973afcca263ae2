"""Several distinct counts over a stored table: one branch each, no row expansion."""

import random

from ledgerlens.operators.view import compile_view
from ledgerlens.plans.journal import query_view

VIEW = {"dimensions": [{"field_id": "currency"}, {"field_id": "posting_year"}],
        "measures": [{"field_id": "amount", "aggregations": ["sum", "count_distinct", "count"]},
                     {"field_id": "abs_amount", "aggregations": ["count_distinct", "max"]},
                     {"field_id": "line_number", "aggregations": ["count_distinct"]}]}


def _rows(n):
    rnd = random.Random(3)
    pick = lambda *xs: rnd.choice(xs)                                   # noqa: E731
    # a third of the rows in one group, null keys and values, groups without a value
    return [("USD" if rnd.random() < .4 else pick("EUR", None, ""), pick(2024, 2025, None),
             None if rnd.random() < .1 else float(rnd.randint(-30, 30)), None, rnd.randint(1, 5)) for _ in range(n)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _stored(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(rows, "currency string, posting_year int, amount double, abs_amount double, line_number bigint")
    df.write.parquet(path)
    return path


def test_same_counts_without_expansion(spark, tmp_path):
    rows = _rows(3000)
    path = _stored(spark, tmp_path, rows)
    out = query_view(spark, path, VIEW)
    single = compile_view(spark.read.parquet(path), VIEW)
    assert out.columns == single.columns and out.schema.simpleString() == single.schema.simpleString()
    assert "Expand" in _plan(single) and "Expand" not in _plan(out) and "Join" not in _plan(out)
    got = {(r.currency, r.posting_year): r for r in out.collect()}
    assert len(got) == len({r[:2] for r in rows})
    for key, r in got.items():
        mine = [x for x in rows if x[:2] == key]
        amounts = [x[2] for x in mine if x[2] is not None]
        assert r.amount_count_distinct == len(set(amounts)) and r.amount_count == len(amounts)
        assert r.amount_sum == (sum(amounts) if amounts else None)
        assert r.abs_amount_count_distinct == 0 and r.abs_amount_max is None
        assert r.line_number_count_distinct == len({x[4] for x in mine})


def test_each_branch_reads_its_own_columns(spark, tmp_path):
    path = _stored(spark, tmp_path, _rows(50))
    plan = query_view(spark, path, {**VIEW, "dimensions": []})._jdf.queryExecution().executedPlan().toString()
    schemas = sorted(x.split(">")[0] for x in plan.split("ReadSchema: struct<")[1:])
    assert schemas == ["abs_amount:double", "amount:double,abs_amount:double", "line_number:bigint"]


def test_global_sorted_paged_and_empty(spark, tmp_path):
    rows = _rows(400)
    path = _stored(spark, tmp_path, rows)
    r = query_view(spark, path, {**VIEW, "dimensions": []}).first()
    assert (r.amount_count_distinct, r.line_number_count_distinct, r.abs_amount_count_distinct) == (
        len({x[2] for x in rows} - {None}), 5, 0)
    none = {"op": "and", "conditions": [{"field_id": "posting_year", "operator": "=", "value": 1}]}
    assert query_view(spark, path, {**VIEW, "filters": none}).collect() == []
    r = query_view(spark, path, {**VIEW, "dimensions": [], "filters": none}).first()
    assert (r.amount_count_distinct, r.amount_count, r.amount_sum) == (0, 0, None)
    paged = {**VIEW, "sorting": [{"field_id": "amount", "sorting_direction": "desc", "aggregation": "count_distinct"}],
             "pagination": {"limit": 4, "offset": 1}}
    assert query_view(spark, path, paged).collect() == compile_view(spark.read.parquet(path), paged).collect()
    exact = query_view(spark, path, VIEW, exact_sums=True)
    assert sorted(map(str, exact.collect())) == sorted(map(str, query_view(spark, path, VIEW).collect()))
