import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.registry import UnknownFieldError, registry
from ledgerlens.operators.view import compile_view
from ledgerlens.plans.spec import ViewError, ViewSpec

ID = registry.id_of


@pytest.fixture(scope="module")
def t(spark):
    rows = [("D1", "USD", "Manual", 100.0, 1, "D"), ("D2", "USD", "System", -50.0, 2, "C"),
            ("D3", "EUR", "Manual", 30.0, 1, "D"), ("D4", "EUR", "System", None, 3, "UNKNOWN"),
            ("D5", "USD", "Manual", 100.0, 1, "D")]
    return spark.createDataFrame(rows, "document_number string, currency string, journal_type string, "
                                       "amount double, line_number bigint, debit_credit_indicator string")


def _v(t, **spec):
    return compile_view(t, ViewSpec.from_dict(spec))


def test_select_all_when_empty(t):
    assert _v(t, dimensions=[]).count() == 5


def test_group_and_measures(t):
    out = _v(t, dimensions=[{"field_id": ID("currency"), "axis": "row"}],
             measures=[{"field_id": ID("amount"), "aggregations": ["sum", "count", "count_distinct", "avg"]}])
    assert out.columns == ["currency", "amount_sum", "amount_count", "amount_count_distinct", "amount_avg"]
    got = {r.currency: tuple(r)[1:] for r in out.collect()}
    assert got == {"USD": (150.0, 3, 2, 50.0), "EUR": (30.0, 1, 1, 30.0)}


def test_dimensions_only_distinct(t):
    out = _v(t, dimensions=[{"field_id": ID("currency"), "axis": "row"}])
    assert sorted(r.currency for r in out.collect()) == ["EUR", "USD"]


def test_measures_only_one_row_even_when_empty(t):
    out = _v(t, dimensions=[], measures=[{"field_id": ID("amount"), "aggregations": ["count", "sum"]}],
             filters={"op": "and", "conditions": [{"field_id": ID("currency"), "operator": "=", "value": "GBP"}]})
    assert [tuple(r) for r in out.collect()] == [(0, None)]


def test_measure_without_aggregations_skipped(t):
    out = _v(t, dimensions=[{"field_id": ID("currency")}], measures=[{"field_id": ID("amount"), "aggregations": []}])
    assert out.columns == ["currency"]


def test_filter_tree_and_empty_groups(t):
    f = {"op": "or", "conditions": [
        {"op": "and", "conditions": [{"field_id": ID("currency"), "operator": "=", "value": "USD"},
                                     {"field_id": ID("line_number"), "operator": ">", "value": 1}]},
        {"field_id": ID("amount"), "operator": "is null"},
        {"op": "and", "conditions": []}]}
    out = _v(t, dimensions=[], filters=f)
    assert sorted(r.document_number for r in out.collect()) == ["D2", "D4"]
    assert _v(t, dimensions=[], filters={"op": "and", "conditions": []}).count() == 5


def test_in_not_in_and_literal_typing(t):
    f = {"op": "and", "conditions": [{"field_id": ID("line_number"), "operator": "in", "value": ["1", 3]},
                                     {"field_id": ID("document_number"), "operator": "not in", "value": ["D1"]}]}
    out = _v(t, dimensions=[], filters=f)
    assert sorted(r.document_number for r in out.collect()) == ["D3", "D4", "D5"]


def test_not_in_with_null_yields_nothing(t):
    f = {"op": "and", "conditions": [{"field_id": ID("amount"), "operator": "not in", "value": [1.0, None]}]}
    assert _v(t, dimensions=[], filters=f).count() == 0


def test_permissions(t):
    with pytest.raises(ViewError, match="measure role"):
        _v(t, measures=[{"field_id": ID("document_number"), "aggregations": ["count"]}], dimensions=[])
    with pytest.raises(ViewError, match="not allowed"):
        _v(t, dimensions=[], filters={"op": "and", "conditions": [
            {"field_id": ID("currency"), "operator": ">", "value": "A"}]})
    with pytest.raises(ViewError, match="dimension role"):
        _v(t, dimensions=[{"field_id": ID("debit_amount")}])
    with pytest.raises(UnknownFieldError):
        _v(t, dimensions=[{"field_id": "00000000-0000-0000-0000-000000000000"}])
    with pytest.raises(ViewError):
        ViewSpec.from_dict({"dimensions": [], "measures": [{"field_id": ID("amount"), "aggregations": ["median"]}]})


def test_sort_and_page_total_order(t):
    out = _v(t, dimensions=[{"field_id": ID("document_number")}],
             measures=[{"field_id": ID("amount"), "aggregations": ["sum"]}],
             sorting=[{"field_id": ID("amount"), "sorting_direction": "desc"}],
             pagination={"limit": 2, "offset": 1})
    # sums: D1 100, D5 100, D3 30, D2 -50, D4 null (nulls last); ties broken by the group key
    assert [r.document_number for r in out.collect()] == ["D5", "D3"]


def test_pivot_with_total(t):
    out = _v(t, dimensions=[{"field_id": ID("journal_type"), "axis": "row"},
                            {"field_id": ID("currency"), "axis": "column"}],
             measures=[{"field_id": ID("amount"), "aggregations": ["sum", "count"]}],
             pivot=True, pivot_values={ID("currency"): ["USD", "EUR", "GBP"]}, pivot_total=True)
    assert out.columns == ["journal_type", "USD_amount_sum", "USD_amount_count", "EUR_amount_sum",
                           "EUR_amount_count", "GBP_amount_sum", "GBP_amount_count",
                           "total_amount_sum", "total_amount_count"]
    m = {r.journal_type: r for r in out.collect()}
    assert (m["Manual"].USD_amount_sum, m["Manual"].GBP_amount_count, m["Manual"].total_amount_sum) == (200.0, 0, 230.0)


def test_pivot_values_discovered(t):
    out = _v(t, dimensions=[{"field_id": ID("journal_type")}, {"field_id": ID("currency"), "axis": "column"}],
             measures=[{"field_id": ID("amount"), "aggregations": ["count"]}], pivot=True)
    assert out.columns == ["journal_type", "EUR_amount_count", "USD_amount_count"]


def test_column_axis_without_pivot_is_grouped(t):
    out = _v(t, dimensions=[{"field_id": ID("journal_type")}, {"field_id": ID("currency"), "axis": "column"}],
             measures=[{"field_id": ID("amount"), "aggregations": ["count"]}])
    assert out.count() == 4


def test_signature_canonical():
    a = ViewSpec.from_dict({
        "dimensions": [{"field_id": ID("currency"), "axis": "row"}, {"field_id": ID("journal_type"), "axis": "row"}],
        "measures": [{"field_id": ID("amount"), "aggregations": ["sum", "avg"]}],
        "filters": {"op": "and", "conditions": [
            {"field_id": ID("currency"), "operator": "in", "value": ["USD", "EUR"]},
            {"field_id": ID("amount"), "operator": ">", "value": 5}]},
        "sorting": [{"field_id": ID("amount"), "sorting_direction": "desc"}],
        "pagination": {"limit": 10, "offset": 0}})
    b = ViewSpec.from_dict({
        "dimensions": [{"field_id": ID("journal_type"), "axis": "row"}, {"field_id": ID("currency"), "axis": "row"}],
        "measures": [{"field_id": ID("amount"), "aggregations": ["avg", "sum"]}],
        "filters": {"op": "and", "conditions": [
            {"field_id": ID("amount"), "operator": ">", "value": 5},
            {"field_id": ID("currency"), "operator": "in", "value": ["EUR", "USD"]}]}})
    assert a.signature("ds") == b.signature("ds")
    assert a.signature("ds") != a.signature("other")
    assert len(a.signature("ds")) == 64


def test_initial_view_signature_is_stable():
    import hashlib
    import json
    payload = {"dataset_id": "x", "filters": None, "dimensions": [], "measures": []}
    expect = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert ViewSpec().signature("x") == expect


def test_derived_field_filters(spark):
    df = spark.createDataFrame([(True, 6, 10.0), (False, 7, 5.0), (True, 1, 1.0)],
                               "has_description boolean, posting_weekday int, amount double")
    out = compile_view(df, {"dimensions": [{"field_id": ID("posting_weekday")}],
                            "measures": [{"field_id": ID("amount"), "aggregations": ["sum"]}],
                            "filters": {"op": "and", "conditions": [
                                {"field_id": ID("has_description"), "operator": "=", "value": "true"},
                                {"field_id": ID("posting_weekday"), "operator": "in", "value": [6, 7]}]}})
    assert [tuple(r) for r in out.collect()] == [(6, 10.0)]
    with pytest.raises(ViewError, match="does not fit"):
        compile_view(df, {"dimensions": [], "filters": {"op": "and", "conditions": [
            {"field_id": ID("has_description"), "operator": "=", "value": "maybe"}]}})


def test_exact_money_is_order_independent(spark):
    import random
    rnd = random.Random(7)
    vals = [round(rnd.uniform(-1e6, 1e6), 2) for _ in range(2000)] + [1e15, -1e15, 0.01]
    df = spark.createDataFrame([(v,) for v in vals], "amount double")
    spec = {"dimensions": [], "measures": [{"field_id": ID("amount"), "aggregations": ["sum", "avg", "count"]}]}
    a = compile_view(df.repartition(7), spec, exact_money=True).first()
    b = compile_view(df.orderBy(F.rand(3)).repartition(3), spec, exact_money=True).first()
    import decimal
    exact = float(sum(decimal.Decimal(str(v)) for v in vals))
    assert a.amount_sum == b.amount_sum == exact
    assert a.amount_count == len(vals)
    assert compile_view(df, spec).columns == ["amount_sum", "amount_avg", "amount_count"]


def test_deep_page(spark):
    df = (spark.range(5000).repartition(6)
          .selectExpr("cast(id % 97 as double) as amount", "concat('D', cast(id as string)) as document_number"))
    spec = {"dimensions": [], "sorting": [{"field_id": ID("amount"), "sorting_direction": "desc"}],
            "pagination": {"limit": 40, "offset": 2500}}
    rows = sorted(((r.amount, r.document_number) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert [tuple(r) for r in compile_view(df, spec).collect()] == rows[2500:2540]
    spec["pagination"] = {"limit": 200_000, "offset": 4990}          # past the end
    assert compile_view(df, spec).count() == 10


def test_page_of_measures_only(t):
    out = _v(t, dimensions=[], measures=[{"field_id": ID("amount"), "aggregations": ["count"]}],
             pagination={"limit": 5, "offset": 0})
    assert out.count() == 1


def test_aggregation_listed_twice_counts_once(t):
    out = _v(t, dimensions=[{"field_id": ID("currency")}],
             measures=[{"field_id": ID("amount"), "aggregations": ["sum", "sum"]}, {"field_id": ID("amount"), "aggregations": ["sum", "max"]}],
             sorting=[{"field_id": ID("amount"), "sorting_direction": "desc"}])
    assert out.columns == ["currency", "amount_sum", "amount_max"] and out.count() == 2


def test_sort_by_named_aggregation(t):
    view = {"dimensions": [{"field_id": ID("currency")}], "measures": [{"field_id": ID("amount"), "aggregations": ["sum", "count"]}]}
    by = lambda agg: [r.amount_count for r in _v(t, **view, sorting=[       # noqa: E731
        {"field_id": ID("amount"), "sorting_direction": "asc", "aggregation": agg}]).collect()]
    assert by("count") == sorted(by("count"))
    with pytest.raises(ViewError):
        by("max")


def test_pivot_keeps_rows_without_a_value(spark):
    df = spark.createDataFrame([("A", "USD", 1.0), ("A", None, 2.0), ("B", None, 4.0)], "journal_type string, currency string, amount double")
    view = {"dimensions": [{"field_id": ID("journal_type")}, {"field_id": ID("currency"), "axis": "column"}],
            "measures": [{"field_id": ID("amount"), "aggregations": ["sum"]}], "pivot": True, "pivot_total": True,
            "sorting": [{"field_id": ID("amount"), "sorting_direction": "desc"}]}
    out = compile_view(df, view)
    assert out.columns == ["journal_type", "USD_amount_sum", "null_amount_sum", "total_amount_sum"]
    assert [tuple(r) for r in out.collect()] == [("B", None, 4.0, 4.0), ("A", 1.0, 2.0, 3.0)]
    with pytest.raises(ViewError, match="pivot_limit"):
        compile_view(df, {**view, "pivot_limit": 1})


def test_integer_filter_beyond_the_column_type(spark):
    df = spark.createDataFrame([(2024,)], "posting_year int")
    for value, n in ((3_000_000_000, 1), (10**30, 1), (-10**30, 0)):
        spec = {"dimensions": [], "filters": {"op": "and", "conditions": [{"field_id": "posting_year", "operator": "<", "value": value}]}}
        assert compile_view(df, spec).count() == n


def test_exact_money_scale_and_limits(spark):
    spec = {"dimensions": [], "measures": [{"field_id": ID("amount"), "aggregations": ["sum"]}]}
    tiny = spark.createDataFrame([(4e-7,), (4e-7,)], "amount double")
    assert compile_view(tiny, spec, exact_money=True, money_scale=10).first()[0] == 8e-7
    with pytest.raises(Exception, match="digits before"):
        compile_view(spark.createDataFrame([(1e33,)], "amount double"), spec, exact_money=True).collect()


def test_signature_tells_pivots_apart():
    base = {"dimensions": [{"field_id": ID("currency"), "axis": "column"}], "measures": [{"field_id": ID("amount"), "aggregations": ["sum"]}]}
    specs = [base, {**base, "pivot": True}, {**base, "pivot": True, "pivot_total": True},
             {**base, "pivot": True, "pivot_values": {ID("currency"): ["USD"]}}]
    assert len({ViewSpec.from_dict(s).signature("d") for s in specs}) == 4
    for s in specs:
        again = ViewSpec.from_dict(ViewSpec.from_dict(s).to_dict())
        assert again.signature("d") == ViewSpec.from_dict(s).signature("d")


def test_signature_of_a_list_with_null():
    def spec(values):
        return ViewSpec.from_dict({"dimensions": [], "filters": {"op": "and", "conditions": [
            {"field_id": ID("currency"), "operator": "in", "value": values}]}})
    assert spec(["USD", None, "EUR"]).signature("d") == spec([None, "EUR", "USD"]).signature("d")
