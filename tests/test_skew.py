"""One key holding a third of all rows: results stay exact and whole, and
the plans combine map-side before any exchange."""
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.registry import registry
from ledgerlens.operators import catalog as C
from ledgerlens.operators.view import compile_view

ID = registry.id_of
N = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    # account ACC-HOT holds a third of the rows
    return (spark.range(N).repartition(8)
            .select(F.when(F.col("id") % 3 == 0, F.lit("ACC-HOT"))
                    .otherwise(F.concat(F.lit("ACC-"), (F.col("id") % 997).cast("string"))).alias("account_number"),
                    (F.col("id") % 100).cast("double").alias("amount"),
                    F.when(F.col("id") % 2 == 0, F.lit("D")).otherwise(F.lit("C")).alias("debit_credit_indicator")))


def test_hot_group_exact(spark, skewed):
    v = compile_view(skewed, {"dimensions": [{"field_id": ID("account_number")}],
                              "measures": [{"field_id": ID("amount"),
                                            "aggregations": ["count", "sum", "count_distinct"]}]})
    hot = v.where("account_number = 'ACC-HOT'").first()
    assert (hot.amount_count, hot.amount_count_distinct) == (N // 3, 100)
    assert hot.amount_sum == float(sum(i % 100 for i in range(0, N, 3)))
    assert v.agg(F.sum("amount_count")).first()[0] == N          # nothing dropped
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")    # partial below the exchange


def test_hot_pivot_exact(spark, skewed):
    v = compile_view(skewed, {"dimensions": [{"field_id": ID("account_number")},
                                             {"field_id": ID("debit_credit_indicator"), "axis": "column"}],
                              "measures": [{"field_id": ID("amount"), "aggregations": ["count"]}],
                              "pivot": True, "pivot_values": {ID("debit_credit_indicator"): ["D", "C"]}})
    hot = v.where("account_number = 'ACC-HOT'").first()
    assert hot.D_amount_count + hot.C_amount_count == N // 3


def test_hot_signature_in_catalog(spark):
    import datetime as dt
    rows = [(f"ds{i}", "HOT" if i % 3 == 0 else f"S{i % 50}", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i))
            for i in range(3000)]
    ds = spark.createDataFrame(rows, "dataset_id string, signature string, uploaded_at timestamp")
    saves = ds.select("dataset_id", F.create_map(F.lit("k"), F.col("dataset_id")).alias("mapping"),
                      (F.col("uploaded_at") + F.expr("INTERVAL 1 MINUTE")).alias("saved_at"))
    sig = {r.signature: r.mapping for r in C.signature_mappings(saves, ds).collect()}
    assert sig["HOT"] == {"k": "ds0"} and len(sig) == 51
    sug = C.suggested_mappings(ds, C.signature_mappings(saves, ds))
    assert sug.count() == 3000
    assert sug.where("dataset_id = 'ds3'").first().suggested_mapping == {"k": "ds0"}
