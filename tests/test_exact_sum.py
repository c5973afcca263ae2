"""Sums of doubles against math.fsum, in any order and layout."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.registry import registry
from ledgerlens.operators.exact_sum import Bits, bits_of, exact_avg, exact_sum, exact_sums, used_bits
from ledgerlens.operators.view import ViewError, compile_view



def _bytes(x):
    return None if x is None else struct.pack(">d", x)


def _values(kind, n, rnd):
    if kind == "cents":
        return [round(rnd.uniform(-1e6, 1e6), 2) for _ in range(n)]
    if kind == "cancel":
        xs = [rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-8, 15) for _ in range(n)]
        return xs + [-x for x in xs] + [0.1]
    if kind == "wide":
        return [math.ldexp(rnd.uniform(-1, 1), rnd.randint(-1060, 1000)) for _ in range(n)]
    if kind == "tiny":
        return [5e-324 * rnd.randint(-9, 9) for _ in range(n)] + [2.2e-308, 5e-324]
    if kind == "ties":                      # 2^53 + 1 is a tie; lower bits decide it
        return [2.0 ** 53, 1.0, 2.0 ** -60, -2.0 ** -61]
    return [-2.0 ** 53, -1.0]


@pytest.mark.parametrize("kind", ["cents", "cancel", "wide", "tiny", "ties", "tie_to_even"])
def test_sum_is_the_rounded_exact_sum(spark, kind):
    rnd = random.Random(kind)
    rows = [(g, v) for g in range(3) for v in _values(kind, 400, rnd)]
    want = {g: math.fsum(v for h, v in rows if h == g) for g in range(3)}
    seen = set()
    for parts in (1, 7, 200) if kind == "cents" else (3,):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "g int, v double").repartition(parts)
        got = {r.g: r.s for r in exact_sums(df, ["g"], {"s": "v"}).collect()}
        assert got == want
        seen.add(tuple(_bytes(got[g]) for g in range(3)))
    assert len(seen) == 1


def test_overflow_only_on_the_way(spark):
    df = spark.createDataFrame([(1, 1e308), (1, 1e308), (1, -1e308), (2, 1.7e308), (2, 1.7e308)], "g int, v double").coalesce(1)
    assert {r.g: r.s for r in exact_sums(df, ["g"], {"s": "v"}).collect()} == {1: 1e308, 2: math.inf}


def test_nulls_and_values_that_are_no_numbers(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, None), (2, None), (2, 1.5), (3, inf), (3, 1.0), (4, inf), (4, -inf), (5, nan), (5, 2.0), (6, 0.0), (6, -0.0),
            (None, 2.5), (None, 0.25)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.s for r in exact_sums(df, ["g"], {"s": "v"}).collect()}
    assert got[1] is None and got[2] == 1.5 and got[3] == inf and math.isnan(got[4]) and math.isnan(got[5])
    assert got[6] == 0.0 and got[None] == 2.75
    assert exact_sums(df.limit(0), ["g"], {"s": "v"}).collect() == []
    assert exact_sums(df.limit(0), [], {"s": "v"}).first().s is None


def test_names_with_dots_and_floats(spark):
    df = spark.createDataFrame([(0.1,), (0.2,)], "`a.b` float").withColumn("s", F.lit(1))
    want = math.fsum(r[0] for r in df.select(F.col("`a.b`").cast("double")).collect())
    assert exact_sums(df, [], {"s": "a.b"}).first().s == want


def test_bits(spark):
    assert bits_of(0.01, 1e9) == Bits(-59, 30, True) and bits_of(0.01, 1e9).limbs == 5
    assert bits_of(None, None).limbs == 3
    assert bits_of(5e-324, 1.7e308) == Bits(-1074, 1024, True) and bits_of(1.0, math.inf) == Bits(-52, 1024)
    df = spark.createDataFrame([(0.01, 0.0), (1e9, None)], "a double, b double")
    assert used_bits(df, ["a", "b"]) == {"a": Bits(-59, 30, True), "b": bits_of(None, None)}


def test_avg(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (None,)], "v double")
    bits = used_bits(df, ["v"])["v"]
    row = df.agg(exact_avg(F.col("v"), bits).alias("a"), exact_sum(F.col("v"), bits).alias("s")).first()
    assert row.s == math.fsum([0.1, 0.2, 0.3]) and row.a == row.s / 3
    assert df.where("v is null").agg(exact_avg(F.col("v"), bits).alias("a")).first().a is None


def test_views_with_exact_sums(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["A", "B", None]), rnd.choice(["USD", "EUR"]), rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-3, 12)) for _ in range(900)]
    df = spark.createDataFrame(rows, "journal_type string, currency string, amount double")
    view = {"dimensions": [{"field_id": "journal_type"}],
            "measures": [{"field_id": "amount", "aggregations": ["sum", "avg", "count", "max"]}]}
    got = {r.journal_type: r for r in compile_view(df.repartition(9), view, exact_sums=True).collect()}
    for kind in ("A", "B", None):
        values = [v for t, _, v in rows if t == kind]
        assert got[kind].amount_sum == math.fsum(values) and got[kind].amount_avg == math.fsum(values) / len(values)
        assert got[kind].amount_count == len(values) and got[kind].amount_max == max(values)
    pivot = {"dimensions": [{"field_id": "journal_type"}, {"field_id": "currency", "axis": "column"}], "pivot": True,
             "pivot_total": True, "measures": [{"field_id": "amount", "aggregations": ["sum"]}],
             "filters": {"op": "and", "conditions": [{"field_id": "amount", "operator": ">", "value": 0}]}}
    for r in compile_view(df, pivot, exact_sums=True).collect():
        for cur in ("USD", "EUR"):
            assert r[f"{cur}_amount_sum"] == math.fsum(v for t, c, v in rows if t == r.journal_type and c == cur and v > 0)
        assert r.total_amount_sum == math.fsum(v for t, _, v in rows if t == r.journal_type and v > 0)
    with pytest.raises(ViewError, match="not both"):
        compile_view(df, view, exact_money=True, exact_sums=True)
