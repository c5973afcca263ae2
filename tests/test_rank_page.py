import math
import random
from datetime import date, timedelta

import pytest

from ledgerlens.operators import rank_page as R

SCHEMA = "a double, b string, c date, d boolean, id bigint"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    amounts = [None, 0.0, -1.5, float("nan"), 7.25] + [rng.uniform(-9, 9) for _ in range(200)]
    return [(rng.choice(amounts), rng.choice(["x", "y", None, "", "É"]), date(2024, 1, 1) + timedelta(days=rng.randrange(40)) if rng.random() < 0.9 else None,
             rng.choice([True, False, None]), i) for i in range(3000)] + [(7.25, "hot", None, True, 3000 + i) for i in range(1500)]


def _sorted(rows, keys):
    at = {"a": 0, "b": 1, "c": 2, "d": 3, "id": 4}
    rank = lambda v: (1, v) if not isinstance(v, float) else (2, 0.0) if math.isnan(v) else (1, v)
    out = list(rows)
    for name, up in reversed(keys):
        known = [r for r in out if r[at[name]] is not None]
        known.sort(key=lambda r: rank(r[at[name]] if not isinstance(r[at[name]], str) else r[at[name]].encode()), reverse=not up)
        out = known + [r for r in out if r[at[name]] is None]
    return out


@pytest.mark.parametrize("keys", [[("a", True), ("id", True)], [("a", False), ("b", True), ("id", False)],
                                  [("c", True), ("d", False), ("b", False), ("id", True)], [("d", True), ("a", True), ("id", True)]])
def test_pages_equal_a_full_sort(spark, rows, keys):
    df = spark.createDataFrame(rows, SCHEMA)
    want = [r[4] for r in _sorted(rows, keys)]
    for offset, limit in ((0, 7), (1490, 40), (3600, 30), (4480, 100)):
        got = R.page(df, keys, offset, limit, deep_offset=1, page_rows=50)
        assert [r["id"] for r in got.collect()] == want[offset:offset + limit], (offset, limit)


def test_few_rows_are_sorted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for keys, offset in (([("a", True), ("id", True)], 2000), ([("b", True), ("c", True), ("id", True)], 2000),
                         ([("d", False), ("id", True)], sum(r[3] is True for r in rows) - 10)):      # over the border of two common values
        found = R.parts(df, keys, offset, 20, len(rows), 100)
        assert sum(limit for *_, limit in found) == 20
        assert all(before + limit <= near.count() <= 100 for near, before, limit in found)


def test_ends(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert R.page(df, [("id", True)], 4500, 5, deep_offset=1, page_rows=10).collect() == []
    assert R.page(df, [("id", True)], 10 ** 9, 5).collect() == []
    assert R.page(df.where("false"), [("id", True)], 20_000, 5).collect() == []
    assert [r["id"] for r in R.page(df, [("id", False)], 4498, 5, deep_offset=1, page_rows=1).collect()] == [1, 0]
    same = spark.createDataFrame([(1.0, "x", None, None, 1)] * 300, SCHEMA)
    assert R.page(same, [("a", True), ("id", True)], 200, 7, deep_offset=1, page_rows=10).count() == 7
