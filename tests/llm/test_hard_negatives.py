import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows, k=5, low=80, high=100, every=10):
    """Rows by the definition, in whole numbers."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        kept[i] = min(kept.get(i, (label, w)), (label, w))
    out = set()
    for a, (mine, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, label) for i, (label, w) in kept.items() if i != a and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2] == mine][:k]:
            near = [(n, nid) for n, nid, label in scored if label != mine and low * -p <= 100 * -n <= high * -p]
            out |= {(a, pid, r + 1, nid, -p, -n) for r, (n, nid) in enumerate(near[:k])}
    return out


def got(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


@pytest.mark.parametrize("dims,bits", [(1, 3), (2, 3), (3, 2), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = H.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(3)
    rows, anchors = rng.integers(-90, 90, (200, 7)).astype(float), rng.integers(-90, 90, (20, 7)).astype(float)
    lower, upper = H.product_bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    exact = anchors @ rows.T
    assert (lower <= exact).all() and (exact <= upper).all()


def test_products_beyond_doubles_are_exact():
    a = np.array([[2.0 ** 31 + 1, 3.0]])
    assert H.products(a, a)[0, 0] == (2 ** 31 + 1) ** 2 + 9
    assert H.products(np.array([[2.0 ** 40]]), np.array([[-2.0 ** 40]]))[0, 0] == -(2 ** 63 - 1)


@pytest.mark.parametrize("clusters", [0, 6])
def test_equals_brute_force(spark, clusters, monkeypatch):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(0, 1, (max(1, clusters), 8))
    rows = []
    for i in range(400):
        v = (centres[i % clusters] + rng.normal(0, 0.1, 8)) if clusters else rng.normal(0, 1, 8)
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 4))))
    rows += [(400 + i, [0.5] * 8, i % 3) for i in range(60)]                 # one vector many times: ties by id
    rows += [(900 + i, [0.25, -0.5], i % 2) for i in range(12)]              # another length
    monkeypatch.setattr(H, "ZONE_PAGE", 3)                                   # several sheets and teams
    monkeypatch.setattr(H, "ANCHOR_GROUP", 10)
    found = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, block_rows=16, blocks_per_file=2)
    assert got(found) == brute_force(rows)


def test_zone_maps_leave_blocks_unread(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = 4 * np.eye(8)
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(0, 0.05, 8)], i % 5) for i in range(800)]
    blocks = H.write_blocks(H.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding"), str(tmp_path / "blocks"), 16, 2)
    zones = H.zone_maps(blocks)
    anchors = blocks.where("vec_id % 40 = 0").selectExpr(
        "vec_id AS anchor_id", "label", "d", "v", "0 AS team", "-1L AS read", "cast('-inf' as double) AS least",
        "cast(null as array<bigint>) AS positive_ids", "array(1048576L) AS positive_scores")
    chosen = H.choose(anchors, zones, "negatives", 80, 100).count()
    assert 0 < chosen < 0.4 * anchors.count() * zones.count()


def test_faulty_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.85, 0.0], 2), (2, [0.85, 0.0], 2), (10, [1.0, 0.0], None),
            (20, None, 1), (30, [None, 1.0], 1), (40, [float("nan"), 1.0], 1), (50, [float("inf"), 0.0], 2), (None, [1.0, 0.0], 2),
            (60, [], 1), (70, [0.0, 0.0], 2), (80, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("block", "page", "team", "anchor_id", "score", "x", "d", "place"):
        df = df.withColumn(name, F.lit("x"))
    assert got(H.hard_negatives(df, F.col("vec_id") % 10 == 0)) == brute_force(rows) != set()
    assert got(H.hard_negatives(df.where("false"), F.col("vec_id") % 10 == 0)) == set()
    assert got(H.hard_negatives(df.where("vec_id = 0"), F.col("vec_id") % 10 == 0)) == set()
