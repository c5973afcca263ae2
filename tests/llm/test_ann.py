import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v int"


def brute(rows, is_query, k=5):
    ok = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None for x in v) or not len(v):
            continue
        a = np.array(v, dtype=np.float32).astype(float)
        if np.isfinite(a).all() and a.any():
            ok[i] = a
    out = {}
    for q in (i for i in ok if is_query(i)):
        near = sorted((-(ok[q] @ a) / np.sqrt((ok[q] @ ok[q]) * (a @ a)), i) for i, a in ok.items()
                      if i != q and len(a) == len(ok[q]))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df, k=5, **kw):
    out = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % 10 == 0, k=k, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 64))
    rows = [(i, (centres[i % 8] + 1.3 * rng.normal(size=64)).astype(np.float32).tolist(), 0, "x", 1) for i in range(1500)]
    got = found(spark.createDataFrame(rows, SCHEMA), block_rows=50)
    want = brute(rows, lambda i: i % 10 == 0)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(len(v) for v in want.values())
    exact = {(q, i): s for q in want for i, s in want[q]}
    for q, pairs in got.items():
        assert len({i for i, _ in pairs}) == 5 and [s for _, s in pairs] == sorted((s for _, s in pairs), reverse=True)
        assert all(abs(exact[q, i] - s) < 1e-12 for i, s in pairs if (q, i) in exact)


def test_all_axes_probed_is_exact_with_ties_and_faults(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), 0, "x", 1) for i in range(1, 60)]
    same = [1.0] * 8
    rows += [(i, same, 0, "x", 1) for i in range(100, 130)]                     # one vector many times
    rows += [(200, None, 0, "x", 1), (210, [], 0, "x", 1), (220, [0.0] * 8, 0, "x", 1), (230, [float("nan")] + [1.0] * 7, 0, "x", 1),
             (240, [None] + [1.0] * 7, 0, "x", 1), (250, [float("inf")] + [1.0] * 7, 0, "x", 1), (None, same, 0, "x", 1),
             (260, [1.0, 2.0], 0, "x", 1), (261, [2.0, 2.0], 0, "x", 1), (10, rows[9][1], 0, "x", 1)]
    got = found(spark.createDataFrame(rows, SCHEMA), probes=16, tables=1, block_rows=7)
    want = brute(rows, lambda i: i % 10 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}


def test_all_candidates_if_there_are_few(spark):
    rng = np.random.default_rng(7)
    rows = [(10 * i, rng.normal(size=64).tolist(), 0, "x", 1) for i in range(4)]
    rows += [(100 + 10 * i, rng.normal(size=32).tolist(), 0, "x", 1) for i in range(2)]           # another, rarer length
    rows += [(1000 + i, rng.normal(size=16).tolist(), 0, "x", 1) for i in range(40)] + [(5000, [1.0] * 5, 0, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("d", "t", "axis", "block", "n", "rank", "ids", "query_id", "others", "near"):
        df = df.withColumn(name, F.lit("x"))
    got = found(df)
    want = brute(rows, lambda i: i % 10 == 0)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items() if v}
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in (0, 10, 20, 30, 100, 110))


def test_near_ties_rank_by_the_exact_score(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=24)
    rows = [(i, (base * rng.uniform(0.1, 9.0)).astype(np.float32).tolist(), 0, "x", 1) for i in range(60)]      # parallel but for rounding
    rows += [(100 + i, (base * 2.0 ** -i).astype(np.float32).tolist(), 0, "x", 1) for i in range(9)]

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total = total + x * y
        return total

    v = {i: [float(np.float32(x)) for x in r] for i, r, *_ in rows}
    for q, pairs in found(spark.createDataFrame(rows, SCHEMA), block_rows=9).items():
        scored = sorted((-(dot(v[q], v[i]) / (np.sqrt(dot(v[q], v[q])) * np.sqrt(dot(v[i], v[i])))), i) for i in v if i != q)
        assert pairs == [(i, -s) for s, i in scored[:5]]


def test_empty_table(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(20, 48))
    y = ann.rotate(x, ann.rotations(48, 1)[0])
    assert y.shape == (20, 64) and np.allclose((x * x).sum(1), (y * y).sum(1))
