import random
import re
from collections import defaultdict

import pytest

from ledgerlens.llm.mixing import mixture, source_targets


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; what exceeds a cap is shared again until none does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            target.update({s: left * w[s] / total for s in open_})
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            open_.remove(s)
        left -= sum(target[s] for s in over)
    return target


@pytest.mark.parametrize("seed", range(5))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 500, 100_000]) for i in range(rng.randint(1, 9))}
    sizes[None], sizes["é"], sizes["Z"] = 7, 30, 30
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def make(seed=0, n=300):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.randint(0, 60))) + rng.choice(["", " !!!! %%%%"]),
             rng.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(n)]


def test_words_taken(spark, docs_of):
    docs = make()
    rows = mixture(docs_of(docs)).collect()
    assert sorted(r.doc_id for r in rows) == [d for d, *_ in docs]
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by_id = {d: (t, s) for d, t, s in docs}
    for r in rows:
        assert r["size"] == words(by_id[r.doc_id][0]) and r.source == by_id[r.doc_id][1]
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.epochs * r["size"] + r.extra
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 0.5
        # complete epochs precede the fractional selection; at most one document is cut
        assert sum(0 < r.extra < r["size"] for r in rows if r.source == s) <= 1


def test_reruns_and_row_order_agree(spark, docs_of):
    docs = make(1, 120)
    first = sorted((r.doc_id, r.taken) for r in mixture(docs_of(docs)).collect())
    again = sorted((r.doc_id, r.taken) for r in mixture(docs_of(docs[::-1]).repartition(5)).collect())
    assert first == again


def test_weights_favour_better_documents(spark, docs_of):
    docs = [(i, "w " * 10 + ("good" if i % 2 else "!!!! %%%% $$$$ ####"), s) for s in "ab" for i in range(2000)]
    docs = [(i, t, s) for i, (_, t, s) in enumerate(docs)]
    rows = mixture(docs_of(docs)).where("source = 'b'").collect()          # b gets less than one epoch
    good = sum(r.taken > 0 for r in rows if r.doc_id % 2)
    assert good > 1.5 * sum(r.taken > 0 for r in rows if not r.doc_id % 2)


def test_edge_cases(spark, docs_of):
    docs = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "x y z", "b"), (5, "x y z", "b"), (5, "x y z", "b"),
            (6, "long " * 30_000, "c")]
    rows = mixture(docs_of(docs)).collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 0, 3, 3, 3, 30_000]
    assert sum(r.taken for r in rows) == 30_009
    assert {r.source: r.target for r in rows}["a"] == 0.0
    assert mixture(docs_of([])).collect() == []
    assert [r.taken for r in mixture(docs_of([(1, None, "a")])).collect()] == [0]


def test_no_python_in_the_plan(spark, docs_of):
    plan = mixture(docs_of(make(2, 5)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
