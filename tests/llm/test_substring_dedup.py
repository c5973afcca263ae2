import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import substring_dedup as sd
from ledgerlens.llm.substring_dedup import remove_repeats


def brute(docs, span=20):
    """docs: (doc_id, text), ids distinct."""
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first, gone = {}, {d: set() for d in split}
    for d in sorted(split, key=lambda x: (x is None, x)):
        w = split[d]
        for s in range(len(w) - span + 1):
            key = tuple(w[s:s + span])
            if key in first:
                gone[d] |= set(range(s, s + span))
            else:
                first[key] = (d, s)
    return sorted([(d, len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d]))
                   for d, w in split.items()], key=str)


def run(df, **options):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, **options).collect()], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_agree_with_brute_force(spark, docs_of, seed):
    rng = random.Random(seed)
    passages = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (18, 19, 20, 21, 26, 33, 60)]
    docs = []
    for i in rng.sample(range(1000), 40):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            words += p[a:] + [f"u{rng.random()}" for _ in range(rng.randint(0, 17))]
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    docs.append((2000, "same " * 70))
    assert run(docs_of(docs)) == brute(docs)


def test_edge_cases(spark, docs_of):
    twenty = " ".join(f"x{i}" for i in range(20))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, twenty), (5, twenty), (None, twenty), (6, twenty.upper()),
            (7, "short text"), (8, "short text"), (9, "a b " * 25)]
    assert run(docs_of(docs)) == brute(docs)
    assert run(docs_of([])) == []


def test_repeated_rows_are_one_document(spark, docs_of):
    twenty = " ".join(f"x{i}" for i in range(20))
    assert run(docs_of([(4, twenty), (4, twenty)])) == [(4, 20, 0, twenty)] * 2
    assert run(docs_of([(4, twenty), (4, twenty), (3, twenty)])) == [(3, 20, 0, twenty), (4, 20, 20, ""), (4, 20, 20, "")]


def test_long_text(spark, docs_of):
    words = [f"w{i * 7919 % 50021}" for i in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[30_000:30_040]))]
    assert [r[:3] for r in run(docs_of(docs))] == [r[:3] for r in brute(docs)]
    assert run(docs_of(docs))[1][2] == 40


def test_cover_is_checked(spark, docs_of):
    with pytest.raises(ValueError):
        remove_repeats(docs_of([(1, "a")]), cover=(0, 1))
    with pytest.raises(ValueError):
        remove_repeats(docs_of([(1, "a")]), anchor=9)


def test_settled_rows_of_a_common_hash_leave_one():
    h = np.array([5, 6, 5, 6, 7, 5, 6, 5, 9], dtype=np.uint64)
    place, own = np.array([0, 1, 2, 3, 4, 0, 1, 5, 6]), np.arange(9, dtype=np.uint64) + np.uint64(1 << 20)
    rank = np.array([1, 1, 1, 1, 1, 2, 2, 2, 2])
    kept, (got, places) = sd.settle_anchors(h, place, own, rank)
    assert kept.tolist() == [0, 1, 2, 4, 5, 8]
    assert [x if x < 100 else x & 0xFFFF for x in got.tolist()] == [5, 6, 2, 7, 3, 9]      # runs of two and three
    assert [(bool(p & sd.SEEN), bool(p & sd.RUN)) for p in places.tolist()] == [
        (True, False), (True, False), (True, True), (False, False), (True, True), (False, False)]
    kept, (got, check, _) = sd.settle_windows(h, np.ones(9, np.int32), place, own, rank)
    assert kept.tolist() == [0, 1, 2, 4, 5, 7, 8] and check.tolist() == [1, 1, -2, 1, -2, -1, 1]
    assert [x for x in got.tolist() if x < 100] == [5, 6, 7, 9]


def test_windows_of_unequal_check_stay():
    h, own = np.array([5, 5], dtype=np.uint64), np.array([90, 91], dtype=np.uint64)
    kept, (got, check, _) = sd.settle_windows(h, np.array([1, 2], np.int32), np.array([0, 9]), own, np.array([1, 1]))
    assert kept.tolist() == [0, 1] and got.tolist() == [5, 5] and check.tolist() == [1, 2]


def test_the_same_place_twice_is_not_earlier():
    two = np.array([5, 5], dtype=np.uint64)
    check, same = np.array([1, 1], dtype=np.int32), np.array([4, 4])
    kept, (got, check, _) = sd.settle_windows(two, check, same, two + np.uint64(90), np.array([1, 1]))
    assert kept.tolist() == [0, 1] and got.tolist() == [5, 5] and check.tolist() == [1, 1]


def test_runs_are_split_at_the_longest_length():
    firsts, lengths = sd._runs(np.ones(7, bool), np.r_[False, np.ones(6, bool)], 3)
    assert firsts.tolist() == [0, 3, 6] and lengths.tolist() == [3, 3, 1]
    assert [len(x) for x in sd._runs(np.zeros(4, bool), np.zeros(4, bool), 3)] == [0, 0]


@pytest.mark.parametrize("rows", [1, 300, sd.COMBINED])
def test_common_passage_whatever_is_combined(spark, docs_of, rows):
    """A passage in a third of the rows, at one place and at many, ids as text."""
    rng = random.Random(rows)
    common = " ".join(f"c{i}" for i in range(25))
    docs = []
    for i in range(120):
        own = " ".join(f"d{i}x{j}" for j in range(rng.randint(0, 30)))
        docs.append((i, f"{common} {own}" if i % 3 == 0 else f"{own} {common} {common}" if i % 3 == 1 else own))
    want = brute(docs)
    assert run(docs_of(docs).repartition(5), combined=rows) == want
    named = docs_of(docs).withColumn("doc_id", F.format_string("%04d", "doc_id")).repartition(3)
    assert [r[1:] for r in run(named, combined=rows)] == [r[1:] for r in sorted(want)]
