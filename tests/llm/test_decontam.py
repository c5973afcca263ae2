import random
import re

import pytest

from ledgerlens.llm.decontam import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), span)
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for win, ids in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {str(i) for i in ids if i is not None}
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def run(df, items):
    return sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in contamination(df, items).collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_agree_with_brute_force(spark, docs_of, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "cé", "D", "e1", "É"])          # noqa: E731
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 14, 25])))) for i in range(12)]
    docs = []
    for i in range(25):
        parts = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice(items)[1].split()
            a = rng.randint(0, len(t) - 1)
            parts += t[a:a + rng.choice([5, 9, 10, 12, 30])] + [word() for _ in range(rng.randint(0, 3))]
        docs.append((i, rng.choice([" ", ", ", "\n- "]).join(parts)))
    df = spark.createDataFrame(items, "item_id long, text string")
    assert run(docs_of(docs), df) == brute(docs, items)


def test_edge_cases(spark, docs_of):
    passage = "one two three four five six seven eight nine ten eleven"
    items = [(1, passage), (1, passage), (None, "Zulu yankee"), (3, None), (4, " .,; "), (5, "")]
    long = " ".join(["pad"] * 30_000) + " " + passage
    docs = [(1, None), (2, ""), (3, "... !"), (4, passage), (4, passage), (4, "zulu YANKEE x"), (None, passage), (5, long)]
    df = spark.createDataFrame(items, "item_id long, text string")
    assert run(docs_of(docs), df) == brute(docs, items)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(docs_of([(1, "a b")]), none) == [(1, 2, 0, ())]
    assert run(docs_of([]), none) == []


def test_shuffled_and_broadcast_joins_agree(spark, docs_of):
    items = [(1, "a b c d e f g h i j k l")]
    docs = [(i, "x a b c d e f g h i j y" if i % 2 else "x y") for i in range(6)]
    df = spark.createDataFrame(items, "item_id long, text string")
    out = contamination(docs_of(docs), df, broadcast_rows=0).select("doc_id", "n_hit").collect()
    assert sorted((r.doc_id, r.n_hit) for r in out) == [(i, 10 if i % 2 else 0) for i in range(6)]


def test_no_python_in_the_plan(spark, docs_of):
    df = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = contamination(docs_of([(1, "a b")]), df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
