import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import divergence as D

SCHEMA = "doc_id bigint, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_force(rows, min_docs=10, top=10):
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]
        groups[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= min_docs]
        own = {s: {t: c[t] for t in kept} for (l, s), c in groups.items() if l == lang}
        total = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(counts):
            n = sum(counts.values())
            return {t: 1 + 10 ** 9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: shares(c) for s, c in own.items()}
        q = shares(total)
        for s in own:
            found = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(found)}
            found = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(found)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=300, langs=("en", "fr", None), sources=7, words=60):
    rng = np.random.default_rng(seed)
    vocabulary = [w for i in range(words) for w in (f"w{chr(97 + i % 26)}{chr(97 + i // 26)}", f"É{chr(97 + i % 26)}ß")][:words] + ["ſ", "\U0001F600", "Ab"]
    rows = []
    for i in range(n):
        s = int(rng.integers(0, sources))
        weights = np.roll(1.0 / np.arange(1, len(vocabulary) + 1), 3 * s)
        text = " ".join(rng.choice(vocabulary, size=int(rng.integers(0, 40)), p=weights / weights.sum()))
        rows.append((i, text if i % 41 else None, langs[i % len(langs)], f"s{s}" if s else None))
    return rows


@pytest.mark.parametrize("seed,tile,block", [(1, 64, 4096), (2, 2, 8)])
def test_equals_brute_force(spark, monkeypatch, seed, tile, block):
    monkeypatch.setattr(D, "TILE", tile)                     # several tiles and blocks of terms
    monkeypatch.setattr(D, "TERM_BLOCK", block)
    rows = corpus(seed) + [(900, "only here", "it", "a"), (901, "", "it", "b"), (902, "x", "pt", "one")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("term", "n", "docs", "p", "q", "tile", "block", "rank", "value", "item", "part"):
        df = df.withColumn(name, F.lit(1))
    want = brute_force(rows)
    assert got(D.source_divergence(df)) == want
    assert {r[2] for r in want} == {"pair", "term"} and ("it", "a", "pair", "b", 0, 1) in want


def test_empty_table_and_all_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(D.source_divergence(empty)) == set()
    nulls = spark.createDataFrame([(None, None, None, None)] * 3 + [(None, None, None, "b")], SCHEMA)
    assert got(D.source_divergence(nulls)) == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}


def test_skyband_keeps_what_fewer_than_k_dominate():
    rng = np.random.default_rng(5)
    for n, k in ((700, 3), (900, 10), (0, 5), (4, 5)):
        high, low, place = rng.integers(0, 12, n), rng.integers(0, 12, n), rng.permutation(n)
        dominated = ((high[None] >= high[:, None]) & (low[None] <= low[:, None]) & (place[None] < place[:, None])).sum(axis=1)
        assert set(D.skyband(high, low, place, k)) == set(np.nonzero(dominated < k)[0])


def test_slices_of_long_texts(monkeypatch):
    text = ("Aé9b " * 50 + "z" * 100 + " end").encode()
    whole = [t for s in D.slices(text) for t in s]
    monkeypatch.setattr(D, "_SLICE", 16)
    assert [t for s in D.slices(text) for t in s] == whole
    assert [t for s in D.slices(b"x" * 40) for t in s] == [b"x" * 40]
    assert b"A\xc3\xa9".lower() == "aé".encode()


def test_counts_of_a_large_corpus_are_exact(spark):
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "total", "kept")])
    rows = [(9 * 10 ** 14, 10 ** 15, 10 ** 7), (1, 3, 1), (0, 0, 0), (7, 10 ** 18, 5)]
    found = [r[0] for r in spark.createDataFrame(rows, schema).select(D.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert found == [1 + 10 ** 9 * (n + 2) // (t + 2 * k) if t + 2 * k else None for n, t, k in rows]
