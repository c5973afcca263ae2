import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import language_id as L

SCHEMA = "doc_id bigint, text string, lang string, source string"
ALPHABETS = {"aa": "abcdefgh", "ab": "abcdefgi", "xx": "qrstuvwx", "xy": "qrstuvwz", "zz": "жзиклмно"}


def invented(n, seed, names=tuple(ALPHABETS)):
    """Two families of two close languages and one apart: close ones share seven of eight letters."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = names[i % len(names)]
        words = ["".join(rng.choice(list(ALPHABETS[lang]), size=rng.integers(2, 7))) for _ in range(rng.integers(8, 30))]
        rows.append((i, " ".join(words), lang, "s"))
    return rows


def test_families_and_held_out_accuracy(spark):
    rows = invented(600, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    model = L.fit(df, F.col("doc_id") < 400)
    assert sorted([model.languages[i] for i in g] for g in model.families) == [["aa", "ab"], ["xx", "xy"], ["zz"]]
    assert len(model.machines) == 2
    found = {r["doc_id"]: r for r in L.languages(df).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert np.mean([found[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_held_out_languages_are_not_learned(spark):
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "secret", s) for i, t, lang, s in invented(200, 2)]
    found = L.languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["lang_pred"] for r in found} <= set(ALPHABETS)


def test_same_model_in_any_order_and_with_copies(spark):
    rows = invented(120, 3)
    a = L.fit(spark.createDataFrame(rows, SCHEMA), F.lit(True), rows=15)
    b = L.fit(spark.createDataFrame(rows[::-1] + rows[:40], SCHEMA).repartition(5), F.lit(True), rows=15)
    assert a.languages == b.languages and a.families == b.families
    assert np.array_equal(a.likelihoods, b.likelihoods)
    assert all(np.array_equal(w, b.machines[k][0]) and bias == b.machines[k][1] for k, (w, bias) in a.machines.items())


def test_pieces_of_long_texts(monkeypatch):
    text = "Straße und café, 12 Dörfer; " * 40
    whole = L.grams(text)
    monkeypatch.setattr(L, "_PIECE", 64)
    assert np.array_equal(L.grams(text), whole)
    assert len(L.grams("")) == 0 and len(L.grams("a")) > 0 and list(L.grams("ABC")) == list(L.grams("abc"))


def test_machine_separates():
    rows = [np.array([1, 2, 5]), np.array([1, 3]), np.array([2, 7]), np.array([4, 8]), np.array([4, 9, 8])]
    y = np.array([1, 1, 1, -1, -1.0])
    w, bias = L.pair_machine(rows, y)
    assert all(s * (w[r].sum() / np.sqrt(len(r)) + bias) > 0 for r, s in zip(rows, y))


def test_faulty_rows(spark):
    rows = invented(60, 4, ("aa", "zz")) + [(100, None, "aa", "s"), (101, "", "aa", "s"), (102, "12 ,.!", "zz", "s"), (None, "abc hgf", None, None),
                                           (103, "жзик", None, "s"), (103, "жзик", None, "s"), (104, "abcd " * 100_000, "aa", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("h", "nr", "score", "found", "grams", "lettered", "held_out", "lang_pred", "y", "a"):
        df = df.withColumn(name, F.lit("x"))
    found = L.languages(df)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(rows)
    assert {r[2:] for r in got if r[0] in (100, 101, 102)} == {("und", 0.0)}
    assert {r[2] for r in got if r[0] == 103} == {"zz"} and {r[2] for r in got if r[0] in (None, 104)} == {"aa"}
    assert L.languages(df.where("false")).collect() == []
    assert {r[2] for r in map(tuple, L.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect())} == {"und"}
    assert {r["lang_pred"] for r in L.languages(df.where("lang = 'aa' and doc_id < 60")).collect()} == {"aa"}
