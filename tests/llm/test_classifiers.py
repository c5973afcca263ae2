import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality, toxicity
from ledgerlens.llm.common import fold, table
from ledgerlens.llm.labelled import training_sample

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, DATA, "documents"), table(spark, DATA, "labels")


def test_fold_is_crc32_of_the_id_as_text(spark):
    df = spark.createDataFrame([(7,), (123456,), (None,)], "d long").select("d", fold(F.col("d"), 5).alias("f"))
    assert [(r.d, r.f) for r in df.collect()] == [(d, zlib.crc32(str("" if d is None else d).encode()) % 5) for d in (7, 123456, None)]


def test_sample_is_bounded_repeatable_and_clean(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(50)] + [(3, "text 3"), (None, "x")])
    labels = spark.createDataFrame([(i, i % 10 == 0) for i in range(60)] + [(1, True), (None, True), (2, None)],
                                   "doc_id long, y boolean").selectExpr("doc_id", "CAST(y AS INT) AS quality")
    one = training_sample(docs, labels, "quality", F.lit(True), 12).collect()
    two = training_sample(docs.repartition(3), labels.repartition(4), "quality", F.lit(True), 12).collect()
    assert sorted(one) == sorted(two) and len(one) <= 12
    ids = [r.doc_id for r in one]
    assert len(ids) == len(set(ids)) and 1 not in ids and None not in ids
    assert {r.label for r in one} == {0, 1}
    assert training_sample(docs, labels.limit(0), "quality", F.lit(True), 12).collect() == []


def test_features_are_the_distinct_ngrams():
    def slow(text):
        b = text.encode()
        out = {quality._repeats(b)} if b else set()
        for n in quality.ORDERS:
            for i in range(len(b) - n + 1):
                out.add(int(quality._grams(np.frombuffer(b[i:i + n], dtype=np.uint8).astype(np.uint64), n)[0]))
        return out

    texts = ["", "a", "abc abc", "é!! é!!", "the the the the cat", "x" * 50]
    starts, flat = quality.features(texts)
    for i, t in enumerate(texts):
        got = flat[starts[i]:starts[i + 1]].tolist()
        assert len(got) == len(set(got)) and set(got) == slow(t)


def test_long_texts_have_the_same_features(monkeypatch):
    text = " ".join(f"w{i * 31 % 977}" for i in range(5000))
    whole = quality.features([text])[1]
    monkeypatch.setattr(quality, "_BLOCK", 1000)
    assert sorted(quality.features(["x", text, "y"])[1][quality.features(["x"])[0][1]:][:len(whole)]) == sorted(whole)


def test_dual_coordinate_descent_separates():
    starts, flat = np.arange(0, 9, 2), np.array([1, 2, 1, 3, 5, 6, 5, 7], dtype=np.int32)
    w, b = quality.dual_coordinate_descent(starts, flat, np.ones(8), np.array([1, 1, 0, 0]))
    margins = [w[flat[s:e]].sum() + b for s, e in zip(starts[:-1], starts[1:])]
    assert all(m > 0.9 for m in margins[:2]) and all(m < -0.9 for m in margins[2:])


def held_out_accuracy(scored, labels, label):
    r = (scored.join(labels.select("doc_id", label), "doc_id").where("held_out")
         .agg(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.count("*"),
              F.avg(F.when(F.col(label) == 0, F.col("predicted"))), F.avg(F.when(F.col(label) == 1, F.col("predicted"))))).first()
    return r


def test_quality_of_held_out_documents(tables):
    scored = quality.quality_scores(*tables).cache()
    accuracy, n, bad_kept, good_kept = held_out_accuracy(scored, tables[1], "quality")
    assert n > 50 and accuracy > 0.95 and good_kept > 0.97
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and scored.count() == tables[0].count()


def test_toxicity_of_held_out_documents(tables):
    scored = toxicity.toxicity_scores(*tables).cache()
    accuracy, n, clean_flagged, found = held_out_accuracy(scored, tables[1], "toxic")
    # 37 toxic documents to learn four languages from; check_s has 2,162 (see README)
    assert n > 50 and accuracy > 0.9 and found > 0.6 and clean_flagged < 0.03
    # spans of flagged documents point at words
    rows = scored.where("size(spans) > 0").join(tables[0], "doc_id").limit(20).collect()
    assert rows and all(r.text[s.start:s.end].strip() == r.text[s.start:s.end] != "" for r in rows for s in r.spans)


LABELLED = [(i, ("you are an idiot and scum " if i % 2 else "the day was fine and warm ") * 3 + f"word{i}") for i in range(80)]


def small_labels(spark, name):
    return spark.createDataFrame([(i, i % 2) for i in range(80)], f"doc_id long, {name} int")


@pytest.mark.parametrize("run, name", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_edge_cases(spark, docs_of, run, name):
    docs = docs_of(LABELLED + [(100, None), (101, ""), (102, " \n"), (None, "idiot"), (100, None), (103, "fine day " * 40_000)])
    rows = run(docs, small_labels(spark, name)).collect()
    assert len(rows) == 86 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    blank = {r.doc_id: r.score for r in rows}
    assert blank[100] == blank[101]
    none = run(docs, small_labels(spark, name).limit(0)).collect()
    assert len(none) == 86 and len({r.score for r in none}) == 1
    assert run(docs_of([]), small_labels(spark, name)).collect() == []


def test_labels_of_held_out_rows_are_not_used(spark, docs_of):
    docs, labels = docs_of(LABELLED), small_labels(spark, "quality")
    turned = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one = sorted((r.doc_id, r.score) for r in quality.quality_scores(docs, labels).collect())
    assert one == sorted((r.doc_id, r.score) for r in quality.quality_scores(docs, turned).collect())


def test_forward_backward_equals_enumeration():
    from itertools import product
    rng = np.random.default_rng(2)
    chain = toxicity.Chain(np.zeros(4), rng.normal(size=(2, 2)), rng.normal(size=2))
    e = rng.normal(size=6)
    total, toxic = 0.0, np.zeros(6)
    for tags in product((0, 1), repeat=6):
        s = chain.start[tags[0]] + sum(e[i] * t for i, t in enumerate(tags)) + sum(chain.trans[a, b] for a, b in zip(tags, tags[1:]))
        total += np.exp(s)
        toxic += np.exp(s) * np.array(tags)
    got, log_z, moves, first = chain.marginals(e, np.array([6]), pairs=True)
    assert np.allclose(got, toxic / total) and abs(log_z - np.log(total)) < 1e-9 and abs(moves.sum() - 5) < 1e-9


def plain_sums(chain, e):
    """Forward-backward of one text, token after token, in logarithms."""
    f = [np.array([chain.start[0], chain.start[1] + e[0]])]
    for x in e[1:]:
        f.append(np.logaddexp.reduce(f[-1][:, None] + chain.trans, axis=0) + [0.0, x])
    b = [np.zeros(2)]
    for x in e[:0:-1]:
        b.append(np.logaddexp.reduce(chain.trans + (b[-1] + [0.0, x])[None, :], axis=1))
    both = np.array(f) + np.array(b[::-1])
    moves = np.zeros((2, 2))
    z = np.logaddexp.reduce(f[-1])
    for t in range(1, len(e)):
        moves += np.exp(f[t - 1][:, None] + chain.trans + (b[::-1][t] + [0.0, e[t]])[None, :] - z)
    return np.exp(both[:, 1] - z), z, moves


def test_chains_run_over_whole_texts():
    rng = np.random.default_rng(8)
    chain = toxicity.Chain(np.zeros(4), rng.normal(scale=3, size=(2, 2)), rng.normal(size=2))
    sizes = np.array([120, 0, 1, 47, 48, 49, 96, 97, 3, 1000, 144])
    e = rng.normal(scale=4, size=sizes.sum())
    p, log_z, moves, first = chain.marginals(e, sizes, pairs=True)
    texts = [x for x in np.split(e, np.cumsum(sizes)[:-1]) if len(x)]
    plain = [plain_sums(chain, x) for x in texts]
    assert np.allclose(p, np.concatenate([x[0] for x in plain]), atol=1e-9)
    assert abs(log_z - sum(x[1] for x in plain)) < 1e-6 and np.allclose(moves, sum(x[2] for x in plain))
    assert np.allclose(first, [x[0][0] for x in plain])
    assert np.array_equal(p, chain.marginals(e, sizes))


def test_a_phrase_counts_alike_at_any_offset():
    chain = toxicity.Chain(np.zeros(4), np.array([[0.0, -3.0], [0.0, 1.5]]), np.array([0.0, -4.0]))
    phrase = [3.0, 1.0, 2.0]
    found = []
    for offset in (200, 240 - 2, 240 - 1, 240, 241, 1000):
        e = np.array([-4.0] * offset + phrase + [-4.0] * 200)
        found.append(chain.marginals(e, np.array([len(e)]))[offset:offset + 3])
    assert np.allclose(found, found[0], atol=1e-12)


def test_words_after_a_common_header_are_learned():
    texts = ["the same long header stands before every text here : " + f"text{i} idiot thing{i}" for i in range(60)]
    texts += ["the same long header stands before every text here : " + f"fine{i} day" for i in range(60)]
    y = np.array([1] * 60 + [0] * 60)
    words = [set(t.split()) for t in texts]
    assert "widiot" in toxicity.toxic_parts(words, y, texts)
    # copies count once, in both classes
    assert "widiot" not in toxicity.toxic_parts(words[:1] * 60 + words[60:], y, texts[:1] * 60 + texts[60:])
    assert "wfine7" not in toxicity.toxic_parts(words, y, texts)


def test_remembered_words_are_short():
    model = toxicity.Model(toxicity.Chain(np.ones(1 << toxicity.BITS)))
    model.tagged(["x" * 5000, "y" * 41 + " short", None])
    assert set(model.known) == {"short"}


def test_sample_does_not_depend_on_row_order(spark):
    from ledgerlens.llm.labelled import training_sample
    rows = [(i % 20, f"text {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    one, two = (sorted(map(tuple, training_sample(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, "toxic",
                                                  F.lit(True), 10).collect())) for r, n in ((rows, 3), (rows[::-1], 5)))
    assert one == two and len(one) == 10


def test_spans_are_runs_of_toxic_words():
    texts = [t for _, t in LABELLED]
    model = toxicity.fit_texts(texts, np.array([i % 2 for i in range(80)]))
    text = "well é you are an idiot, and that was fine"
    assert any("idiot" in text[a:b] for a, b in model.spans(text))
    assert model.spans("the day was fine and warm") == [] and model.spans("") == [] and model.spans(None) == []


def test_scoring_memory_does_not_grow_with_the_batch():
    import tracemalloc
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(300)] * 10 + [None, ""]
    model = quality.NbSvm(*(rng.normal(size=1 << quality.BITS).astype(np.float32) for _ in range(2)), 0.1, 1.0, 0.0)
    tracemalloc.start()
    got = model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6                                # the indicators of all texts at once take 150 MB and more
    z = model.margins(*quality.features(texts[:300]))
    assert len(got) == 3002 and np.array_equal(got[:300], 1 / (1 + np.exp(-np.clip(z, -35, 35))))
    assert model.scores([]).shape == (0,)
