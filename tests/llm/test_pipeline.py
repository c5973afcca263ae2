import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing, quality, simhash
from ledgerlens.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Input and output of every stage, each stored and read again."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_and_columns(chain):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
    for name, before, after in chain[:-1]:
        assert after.columns == COLUMNS
    assert chain[-1][2].columns == COLUMNS + ["epochs", "extra_words", "taken_words"]


def test_quality_stage_keeps_what_the_classifier_keeps(spark, chain):
    _, before, after = chain[0]
    scored = quality.quality_scores(before, table(spark, SF, "labels"))
    assert ids(after) == ids(scored.where("predicted = 1"))


def test_one_document_of_each_group_stays(chain):
    _, before, after = chain[1]
    rows = before.select("doc_id", "text").collect()
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    groups = []
    for d in sorted(prints):
        near = [g for g in groups if any(bin(prints[d] ^ prints[x]).count("1") <= 2 for x in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [d]]
    assert ids(after) == sorted(min(g) for g in groups)


def test_contaminated_documents_go(spark, chain):
    from test_decontam import brute
    _, before, after = chain[2]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    docs = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == sorted(d for d, _, hit, _ in brute(docs, items) if not hit)


def test_secrets_are_masked(spark, chain, docs_of):
    _, before, after = chain[3]
    assert ids(before) == ids(after)
    planted = docs_of([(i, f"words {i} password={'0a9b8c7d' * 2}{i} more", "s") for i in range(5)], clash=False)
    out = P.without_secrets(spark, before.unionByName(planted), SF)
    assert out.count() == before.count() + 5 and out.where(F.col("text").rlike(r"password=[0-9a-f]{8}")).count() == 0
    assert out.where("n_chars <> char_length(text)").count() == 0


def test_mix_takes_the_targets(chain):
    _, before, after = chain[4]
    words = before.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(after.select(F.sum("taken_words")).first()[0] - words) <= 20


def test_faulty_rows_pass_through_every_stage(spark, docs_of):
    docs = docs_of([(1, None, None), (2, "", "a"), (None, "a few words of text", "a"), (None, None, "b"), (5, "w " * 30_000, "a"),
                    (6, "some clean words here", "b"), (6, "some clean words here", "b")], clash=False)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:5] == COLUMNS
        assert out.count() <= 7
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_returns_the_last_stage(spark, chain):
    assert sorted((r.doc_id, r.taken_words) for r in P.run(spark, SF).collect()) == sorted(
        (r.doc_id, r.taken_words) for r in chain[-1][2].collect())


def test_repeats_share_what_the_mix_takes(spark, docs_of):
    docs = docs_of([(1, "one two three four five", "a")] * 7 + [(2, "six seven eight", "b")] * 40 + [(None, "x y", "c")] * 30
                   + [(3, "some other words", "b")], clash=False)
    out, mix = P.mixed(spark, docs, SF).collect(), mixing.mixture(docs).collect()
    for name in "abc":
        assert abs(sum(r.taken_words for r in out if r.source == name) - next(r.target for r in mix if r.source == name)) <= 0.5
    shares = sorted((r.text, r.epochs, r.extra_words, r.taken_words) for r in out)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert shares == sorted((texts[r.doc_id], r.epochs, r.extra, r.taken) for r in mix if r.taken > 0)
