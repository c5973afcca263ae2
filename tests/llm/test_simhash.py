import random

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash
from ledgerlens.llm.components import connected_components


def slow_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """Smallest reachable id by brute force over (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprint_by_definition():
    for t in [None, "", "  \t", "one", "One two", "a b c", "A b C d é É \x0b x\xa0y", "the the the the the " * 50]:
        assert simhash.fingerprint(t) == slow_fingerprint(t), t


def test_fingerprint_of_spark_hash(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_masks_cover_every_pair_of_positions():
    masks = [m % 2**64 for m in simhash.masks(2)]
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


@pytest.mark.parametrize("pair_bucket", [0, 3, 1000])
def test_links_equal_brute_force(spark, pair_bucket):
    rng = random.Random(5)
    values = set()
    for _ in range(6):
        seed = rng.getrandbits(64)
        values |= {seed} | {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(15)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = {r.node: r.root for r in connected_components(simhash.links(df, pair_bucket=pair_bucket)).collect()}
    mine = [roots.get(v, v) for v in signed]
    want = components(list(enumerate(v % 2**64 for v in signed)))
    same = lambda keys: [[a == b for b in keys] for a in keys]             # noqa: E731
    assert same(mine) == same(want)


def test_documents(spark, docs_of):
    rng = random.Random(1)
    base = " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(400))
    docs = [(7, base), (3, base), (9, base + " extra"), (1, None), (2, ""), (4, "  "), (5, "other words here now"),
            (5, "other words here now"), (None, base), (None, "nothing like the rest")]
    out = simhash.near_duplicates(docs_of(docs)).collect()
    assert len(out) == len(docs)
    prints = [(d, slow_fingerprint(t)) for d, t in docs]
    want = sorted(zip([d for d, _ in docs], [p for _, p in prints], components(prints)), key=str)
    assert sorted([(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in out], key=str) == want


def test_empty_table(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_hex_print(spark):
    df = spark.createDataFrame([(0,), (-1,), (255,)], "f long").select(simhash.hex_print("f").alias("h"))
    assert [r.h for r in df.collect()] == ["0" * 16, "f" * 16, "00000000000000ff"]


def test_long_chain_becomes_one_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert connected_components(edges.where("a < 0")).collect() == []


def test_very_long_text():
    text = " ".join(str(i % 977) for i in range(200_000))
    assert simhash.fingerprint(text) == int(np.uint64(simhash.fingerprint(text)))
