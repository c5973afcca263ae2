"""Source divergence audit: how far a source's words are from its language's.

A group is a (lang, source).  Every language keeps the terms that at least
MIN_DOCS of its documents hold; a group or language gives a kept term with n
occurrences there p = 1 + floor(10^9 (n + 2) / (N + 2 V)), N being its
occurrences of all V kept terms.  Two such numbers differ by
f(p, q) = floor((p - q)^2 / (p + q)).  All arithmetic is on whole numbers.

* ``pair``: a group against every other source of its language, f summed over
  all V terms.  Terms are dealt to blocks of about TERM_BLOCK and sources to
  tiles of about TILE; a task holds one block of terms for two tiles and adds up
  f for all pairs of their sources over the terms that occur there.  All other
  terms of a pair have the same f, which is added once by count.
* ``term``: a group against its language, term by term, the ``top`` largest f
  of terms it favours.  f grows with the group's count and falls with the
  language's, so a term that ``top`` others dominate (group count not lower,
  language count not higher, earlier in UTF-8) is not among them.  Partitions
  retain their skyband, the terms that fewer than ``top`` others dominate;
  skybands are merged in a few parts per group and once more filtered; what is
  left is ranked by f exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, small

MIN_DOCS = 10
TOP = 10
ONE = 1_000_000_000
TERM_BLOCK = 4_096
TILE = 64
MERGE_PARTS = 16
LANG_ROWS = 50_000                 # languages broadcast: three numbers each
GROUP_ROWS = 200_000               # groups broadcast: some names and numbers each
_HELD = 600_000                    # counted terms a task holds before it passes them on
_SLICE = 1 << 20                   # bytes of a long text split at a time

# Bytes that are no part of a term become blanks: U+0000-40, 5B-60, 7B-7F.
_PARTS = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def slices(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, A-Z lower-cased, a bounded number at a time."""
    b = text.lower().translate(_PARTS)                                       # bytes.lower changes A-Z only
    start = 0
    while len(b) - start > _SLICE:
        cut = b.rfind(b" ", start + 1, start + _SLICE)
        if cut < 0:                                                          # one term longer than a slice
            cut = b.find(b" ", start + _SLICE)
            if cut < 0:
                break
        yield b[start:cut].split()
        start = cut
    yield b[start:].split()


def count_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term.

    Tasks count what they read before anything is shuffled, so a common term
    reaches the next stage once per task and source; rows are dealt by (lang,
    term).
    """
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    def passed_on(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang_, source_), (n, seen) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                some = terms[i:i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang_, len(some)), pa.repeat(source_, len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                     pa.array(list(map(n.__getitem__, some)), pa.int64()), pa.array(list(map(seen.__getitem__, some)), pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for text_, lang_, source_ in zip(texts, b.column("lang").to_pylist(), b.column("source").to_pylist()):
                n, seen = held.setdefault((lang_, source_), (Counter(), Counter()))
                size -= len(n)
                distinct: set[bytes] = set()
                for terms in slices(text_.as_py()):
                    n.update(terms)
                    distinct.update(terms)
                seen.update(distinct)
                size += len(n)
                if size > _HELD:
                    yield from passed_on(held)
                    held, size = {}, 0
        yield from passed_on(held)

    rows = docs.select(name(text).alias("text"), name(lang).alias("lang"), name(source).alias("source"))
    return (rows.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
            .repartition("lang", "term")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact; null if that is empty."""
    top = (n + F.lit(2)).cast("decimal(19,0)") * F.lit(ONE).cast("decimal(10,0)")
    below = (total.cast("decimal(20,0)") + kept.cast("decimal(20,0)") * F.lit(2).cast("decimal(1,0)")).cast("decimal(21,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", top, F.nullif(below, F.lit(0).cast("decimal(21,0)")))


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares stay below 2^30, so longs hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


# ------------------------------------------------------------------- skyband
def skyband(high: np.ndarray, low: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of the rows that fewer than k others dominate: ``high`` not
    lower, ``low`` not higher, ``place`` (distinct) earlier."""
    order = np.lexsort((place, low, -high))                  # dominating rows come first
    band = np.zeros(0, dtype=np.int64)
    for start in range(0, len(order), 256):
        block = order[start:start + 256]
        # Against the band so far (a dropped row's dominators stand for it) and,
        # within the block, against the rows before.
        first = np.concatenate([band, block])
        ahead = np.arange(len(first))[None, :] < len(band) + np.arange(len(block))[:, None]
        count = (ahead & (low[first][None, :] <= low[block][:, None]) & (place[first][None, :] < place[block][:, None])).sum(axis=1)
        band = np.concatenate([band, block[count < k]])
    return band


def _band_of(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Skyband of one group's terms (unique in it)."""
    place = np.empty(len(rows), dtype=np.int64)
    terms = rows["term"].tolist()                            # str order is code point order, as UTF-8's
    place[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    return rows.iloc[skyband(rows["n"].to_numpy(), rows["lang_n"].to_numpy(), place, k)]


_GROUP = ["lang", "source"]
_TERM = "lang string, source string, term string, n bigint, lang_n bigint, p bigint, q bigint"


def favoured_terms(shares: DataFrame, k: int) -> DataFrame:
    """(lang, source, term, value, rank): the k terms with the largest value of
    each group among those with p > q."""
    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId() % MERGE_PARTS
        held: dict[tuple, list[pd.DataFrame]] = {}
        limit: dict[tuple, int] = {}
        for b in batches:
            for key, g in b.groupby(_GROUP):
                held.setdefault(key, []).append(g)
                if sum(map(len, held[key])) > limit.get(key, 4_096):      # twice the band, at least
                    held[key] = [_band_of(pd.concat(held[key]), k)]
                    limit[key] = max(4_096, 2 * len(held[key][0]))
        for bands in held.values():
            yield _band_of(pd.concat(bands), k).assign(part=part)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return _band_of(rows, k).drop(columns="part")

    bands = (shares.where("p > q").mapInPandas(within, _TERM + ", part int")
             .groupBy(*_GROUP, "part").applyInPandas(merged, _TERM))
    order = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "term")
    return (bands.select(*_GROUP, "term", difference(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


# --------------------------------------------------------------------- pairs
def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): f of every two sources of a language,
    summed over all its kept terms, in both directions."""
    tiles = checkpointed(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("kept").alias("kept")).where("sources > 1")
                         .select("lang", F.ceil(F.col("sources") / TILE).cast("int").alias("tiles"),
                                 F.greatest(F.lit(1), F.ceil(F.col("kept") / TERM_BLOCK)).cast("int").alias("blocks")))
    tiled = (groups.join(small(tiles, LANG_ROWS), "lang")
             .withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")))
    # A group's unseen share goes to every block of terms; its counted terms to theirs.
    unseen = tiled.select(*_GROUP, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tile", "tiles",
                          F.lit(None).cast("string").alias("term"), F.coalesce("unseen", F.lit(1)).alias("p"))
    seen = (shares.join(small(tiles, LANG_ROWS), "lang")
            .select(*_GROUP, F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"),
                    F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"), "tiles", "term", "p"))
    # A row of tile t takes part in the cells (t, u) and (u, t), of which one is kept.
    cells = (unseen.unionByName(seen)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumns({"first": F.least("tile", "other"), "second": F.greatest("tile", "other")}))

    def add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, first, second = key
        base = rows[rows["term"].isna()]
        names = base["source"].to_numpy()
        at = {s: i for i, s in enumerate(names)}
        known = rows[rows["term"].notna()]
        column, found = pd.factorize(known["term"])
        p = np.repeat(base["p"].to_numpy(dtype=np.int64)[:, None], len(found), axis=1)
        p[known["source"].map(at).to_numpy(dtype=np.int64), column] = known["p"].to_numpy(dtype=np.int64)
        tile = base["tile"].to_numpy()
        left, right = np.nonzero(tile == first)[0], np.nonzero(tile == second)[0]
        out = []
        for i in left:
            others = right[right > i] if first == second else right
            if len(others):
                apart = p[others] - p[i]
                out.append(pd.DataFrame({"lang": lang, "source": names[i], "item": names[others], "terms": len(found),
                                         "value": ((apart * apart) // (p[others] + p[i])).sum(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["lang", "source", "item", "terms", "value"])

    sums = (cells.groupBy("lang", "block", "first", "second")
            .applyInPandas(add_up, "lang string, source string, item string, terms bigint, value bigint")
            # names of a pair in one order, whatever order a block met them in
            .groupBy("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"))
            .agg(F.sum("terms").alias("terms"), F.sum("value").alias("value")))
    known = small(groups.select("lang", "source", "unseen", "kept"), GROUP_ROWS)
    rest = F.coalesce((F.col("kept") - F.col("terms")) * difference(F.col("pa"), F.col("pb")), F.lit(0))
    whole = (sums.join(known.select("lang", F.col("source").alias("a"), F.col("unseen").alias("pa"), "kept"), ["lang", "a"])
             .join(known.select("lang", F.col("source").alias("b"), F.col("unseen").alias("pb")), ["lang", "b"])
             .select("lang", "a", "b", (F.col("value") + rest).alias("value")))
    return whole.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                  F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"),
                        "value").select("lang", "x.source", "x.item", "value")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang",
                      source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): the audit of every group.

    Null text, language and source count as ''.  Groups without terms take
    part with their unseen share; a language without kept terms gives pairs of
    value 0; a language of one source gives no pairs; a group that favours no
    term gives no terms.  Repeated documents count each.  Ranks by value, then
    item in UTF-8 order.  An empty table gives no rows; other columns are
    ignored.
    """
    # Already dealt by (lang, term): the sums over a term's sources need no shuffle.
    of_term = Window.partitionBy("lang", "term")
    kept = checkpointed(
        count_terms(docs, text, lang, source)
        .select(*_GROUP, "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("docs"),
                (F.min("source").over(of_term) == F.col("source")).alias("once"))
        .where(F.col("docs") >= min_docs).drop("docs"))
    langs = small(checkpointed(kept.where("once").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))),
                  LANG_ROWS)

    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    totalled = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = checkpointed(
        docs.select(name(lang).alias("lang"), name(source).alias("source")).distinct()
        .join(totalled, _GROUP, "left").join(langs, "lang", "left")
        .select(*_GROUP, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "lang_total")
        .withColumn("unseen", share(F.lit(0), F.col("total"), F.col("kept"))))
    shares = checkpointed(
        kept.join(small(groups, GROUP_ROWS), _GROUP)
        .select(*_GROUP, "term", "n", "lang_n", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
                share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")))

    pairs = pair_values(shares, groups)
    order = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    return (pairs.withColumn("rank", F.row_number().over(order))
            .select(*_GROUP, F.lit("pair").alias("part"), "item", "value", "rank")
            .unionByName(favoured_terms(shares, top).select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")))
