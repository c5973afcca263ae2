"""Benchmark decontamination by winnowing.

Words are hashed, every run of K words gives a gram hash, and each sliding
window of ``SPAN - K + 1`` grams (that is ``SPAN`` words) selects its smallest
gram.  Two texts that share ``SPAN`` consecutive words share that window's
grams and so its selected gram: joining the selected grams of documents and
items misses no shared span.  Around each joined gram the at most
``SPAN - K + 1`` word windows that contain it are then compared word for word
with the items' windows, so chance hash matches fall out.

Items shorter than ``SPAN`` words are one window each.  For each such length
n the gram is the whole n-word window (winnowing with a window of one gram).

Only DataFrame functions are used; no text passes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ascii_lower, indexes, let, small, text_key

# Fixed by the contract: characters that separate words, after A-Z became a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words counted without lower-casing first.
COUNTED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SPAN = 10
K = 5
# Fingerprints and windows of the items are broadcast up to this many rows
# (under 100 MB); more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""),
                      F.array().cast("array<string>"))


def _gram(hashes: Column, i: Column, n: int) -> Column:
    """31 bits hash and 32 bits position of the n words from i (0-based)."""
    h = F.xxhash64(*[F.get(hashes, i + j) for j in range(n)])
    return F.shiftleft(h.bitwiseAND(0x7FFFFFFF), 32).bitwiseOR(i.cast("bigint"))


def winnowed(word_list: Column, span: int, k: int) -> Column:
    """Selected grams (hash << 32 | position) of every window of ``span`` words."""
    width = span - k + 1

    def select(grams: Column) -> Column:
        if width == 1:
            return grams
        return F.array_distinct(F.transform(
            indexes(F.lit(0), F.size(grams) - width),
            lambda j: F.least(*[F.get(grams, j + x) for x in range(width)])))

    def grams_of(hashes: Column) -> Column:
        return F.transform(indexes(F.lit(0), F.size(hashes) - k), lambda i: _gram(hashes, i, k))

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), lambda hs: let(grams_of(hs), select))


def _selected(word_list: Column, spans: list[tuple[int, int]]) -> Column:
    """Structs (span, gram) for every (span, k)."""
    def tagged(span: int, k: int) -> Column:
        return F.transform(winnowed(word_list, span, k), lambda g: F.struct(F.lit(span).alias("span"), g.alias("gram")))

    parts = [tagged(span, k) for span, k in spans]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def item_windows(items: DataFrame, item_id: str, text: str, span: int) -> DataFrame:
    """(window, length, items): each distinct window and the items that have it."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("ws"))
    n = F.size("ws")
    length = F.least(n, F.lit(span))
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - length))
    w = w.select("item", "ws", length.alias("length"), F.explode(starts).alias("s"))
    w = w.select("item", "length", F.array_join(F.slice("ws", F.col("s") + 1, F.col("length")), " ").alias("window"))
    return w.groupBy("window", "length").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document row: words, hit words, the items hit, and where.

    Returns doc_id, text_key, n_words, n_hit, items (array of ids as text,
    sorted), hits (array of (start, end) word ranges that match a window).

    - Null, empty or word-free text: 0 words, no hit.
    - Repeated rows each get their row; rows that share an id but not the text
      are told apart by ``text_key``; a null id is an id like any other.
    - An item with a null id contaminates but is not listed; items repeated
      under one id count as one; items without words and an empty table
      contaminate nothing.
    - Other columns of either table are ignored.
    """
    windows = item_windows(items, item_id, item_text, span)
    short = sorted(r[0] for r in windows.where(F.col("length") < span).select("length").distinct().collect())
    spans = [(span, k)] + [(n, n) for n in short]        # at most span entries
    own = F.least(F.size("ws"), F.lit(span))             # the one length of the item's windows
    marks = (items.select(words(F.col(item_text)).alias("ws"))
             .select(own.alias("own"), F.explode(_selected(F.col("ws"), spans)).alias("m"))
             .where(F.col("m.span") == F.col("own"))
             .select("m.span", F.shiftright("m.gram", 32).alias("hash")).distinct())

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    seeds = (source.select("doc_id", text_key(F.col("text")).alias("text_key"),
                           F.explode(_selected(words(F.col("text")), spans)).alias("m"))
             .select("doc_id", "text_key", "m.span", F.shiftright("m.gram", 32).alias("hash"),
                     F.col("m.gram").bitwiseAND(0xFFFFFFFF).cast("int").alias("p"))
             .join(small(marks, broadcast_rows), ["span", "hash"], "left_semi"))
    # Extension: the window starts that contain the gram.
    gram_length = F.when(F.col("span") == span, k).otherwise(F.col("span"))
    seeds = seeds.select("doc_id", "text_key", "span",
                         F.sequence(F.greatest(F.lit(0), F.col("p") - (F.col("span") - gram_length)), F.col("p")).alias("starts"))
    seeds = seeds.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list(
        F.transform("starts", lambda s: F.struct(s.alias("s"), F.col("span").alias("length")))))).alias("starts"))

    cut = (source.select(F.col("doc_id"), text_key(F.col("text")).alias("text_key"), "text").alias("d")
           .join(seeds.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))
                 & (F.col("d.text_key") == F.col("c.text_key")))
           .select("d.doc_id", "d.text_key", let(words(F.col("d.text")), lambda ws: F.transform(
               F.col("c.starts"), lambda x: F.struct(
                   x["s"].alias("s"), x["length"].alias("length"),
                   F.array_join(F.slice(ws, x["s"] + 1, x["length"]), " ").alias("window")))).alias("cut"))
           .select("doc_id", "text_key", F.inline("cut")))
    found = (cut.join(small(windows, broadcast_rows), ["window", "length"])
             .groupBy("doc_id", "text_key")
             .agg(F.array_sort(F.collect_set(F.struct(F.col("s").alias("start"), (F.col("s") + F.col("length")).alias("end")))).alias("hits"),
                  F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"),
                                (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["upto"], x["start"]))).alias("n")),
        lambda acc: acc["n"])
    found = found.select("doc_id", "text_key", "hits", "items", covered.alias("n_hit"))

    base = source.select("doc_id", text_key(F.col("text")).alias("text_key"),
                         F.coalesce(F.regexp_count("text", F.lit(COUNTED_WORD)), F.lit(0)).cast("bigint").alias("n_words"))
    return (base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id"))
                                 & (F.col("b.text_key") == F.col("f.text_key")), "left")
            .select("b.doc_id", "b.text_key", "b.n_words",
                    F.coalesce("f.n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                    F.coalesce("f.items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("f.hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits")))
