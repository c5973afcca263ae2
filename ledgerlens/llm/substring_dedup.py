"""Substring dedup by difference-cover anchors.

A window of SPAN words is a repeat if the same words start earlier somewhere:
in a row with a smaller id, or before it in the same document.  Words covered
by a repeat are removed; every window is judged on the input.

Anchors: only positions whose remainder modulo PERIOD lies in the difference
cover hash the ANCHOR words that follow.  Any two remainders differ by the
difference of two cover members, so whatever the two places of a repeated
window, within its first PERIOD positions there is one where both places have
an anchor, and PERIOD - 1 + ANCHOR <= SPAN keeps it inside: both places share
an anchor hash.  With PERIOD 13 four of thirteen positions are hashed.

Extension: around anchors that occur more than once, the windows that contain
them are hashed whole (95 bits); of equal windows all but the earliest are
repeats.

Both comparisons are a sort by hash within hash partitions: rows of one hash
stream past each other and are never gathered.  Before that shuffle each task
combines some hundred thousand rows at a time: of the rows of one hash one
travels under it, the others are settled there and travel under hashes of their
own, a run of neighbours as one row, so a passage that a third of all documents
share is a few rows a task.
Texts that an earlier document has word for word are settled beforehand by a
128-bit hash of the text, so groups of exact copies add no rows.

What a task settles depends on which rows it combines.  Its texts are therefore
sorted by (id, text), which the join that fetches them has done already: a task
that runs again settles the same rows.

Texts are shuffled once, by document; the three steps that need them read the
same shuffle.  The rows that travel by hash are kept narrow: an id, a number
for texts that share it, the hash and the place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, text_key

SPAN = 20
PERIOD = 13
COVER = (0, 1, 3, 9)     # perfect difference cover modulo 13
ANCHOR = 8
SEEN = 1 << 62           # of an anchor's place: its hash occurs twice
RUN = 1 << 61            # likewise for a run of anchors, counted in RUN_BITS of the hash
RUN_BITS = 16
COMBINED = 400_000       # rows combined at a time
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def split_words(text: str | None) -> list[bytes]:
    """Words between white space U+0009-U+000D and U+0020."""
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def run_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the ``length`` words from every position on."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    source = hashes if which == 0 else hashes ^ (hashes >> np.uint64(31))
    factor = np.uint64(_ODD[which])
    for k in range(length):
        out = out * factor + source[k:k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def anchor_positions(n_words: int, span: int = SPAN, period: int = PERIOD, cover: tuple[int, ...] = COVER,
                     anchor: int = ANCHOR) -> np.ndarray:
    """Cover positions whose anchor lies within the text."""
    if n_words < span:
        return np.zeros(0, np.int64)
    at = np.arange(n_words - anchor + 1)
    return at[np.isin(at % period, cover)]


def _window_starts(anchors: np.ndarray, n_words: int, span: int, anchor: int) -> np.ndarray:
    """Distinct starts of the windows that contain one of the anchors."""
    first, last = np.maximum(anchors - (span - anchor), 0), np.minimum(anchors, n_words - span)
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.maximum(last + 1, first), -1)
    return np.nonzero(np.cumsum(edge[:-1]) > 0)[0]


def _check_cover(span, period, cover, anchor):
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover is not a difference cover of the period")
    if period - 1 + anchor > span:
        raise ValueError("an anchor must fit into a window at every remainder")


def documents(source: DataFrame) -> DataFrame:
    """(doc_id, text_key, v, copy) of the distinct (id, text) pairs.

    ``v`` numbers the texts of one id; ``copy`` marks texts that an earlier
    document has word for word.
    """
    pairs = source.groupBy("doc_id", "text_key").agg(F.first(F.md5("text")).alias("content"))
    pairs = pairs.withColumn("v", F.row_number().over(Window.partitionBy("doc_id").orderBy("text_key")) - 1)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "v")
    # Partial minima first, so a text with very many copies is one row a task.
    firsts = pairs.groupBy("content").agg(F.min(order).alias("first"))
    return (pairs.join(firsts, "content")
            .select("doc_id", "text_key", "v", (F.col("first") != order).alias("copy")))


def _same(a: str, b: str):
    # The hash first: rows come out sorted by it and the text, null ids too.
    return ((F.xxhash64(f"{a}.doc_id") == F.xxhash64(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
            & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")))


def _runs(mask: np.ndarray, together: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of ``mask``; ``together[i]``: i continues i - 1."""
    first = mask.copy()
    first[1:] &= ~(mask[:-1] & together[1:])
    first |= mask & (np.arange(len(mask)) % longest == 0)
    return np.nonzero(first)[0], np.bincount(np.cumsum(first)[mask], minlength=1)[1:]


def _settled(h: np.ndarray, own: np.ndarray, settled: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that travel (open ones and the first of each settled run) and their hashes."""
    stay = ~settled
    stay[firsts] = True
    kept = np.nonzero(stay)[0]
    return kept, np.where(settled, own, h)[kept]


def settle_anchors(h: np.ndarray, place: np.ndarray, own: np.ndarray, rank: np.ndarray):
    """(index, [h, place]) of the rows that travel, of anchors in the order of
    places, documents by ``rank``.  Anchors whose hash occurs again are SEEN; the
    first of them keeps the hash, the others make RUNs under hashes of their own."""
    _, first, which, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    later = first[which] != np.arange(len(h))
    together = np.r_[False, (rank[1:] == rank[:-1]) & (place[1:] > place[:-1])]
    firsts, lengths = _runs(later, together, (1 << RUN_BITS) - 1)
    own, marked = own.copy(), np.where(count[which] > 1, place | SEEN, place)
    own[firsts] = (own[firsts] >> np.uint64(RUN_BITS) << np.uint64(RUN_BITS)) | lengths.astype(np.uint64)
    marked[firsts] |= RUN
    kept, h = _settled(h, own, later, firsts)
    return kept, [h.view(np.int64), marked[kept]]


def settle_windows(h: np.ndarray, check: np.ndarray, place: np.ndarray, own: np.ndarray, rank: np.ndarray):
    """(index, [h, check, place]) of the rows that travel, of windows in the order
    of places.  Those that start at an earlier place too are settled: runs of
    neighbours travel under hashes of their own, ``check`` being minus the length."""
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    first = first[which]
    known = (check == check[first]) & ((rank[first] != rank) | (place[first] != place))
    together = np.r_[False, (rank[1:] == rank[:-1]) & (place[1:] == place[:-1] + 1)]
    firsts, lengths = _runs(known, together, 1 << 30)
    check = check.copy()
    check[firsts] = -lengths
    kept, h = _settled(h, own, known, firsts)
    return kept, [h.view(np.int64), check[kept], place[kept]]


def repeated_starts(source: DataFrame, named: DataFrame, span: int = SPAN, period: int = PERIOD,
                    cover: tuple[int, ...] = COVER, anchor: int = ANCHOR, combined: int = COMBINED) -> DataFrame:
    """(doc_id, v, starts): the starts of repeated windows, copies left out, as
    runs: the number of neighbours << 32 | the first.

    ``source`` has doc_id, text_key and text; ``named`` is ``documents`` of it.
    The order of places is (doc_id, nulls last; v; start).
    """
    _check_cover(span, period, cover, anchor)
    low = 0xFFFFFFFF
    ids = source.schema["doc_id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(text, v):
            hs = word_hashes(split_words(text))
            at = anchor_positions(len(hs), span, period, cover, anchor)
            return [run_hashes(hs, anchor)[at] if len(at) else at.view(np.uint64), at | v << 32]

        for b in batches:
            yield from _flat(b, ["h", "vp"], map(places, b["text"].to_pylist(), b["v"].to_pylist()), settle_anchors, combined)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(text, v, found):
            hs = word_hashes(split_words(text))
            every = anchor_positions(len(hs), span, period, cover, anchor)
            which = _covered(np.searchsorted(every, found & low), found >> 32, len(every))
            at = _window_starts(every[which], len(hs), span, anchor)
            h = run_hashes(hs, span)[at]
            check = (run_hashes(hs, span, 1)[at] >> np.uint64(33)).astype(np.int32)
            return [h, check, at | v << 32]

        for b in batches:
            yield from _flat(b, ["h", "c", "vp"], map(places, b["text"].to_pylist(), b["v"].to_pylist(), _arrays(b["anchors"])),
                             settle_windows, combined)

    texts = (source.alias("s").join(named.where("NOT copy").alias("n"), _same("s", "n"))
             .select("s.doc_id", "s.text_key", "s.text", F.col("n.v").cast("bigint").alias("v"))
             .sortWithinPartitions(F.xxhash64("doc_id"), "text_key"))

    def run(length):
        return F.shiftleft(length.cast("bigint"), 32).bitwiseOR(F.col("vp").bitwiseAND(low))

    by_hash = Window.partitionBy("h").orderBy(F.col("doc_id").asc_nulls_last(), "vp")
    again = (texts.mapInArrow(anchors, f"doc_id {ids}, h bigint, vp bigint")
             .withColumn("before", F.lag("vp").over(by_hash)).withColumn("after", F.lead("vp").over(by_hash))
             .where(F.col("before").isNotNull() | F.col("after").isNotNull() | (F.col("vp") >= SEEN))
             .groupBy("doc_id", F.shiftright(F.col("vp").bitwiseAND(RUN - 1), 32).cast("int").alias("v"))
             .agg(F.collect_list(run(F.when(F.col("vp").bitwiseAND(RUN) == 0, 1)
                                     .otherwise(F.col("h").bitwiseAND((1 << RUN_BITS) - 1)))).alias("anchors")))
    again = (again.alias("a").join(named.alias("n"), F.col("a.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("a.v") == F.col("n.v")))
             .select("n.doc_id", "n.text_key", "n.v", "a.anchors"))
    near = (source.alias("s").join(again.alias("a"), _same("s", "a"))
            .select("s.doc_id", "s.text_key", "s.text", F.col("a.v").cast("bigint").alias("v"), "a.anchors")
            .sortWithinPartitions(F.xxhash64("doc_id"), "text_key")
            .mapInArrow(windows, f"doc_id {ids}, h bigint, c int, vp bigint"))
    # Plain columns only: an expression here would travel as a further column.
    by_window = Window.partitionBy("h", "c").orderBy(F.col("doc_id").asc_nulls_last(), "vp")
    # Of fully repeated rows the same place comes twice in a row: not earlier.
    same_place = F.lag("doc_id").over(by_window).eqNullSafe(F.col("doc_id")) & (F.lag("vp").over(by_window) == F.col("vp"))
    return (near.withColumn("earlier", F.lag("vp").over(by_window).isNotNull() & ~same_place)
            .where(F.col("earlier") | (F.col("c") < 0))
            .groupBy("doc_id", F.shiftright("vp", 32).cast("int").alias("v"))
            .agg(F.collect_list(run(F.greatest(F.lit(1), -F.col("c")))).alias("starts")))


def _arrays(lists: pa.Array) -> Iterator[np.ndarray]:
    for x in lists:
        yield x.values.to_numpy(zero_copy_only=False)


def _covered(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Whether each of 0..n-1 lies in one of the runs; they may overlap and reach beyond n."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _flat(batch: pa.RecordBatch, names: list[str], places: Iterator[list[np.ndarray]], settle,
          rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, *names) of each document's arrays, some documents at a time
    in the order of places and settled among themselves."""
    ids, versions = batch["doc_id"].to_pylist(), batch["v"].to_pylist()

    def key(i):         # nulls and then NaN come last, as Spark orders them
        x = ids[i]
        return x is None, x != x, 0 if x is None or x != x else x, versions[i]

    def out(parts):
        order = sorted(parts, key=key)
        sizes = [len(parts[i][0]) for i in order]
        columns = [np.concatenate(x) for x in zip(*[parts[i] for i in order])]
        new = [True] + [key(i) != key(j) for i, j in zip(order, order[1:])]
        rank = np.repeat(np.cumsum(new), sizes)
        salt = np.array([xxhash.xxh64_intdigest(repr(ids[i])) for i in order], dtype=np.uint64)
        own = (columns[0] ^ np.repeat(salt, sizes) ^ columns[-1].astype(np.uint64)) * np.uint64(_ODD[1])
        kept, columns = settle(*columns, own ^ (own >> np.uint64(32)), rank)
        index = pa.array(np.repeat(order, sizes)[kept])
        return pa.RecordBatch.from_arrays([batch["doc_id"].take(index), *map(pa.array, columns)], names=["doc_id", *names])

    parts, held = {}, 0
    for i, arrays in enumerate(places):
        if len(arrays[0]):
            parts[i] = arrays
            held += len(arrays[0])
        if held >= rows:
            yield out(parts)
            parts, held = {}, 0
    if parts:
        yield out(parts)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN,
                   period: int = PERIOD, cover: tuple[int, ...] = COVER, anchor: int = ANCHOR,
                   combined: int = COMBINED) -> DataFrame:
    """(doc_id, text_key, n_words, n_removed, kept) per row of ``docs``; ``kept``
    is the remaining words joined by one blank.

    Null and empty texts have no words.  Texts under ``span`` words are kept.
    Rows with one id and different texts are ordered by a hash of the text;
    fully repeated rows are one document and get equal results.  Null ids come
    last.  An empty table gives no rows; other columns are ignored.
    ``combined`` bounds the rows a task settles at a time; any value gives the
    same result.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    named = checkpointed(documents(source))          # four narrow columns, needed in several joins
    starts = repeated_starts(source, named, span, period, cover, anchor, combined)
    found = (named.alias("n").join(starts.alias("r"), F.col("n.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("n.v") == F.col("r.v")), "left")
             .where("n.copy OR r.starts IS NOT NULL").select("n.doc_id", "n.text_key", "n.copy", "r.starts"))

    @F.pandas_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, copies, found in batches:
            rows = []
            for t, copy, s in zip(texts, copies, found):
                w = split_words(t)
                if copy and len(w) >= span:
                    rows.append((len(w), len(w), ""))
                    continue
                if s is None or not len(s):
                    rows.append((len(w), 0, b" ".join(w).decode()))
                    continue
                runs = np.asarray(s, dtype=np.int64)
                keep = ~_covered(runs & 0xFFFFFFFF, (runs >> 32) + span - 1, len(w))
                rows.append((len(w), len(w) - int(keep.sum()),
                             b" ".join([x for x, k in zip(w, keep.tolist()) if k]).decode()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return (source.alias("s").join(found.alias("f"), _same("s", "f"), "left")
            .select("s.doc_id", "s.text_key", cut(F.col("s.text"), F.coalesce("f.copy", F.lit(False)), F.col("f.starts")).alias("r"))
            .select("doc_id", "text_key", "r.*"))
