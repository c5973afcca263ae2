"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors become integers, floor(256 * x).  All of them are written once as
Parquet, ordered by length, label and the place on a Hilbert curve through the
CURVE_DIMS dimensions of largest spread, and cut into blocks of at most
BLOCK_ROWS rows.  A zone map keeps each block's smallest and largest label and
the smallest and largest value of every dimension.

For an anchor, interval arithmetic over a zone map bounds the inner product
with every row of the block from both sides, so the anchor reads

* for its positives, first the block of its label with the highest upper bound;
  then those of its label whose upper bound reaches the k-th score found there;
* for its negatives, the blocks with another label whose interval meets a
  window [low * positive / 100, positive] of one of its positives.

Every other block provably holds nothing for it: the result is exact.  Anchors
meet zone maps in groups of at most ANCHOR_GROUP anchors and ZONE_PAGE zones,
and blocks meet the anchors that chose them in groups of the same size, so no
task holds more than a bounded part of either side, whatever the labels and
however many rows share a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, small
from ledgerlens.session import delete_path, scratch_path

SCALE = 256
BLOCK_ROWS = 2_048
BLOCKS_PER_FILE = 4
ANCHOR_GROUP = 2_048
ZONE_PAGE = 512
CURVE_DIMS = 16
CURVE_BITS = 4
BROADCAST_ROWS = 200_000            # chosen (block, team) pairs: 12 bytes each
PAGE_LIST = 10_000                  # pages named in the scan's filter
_EXACT = 2.0 ** 53                  # integers below are exact as doubles
_LONG = (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of every row of ``cells`` (values below 2^bits) on the Hilbert
    curve through its dimensions, as bytes that sort like the place.

    The axes are turned bit by bit from the top so that each sub-cube is
    entered where the one before was left, then Gray-coded and interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for d in range(dims):
            flip = (x[d] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(flip, x[0] ^ below, x[0]) ^ swap
            x[d] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> level) & 1, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    planes = np.stack([(x >> level) & 1 for level in range(bits - 1, -1, -1)])
    packed = np.packbits(planes.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def product_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each anchor's inner product with any vector
    between ``low`` and ``high`` (anchors x zones), widened by rounding."""
    up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
    upper = up @ high.T + down @ low.T
    lower = up @ low.T + down @ high.T
    slack = 1e-11 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
    return lower - slack, upper + slack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; products that doubles cannot hold
    are computed in unbounded integers and end at the ends of a long."""
    reach = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if reach < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -_LONG, _LONG).astype(np.int64)


def usable(vectors: DataFrame, vec_id: str, label: str, embedding: str) -> DataFrame:
    """(vec_id, label, x): rows with an id, a label and a vector whose
    components are finite, also times SCALE; x is the scaled vector."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
                          F.transform(F.col(embedding).cast("array<double>"), lambda a: a * SCALE).alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)
                      & ~F.exists("x", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def spreads(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per vector length: number of rows, mean and spread of every dimension
    (a few numbers per dimension reach the driver)."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, g in b.groupby(b["x"].map(len)):
                x = np.floor(_matrix(g["x"]))
                with np.errstate(over="ignore"):
                    yield pd.DataFrame({"d": np.int32(d), "at": np.arange(d, dtype=np.int32), "n": len(g),
                                        "s": x.sum(axis=0), "q": (x * x).sum(axis=0)})

    found: dict[int, list] = {}
    for r in (rows.select("x").mapInPandas(sums, "d int, at int, n bigint, s double, q double")
              .groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
              .orderBy("d", "at").collect()):
        found.setdefault(r["d"], []).append((r["n"], r["s"], r["q"]))
    out = {}
    for d, figures in found.items():
        n = figures[0][0]
        mean = np.array([s / n for _, s, _ in figures])
        with np.errstate(all="ignore"):
            spread = np.sqrt(np.maximum(np.array([q / n for *_, q in figures]) - mean * mean, 0.0))
        out[d] = n, np.nan_to_num(mean), np.nan_to_num(spread)
    return out


_BLOCK = "block bigint, d int, label bigint, vec_id bigint, v array<double>, page int"


def write_blocks(rows: DataFrame, path: str, block_rows: int, blocks_per_file: int) -> DataFrame:
    """The rows as whole numbers, one row an id, written in Hilbert order and
    numbered by block; a page is one file of at most about
    ``blocks_per_file`` blocks."""
    spark = rows.sparkSession
    known = spreads(rows)
    pages = max(1, -(-sum(n for n, *_ in known.values()) // (block_rows * blocks_per_file)))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, g in b.groupby(b["x"].map(len)):
                x = np.floor(_matrix(g["x"]))
                _, mean, spread = known[d]
                widest = np.sort(np.argsort(-spread, kind="stable")[:CURVE_DIMS])
                z = (x[:, widest] - mean[widest]) / np.where(spread[widest] > 0, spread[widest], 1.0)
                top = (1 << CURVE_BITS) - 1
                cells = np.clip(np.floor((np.clip(z, -2.0, 2.0) + 2.0) / 4.0 * (top + 1)), 0, top)
                yield pd.DataFrame({"d": np.int32(d), "label": g["label"], "vec_id": g["vec_id"], "v": list(x),
                                    "place": hilbert_keys(cells.astype(np.int64), CURVE_BITS)})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        page = TaskContext.get().partitionId()
        block, held, width = page << 24, 0, None
        for b in batches:
            numbers = []
            for d in b["d"].to_numpy():
                if width is not None and (held == block_rows or d != width):
                    block, held = block + 1, 0
                width = d
                held += 1
                numbers.append(block)
            yield pd.DataFrame({"block": np.array(numbers, dtype=np.int64), "d": b["d"], "label": b["label"],
                                "vec_id": b["vec_id"], "v": b["v"], "page": np.int32(page)})

    order = ["d", "label", "place", "vec_id"]
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.label", "row.x")
    (one.mapInPandas(keyed, "d int, label bigint, vec_id bigint, v array<double>, place binary")
        .repartitionByRange(pages, *order).sortWithinPartitions(*order)
        .mapInPandas(numbered, _BLOCK).write.partitionBy("page").parquet(path))
    return spark.read.schema(_BLOCK).parquet(path)


_ZONE = "block bigint, d int, page int, first_label bigint, last_label bigint, low array<double>, high array<double>"


def zone_maps(blocks: DataFrame) -> DataFrame:
    """One row per block: smallest and largest label and component values."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for block, g in b.groupby("block"):
                v = _matrix(g["v"])
                found.append((block, g["d"].iat[0], g["page"].iat[0], g["label"].min(), g["label"].max(), v.min(axis=0), v.max(axis=0)))
            yield pd.DataFrame(found, columns=["block", "d", "page", "first_label", "last_label", "low", "high"])

    def whole(parts: pd.DataFrame) -> pd.DataFrame:       # a block spans few batches
        one = parts.iloc[:1].copy()
        one["first_label"], one["last_label"] = parts["first_label"].min(), parts["last_label"].max()
        one["low"], one["high"] = [_matrix(parts["low"]).min(axis=0)], [_matrix(parts["high"]).max(axis=0)]
        return one

    return blocks.mapInPandas(part, _ZONE).groupBy("block").applyInPandas(whole, _ZONE)


_ANCHOR = ("anchor_id bigint, label bigint, d int, v array<double>, team int, read bigint, least double, "
           "positive_ids array<bigint>, positive_scores array<bigint>")


def _windows(scores, low: int, high: int) -> list[tuple[int, int]]:
    """(least, most) whole score between low and high hundredths of each score."""
    return [(-(-(low * int(p)) // 100), (high * int(p)) // 100) for p in scores]


def choose(anchors: DataFrame, zones: DataFrame, rule: str, low: int = 0, high: int = 0) -> DataFrame:
    """Anchor rows with the block each must read, by its zone map.

    Rules: ``first``: per page of zones the block holding the anchor's label
    whose upper bound is highest; ``positives``: all other blocks holding it
    whose upper bound reaches ``least``; ``negatives``: all blocks holding
    another label whose bounds meet a window of one of the positives.
    """
    n_zones, n_teams = zones.count(), (anchors.agg(F.max("team")).first()[0] or 0) + 1
    sheets = max(1, -(-n_zones // ZONE_PAGE))
    asked = anchors.withColumn("sheet", F.explode(F.sequence(F.lit(0), F.lit(sheets - 1))))
    there = (zones.withColumn("sheet", F.pmod(F.xxhash64("block"), F.lit(sheets)).cast("int"))
             .withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(n_teams - 1)))))

    def pick(key, a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        rows, blocks, pages, bounds = [], [], [], []
        for d, g in a.groupby("d"):
            same = z[z["d"] == d]
            if not len(same):
                continue
            lower, upper = product_bounds(_matrix(g["v"]), _matrix(same["low"]), _matrix(same["high"]))
            mine = g["label"].to_numpy()[:, None]
            first, last = same["first_label"].to_numpy()[None, :], same["last_label"].to_numpy()[None, :]
            if rule == "negatives":
                meets = np.zeros(upper.shape, dtype=bool)
                for i, scores in enumerate(g["positive_scores"]):
                    for least, most in _windows(scores, low, high):
                        if least <= most:
                            meets[i] |= (upper[i] >= least) & (lower[i] <= most)
                wanted = meets & ((first != mine) | (last != mine))
            else:
                wanted = (first <= mine) & (mine <= last)
                if rule == "first":
                    best = np.where(wanted, upper, -np.inf).argmax(axis=1)
                    wanted &= np.arange(len(same))[None, :] == best[:, None]
                else:
                    wanted &= (upper >= g["least"].to_numpy()[:, None]) & (same["block"].to_numpy()[None, :] != g["read"].to_numpy()[:, None])
            i, j = np.nonzero(wanted)
            rows.append(g.iloc[i])
            blocks += list(same["block"].to_numpy()[j])
            pages += list(same["page"].to_numpy()[j])
            bounds += list(upper[i, j])
        found = pd.concat(rows) if rows else a.iloc[:0]
        return found.drop(columns="sheet").assign(block=np.array(blocks, dtype=np.int64), page=np.array(pages, dtype=np.int32),
                                                  bound=np.array(bounds, dtype=np.float64))

    chosen = (asked.groupBy("sheet", "team").cogroup(there.groupBy("sheet", "team"))
              .applyInPandas(pick, _ANCHOR + ", block bigint, page int, bound double"))
    if rule == "first" and sheets > 1:
        best = Window.partitionBy("anchor_id").orderBy(F.col("bound").desc(), "block")
        chosen = chosen.withColumn("nr", F.row_number().over(best)).where("nr = 1").drop("nr")
    return chosen


def read_blocks(chosen: DataFrame, blocks: DataFrame, search, schema: str) -> DataFrame:
    """``search(anchors, rows)`` for every block and team of anchors that chose
    it.  Only pages with a chosen block are read, and only chosen blocks are
    shuffled."""
    chosen = checkpointed(chosen)
    wanted = chosen.select("page", "block", "team").distinct()
    pages = wanted.select("page").distinct()
    if pages.count() <= PAGE_LIST:
        blocks = blocks.where(F.col("page").isin([r[0] for r in pages.collect()]))
    rows = blocks.join(small(wanted.select("block", F.col("team").alias("asking")), BROADCAST_ROWS), "block")
    return (chosen.groupBy("block", "team").cogroup(rows.groupBy("block", "asking"))
            .applyInPandas(lambda key, a, b: search(a, b), schema))


def _ordered(scores: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Indices of the masked rows, higher scores first, ties by smaller id."""
    at = np.nonzero(mask)[0]
    return at[np.lexsort((ids[at], -scores[at]))]


def find_positives(k: int):
    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            scores = products(_matrix(a["v"]), _matrix(b["v"]))
            ids, labels = b["vec_id"].to_numpy(), b["label"].to_numpy()
            for own, label, s in zip(a["anchor_id"].to_numpy(), a["label"].to_numpy(), scores):
                mask = (labels == label) & (ids != own)
                if mask.sum() > k:
                    mask &= s >= np.partition(s[mask], mask.sum() - k)[mask.sum() - k]
                found += [(own, ids[j], s[j]) for j in _ordered(s, ids, mask)[:k]]
        return pd.DataFrame(found, columns=["anchor_id", "vec_id", "score"]).astype("int64")
    return search


def find_negatives(k: int, low: int, high: int):
    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            scores = products(_matrix(a["v"]), _matrix(b["v"]))
            ids, labels = b["vec_id"].to_numpy(), b["label"].to_numpy()
            for i, row in enumerate(a.itertuples()):
                windows = [w if w[0] <= w[1] else None for w in _windows(row.positive_scores, low, high)]
                open_ = [w for w in windows if w]
                if not open_:
                    continue
                s = scores[i]
                order = _ordered(s, ids, (labels != row.label) & (s >= min(w[0] for w in open_)) & (s <= max(w[1] for w in open_)))
                falling = -s[order]
                for place, w in enumerate(windows):
                    if w:
                        start = np.searchsorted(falling, -w[1], side="left")
                        stop = min(np.searchsorted(falling, -w[0], side="right"), start + k)
                        found += [(row.anchor_id, place, ids[j], s[j]) for j in order[start:stop]]
        return pd.DataFrame(found, columns=["anchor_id", "place", "vec_id", "score"]).astype("int64")
    return search


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k first of each group; tasks pass on at most k of a group."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label",
                   embedding: str = "embedding", k: int = 5, low: int = 80, high: int = 100,
                   block_rows: int = BLOCK_ROWS, blocks_per_file: int = BLOCKS_PER_FILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): each anchor's hard negatives for each of its positives.

    ``is_anchor`` is a condition on ``vec_id``.  Scores are inner products of
    the vectors floor(256 * x), higher first, ties by smaller id.  Positives
    are the anchor's first k other rows of its label; a positive's negatives are
    the first k rows of other labels whose score lies between ``low`` and
    ``high`` hundredths of the positive's.  Fewer if there are fewer; an
    anchor without positives, or a positive without negatives, gives no row.

    Null ids and labels, null and empty vectors and vectors with null or
    non-finite components take no part; of rows that repeat an id the one with
    the smallest (label, vector) counts; vectors are compared only with vectors
    of their length; scores beyond a long end there; other columns are
    ignored; an empty table gives no rows.
    """
    path = scratch_path(vectors.sparkSession, "hilbert-blocks")             # removed at the end
    blocks = write_blocks(usable(vectors, vec_id, label, embedding), path, block_rows, blocks_per_file)
    zones = checkpointed(zone_maps(blocks))
    asking = blocks.where(is_anchor)
    n_anchors, n_pages = asking.count(), (zones.agg(F.max("page")).first()[0] or 0) + 1
    per_team = max(1, ANCHOR_GROUP * n_pages // max(1, n_anchors))         # pages whose anchors ask together
    none = F.lit(None)
    anchors = asking.select(F.col("vec_id").alias("anchor_id"), "label", "d", "v", F.floor(F.col("page") / per_team).cast("int").alias("team"),
                            F.lit(-1).cast("bigint").alias("read"), F.lit(float("-inf")).alias("least"),
                            none.cast("array<bigint>").alias("positive_ids"), none.cast("array<bigint>").alias("positive_scores"))
    pair = "anchor_id bigint, vec_id bigint, score bigint"

    first = checkpointed(choose(anchors, zones, "first"))
    seeds = checkpointed(_top(read_blocks(first, blocks, find_positives(k), pair), ["anchor_id"], k))
    reached = seeds.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("s"))
    begun = (first.select("anchor_id", "label", "d", "v", "team", F.col("block").alias("read"), "positive_ids", "positive_scores")
             .join(reached, "anchor_id", "left")
             .select("anchor_id", "label", "d", "v", "team", "read",
                     F.when(F.col("n") >= k, F.col("s")).otherwise(float("-inf")).alias("least"), "positive_ids", "positive_scores"))
    rest = read_blocks(choose(begun, zones, "positives"), blocks, find_positives(k), pair)
    best = _top(seeds.drop("rank").unionByName(rest), ["anchor_id"], k)
    lists = (best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))   # at most k
             .select("anchor_id", F.col("p.vec_id").alias("positive_ids"), F.col("p.score").alias("positive_scores")))
    windows = checkpointed(begun.drop("positive_ids", "positive_scores").join(lists, "anchor_id")
                           .select("anchor_id", "label", "d", "v", "team", "read", "least", "positive_ids", "positive_scores"))

    found = read_blocks(choose(windows, zones, "negatives", low, high), blocks, find_negatives(k, low, high),
                        "anchor_id bigint, place bigint, vec_id bigint, score bigint")
    at = F.col("place").cast("int") + 1
    mined = (_top(found, ["anchor_id", "place"], k)
             .join(windows.select("anchor_id", "positive_ids", "positive_scores"), "anchor_id")
             .select("anchor_id", F.element_at("positive_ids", at).alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                     F.element_at("positive_scores", at).alias("positive_score"), F.col("score").alias("negative_score")))
    mined = checkpointed(mined)
    delete_path(vectors.sparkSession, path)
    return mined
