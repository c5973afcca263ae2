"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length.  For each of TABLES tables they are turned
by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and assigned to the nearest signed axis: the component of largest
magnitude with its sign.  A query looks not only at its own axis but at the
PROBES axes nearest to it.  What lies in a probed bucket is a candidate and is
ranked by the exact cosine of the original vectors.  Queries that have found
fewer than k rows although there are more look at ever more axes, at last at
all of them.

Distinct vectors are hashed once.  Of the rows that share one, the k+1 with
the smallest ids stand for it: the others tie with them and lose on the id, so
leaving them out changes no result.  Buckets are cut into blocks of about
BLOCK_ROWS rows that are searched by separate tasks, so neither a common
vector nor a crowded bucket meets in one task; per block and query only the k
best by the exact cosine are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed

TABLES = 10
PROBES = 10
BLOCK_ROWS = 4_000
_ROUNDING = 1e-9         # more than a cosine from unit vectors is off


def rotations(dims: int, tables: int, seed: int = 5) -> np.ndarray:
    """Random signs: tables x 3 rounds x padded dimensions."""
    width = 1 << max(0, (dims - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 3, width))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and Hadamard transform of the rows of ``x``."""
    width = signs.shape[1]
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x
    for s in signs:
        y = y * s
        half = 1
        while half < width:
            pairs = y.reshape(len(y), width // (2 * half), 2, half)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(y), width)
            half *= 2
        y /= np.sqrt(width)
    return y


def axes(x: np.ndarray, signs: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of every row, nearest first, as
    2 * axis (+ 1 if negative)."""
    y = rotate(x, signs)
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)      # index = 2 * axis + negative
    return np.argsort(-both, axis=1, kind="stable")[:, :min(count, both.shape[1])]


def _matrix(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _best(rough: np.ndarray, query: np.ndarray, vectors: np.ndarray, ids: list, own: int, k: int) -> list[tuple[int, float]]:
    """(id, exact cosine) of the k nearest ids, ties to the smaller; ``rough``
    are the cosines of unit vectors, right but for rounding."""
    if len(rough) > k:                               # the query's own vector may be among them: one more
        edge = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
        some = np.nonzero(rough >= edge - _ROUNDING)[0]
    else:
        some = np.arange(len(rough))
    near, asked = vectors[some], query[None, :]
    exact = _dot(near, asked) / (np.sqrt(_dot(asked, asked)) * np.sqrt(_dot(near, near)))
    return sorted(((o, float(s)) for j, s in zip(some, exact) for o in ids[j] if o != own), key=lambda x: (-x[1], x[0]))[:k]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): rows whose vector, of whatever length, is not null, zero or
    holding null or non-finite components."""
    v = F.col(embedding).cast("array<double>")
    ok = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0.0))
    return ok


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5,
            tables: int = TABLES, probes: int = PROBES, block_rows: int = BLOCK_ROWS, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates.

    ``is_query`` is a condition on ``vec_id``; candidates are all other rows.
    Nearest first by cosine in double precision, ties to the smaller id; all
    candidates if there are fewer than k.  Null, empty and zero vectors, vectors
    with null or non-finite components and rows without an id take no part;
    vectors are compared only with vectors of the same length.  Rows repeated
    under one id count once if equal; different vectors under one id are
    candidates each, of which the best counts.  Other columns are ignored.
    """
    rows = usable(vectors, vec_id, embedding).dropDuplicates()
    dims = [r[0] for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]   # a few lengths
    kept = Window.partitionBy("v").orderBy("vec_id")
    shared = (rows.withColumn("nr", F.row_number().over(kept)).where(F.col("nr") <= k + 1)
              .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))        # at most k + 1 ids
    queries = rows.where(is_query)

    def hashed(count: int, of_tables: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            signs = {d: rotations(d, tables, seed) for d in dims}
            for b in batches:
                for d, g in b.groupby(b["v"].map(len)):
                    x = _matrix(g["v"])
                    for t in range(of_tables):
                        near = axes(x, signs[d][t], count)
                        for p in range(near.shape[1]):
                            yield g.assign(d=np.int32(d), t=np.int32(t), axis=near[:, p].astype(np.int32))
        return run

    spot = "d int, t int, axis int"
    points = checkpointed(shared.mapInPandas(hashed(1, tables), f"v array<double>, ids array<bigint>, {spot}"))
    # A bucket of n rows has ceil(n / block_rows) blocks; rows go to blocks by hash.
    # There are at most 2 * width buckets a table and length: a broadcast of a known bound.
    sizes = F.broadcast(points.groupBy("d", "t", "axis").agg(F.count(F.lit(1)).alias("n"))
                        .select("d", "t", "axis", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    placed = (points.join(sizes, ["d", "t", "axis"])
              .withColumn("block", F.pmod(F.xxhash64("ids"), F.col("blocks").cast("bigint")).cast("int")).drop("blocks"))

    def search(key: tuple, asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(there):
            raw_q, raw_x = np.stack(asked["v"].to_numpy()), np.stack(there["v"].to_numpy())
            rough = _matrix(asked["v"]) @ _matrix(there["v"]).T
            ids = there["ids"].to_numpy()
            for own, q, s in zip(asked["vec_id"].to_numpy(), raw_q, rough):
                found += [(own, o, x) for o, x in _best(s, q, raw_x, ids, own, k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    by = ["d", "t", "axis", "block"]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def asked_of(asking: DataFrame, count: int, of_tables: int) -> DataFrame:
        """The k nearest rows in the ``count`` nearest buckets of each table."""
        probed = (asking.mapInPandas(hashed(count, of_tables), f"vec_id bigint, v array<double>, {spot}")
                  .join(sizes, ["d", "t", "axis"])
                  .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))
        return (probed.groupBy(*by).cogroup(placed.groupBy(*by))
                .applyInPandas(search, "query_id bigint, vec_id bigint, score double")
                .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
                .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))

    found = checkpointed(asked_of(queries, probes, tables))
    # Queries with fewer results than there are other rows of their length.
    others = rows.groupBy(F.size("v").alias("d")).agg((F.count_distinct("vec_id") - 1).alias("others"))     # a few lengths
    all_axes = 2 * max([1 << max(0, (d - 1).bit_length()) for d in dims], default=1)
    while probes < all_axes:
        some = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        short = (queries.withColumn("d", F.size("v")).join(F.broadcast(others), "d")
                 .join(some, F.col("vec_id") == F.col("query_id"), "left")
                 .where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), "others")).select("vec_id", "v"))
        short = checkpointed(short)
        if short.isEmpty():
            break
        probes = min(4 * probes, all_axes)
        # All axes of one table reach every row.
        more = asked_of(short, probes, 1 if probes == all_axes else tables)
        found = checkpointed(found.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
                             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
    return found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
