"""SimHash near-duplicates found by covering locality-sensitive hashing.

A fingerprint has one bit per position of the shingles' 64-bit hashes: 1 where
more than half of them have it.  Fingerprints within ``radius`` differing bits
are linked, and links are closed to components.

Candidates: every bit position gets a vector of radius+1 binary digits, and
for each nonzero vector v there is a table whose mask keeps the positions not
orthogonal to v.  The at most ``radius`` positions in which two linked
fingerprints differ cannot span all radius+1 dimensions, so some v is
orthogonal to all of them: the pair agrees on that table's mask.  All pairs
within the radius thus meet in some table - not just probably.

Only distinct fingerprints are compared, so copies cost one row each.  In
buckets of up to ``pair_bucket`` of them, pairs are compared directly.  Larger
buckets never list pairs: there each fingerprint is written once for itself
and once for every way to flip up to radius/2 of the bits outside the mask;
two fingerprints are within the (even) radius exactly if they share such a
row.  Both ways give the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, text_key
from ledgerlens.llm.components import connected_components

SEED = 42            # of XXH64, fixed by the contract
SHINGLE = 3
RADIUS = 2
PAIR_BUCKET = 32     # larger buckets are compared through flipped bits
_BITS = 1 << 16      # hashes turned into bits at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(found) - shingle + 1)
    width = min(shingle, len(found))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[s:e], SEED) for s, e in
                       zip(starts[:last].tolist(), ends[width - 1:].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, last, _BITS):
        bits = np.unpackbits(hashes[i:i + _BITS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fingerprint bigint) per row of ``docs``."""
    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"),
                       run(F.col(text)).alias("fingerprint"))


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 covering masks over 64 bits, as signed longs.

    Bit i's vector is i modulo 2^(radius+1) - 1, plus 1: all nonzero vectors
    occur about equally often, so the masks are about equally long.
    """
    n = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(64) if bin(v & (i % n + 1)).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _apart(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def links(prints: DataFrame, radius: int = RADIUS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose components are those of
    all pairs within ``radius`` bits.  ``prints`` has distinct ``fingerprint``s."""
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = masks(radius)
    keyed = prints.select("fingerprint", F.inline(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(m).alias("key")) for t, m in enumerate(tables)])))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = keyed.join(sizes, ["t", "key"])
    little = shared.where(F.col("size") <= pair_bucket).select("t", "key", "fingerprint")
    pairs = (little.withColumnRenamed("fingerprint", "a")
             .join(little.withColumnRenamed("fingerprint", "b"), ["t", "key"])
             .where((F.col("a") < F.col("b")) & (_apart(F.col("a"), F.col("b")) <= radius))
             .select("a", "b"))
    flips = F.lit(None)
    for t, m in enumerate(tables):
        free = [i for i in range(64) if not (m >> i) & 1]
        ways = [sum(1 << i for i in c) for r in range(radius // 2 + 1) for c in combinations(free, r)]
        signed = [w - (1 << 64) if w >> 63 else w for w in ways]
        flips = F.when(F.col("t") == t, F.array(*[F.lit(w).cast("bigint") for w in signed])).otherwise(flips)
    hubs = (shared.where(F.col("size") > pair_bucket)
            .select("fingerprint", F.explode(flips).alias("flip"))
            .select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("hub")))
    # Within a hub everything is linked; linking to its smallest keeps the component.
    least = hubs.groupBy("hub").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("top")).where("a < top")
    stars = (hubs.join(least.select("hub", "a"), "hub").where(F.col("fingerprint") != F.col("a"))
             .select("a", F.col("fingerprint").alias("b")))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(doc_id, text_key, fingerprint bigint, component, component_id) per row of ``docs``.

    ``component`` names the component by its smallest fingerprint,
    ``component_id`` by the smallest document id reachable over links.
    Null, empty and blank texts have fingerprint 0 and link like any other;
    repeated rows and ids each keep their row; a row with a null id belongs to
    its component without naming it (all ids null: component null); an empty
    table gives no rows; other columns are ignored.
    """
    prints = checkpointed(fingerprints(docs, doc_id, text, shingle))
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(links(nodes.select("fingerprint"), radius, pair_bucket))
    nodes = (nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
             .select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")))
    heads = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    nodes = nodes.join(heads, "root").select("fingerprint", F.col("root").alias("component"), "component_id")
    return prints.join(nodes, "fingerprint").select("doc_id", "text_key", "fingerprint", "component", "component_id")


def hex_print(fingerprint_: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fingerprint_)), 16, "0")
