"""Content fingerprint of a dataset.

Order- and layout-independent: every row is written out with null marks and
lengths (so neither a moved value nor a moved column border goes unseen) and
hashed with SHA-256; the four 15-digit pieces of the hashes are summed
exactly, and the row count and sums are hashed once more with the column
names.  It is one partial + final aggregation (one row per task crosses the
shuffle).  It identifies content, not file bytes: rewriting the same rows
into other files keeps it.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.mapping import qcol

PIECES = 4      # of 15 hex digits each: 240 of the 256 bits
LIMBS = 3       # of 20 bits each: what a piece is summed by
LIMB_BITS = 20


def row_text(columns: list[str]) -> Column:
    """``-`` for a null, else ``<length>:<value>``, column after column."""
    def part(name):
        c = qcol(name).cast("string")
        return F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat_ws(",", *[part(c) for c in columns])


def _piece_names(columns: list[str]) -> list[str]:
    """Names longer than any column's, so none of them."""
    return [f"_p{'_' * max(map(len, columns), default=0)}{i}" for i in range(PIECES)]


def hash_pieces(columns: list[str]) -> dict[str, Column]:
    """Pieces of a row's hash, 60 bits each."""
    h = F.sha2(row_text(columns), 256)
    return {name: F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("bigint") for i, name in enumerate(_piece_names(columns))}


def piece_sums(columns: list[str]) -> dict[str, Column]:
    """Aggregates over ``hash_pieces``: row count and the sums of every piece's
    limbs, which are longs for up to 2^43 rows."""
    sums = {"row_count": F.count(F.lit(1))}
    for i, name in enumerate(_piece_names(columns)):
        for j in range(LIMBS):
            limb = F.shiftright(name, LIMB_BITS * j).bitwiseAND((1 << LIMB_BITS) - 1)
            sums[f"_s{i}_{j}"] = F.coalesce(F.sum(limb), F.lit(0))
    return sums


def fingerprint_frame(df: DataFrame) -> DataFrame:
    """One row: ``row_count``, ``data_hash`` (64 hex chars)."""
    pieces = df.select(*[c.alias(name) for name, c in hash_pieces(df.columns).items()])
    agg = pieces.agg(*[c.alias(name) for name, c in piece_sums(df.columns).items()])

    def total(i):
        limbs = [F.col(f"_s{i}_{j}").cast("decimal(19,0)") * F.lit(1 << LIMB_BITS * j).cast("decimal(13,0)") for j in range(LIMBS)]
        return reduce(Column.__add__, limbs).cast("decimal(38,0)").cast("string")

    digest = F.sha2(F.concat_ws(":", F.lit(",".join(df.columns)), F.col("row_count").cast("string"),
                                *[total(i) for i in range(PIECES)]), 256)
    return agg.select("row_count", digest.alias("data_hash"))


def data_hash(columns: list[str], sums: dict) -> str:
    """The hash from observed ``piece_sums``; as ``fingerprint_frame`` gives it."""
    totals = [sum(int(sums[f"_s{i}_{j}"]) << LIMB_BITS * j for j in range(LIMBS)) for i in range(PIECES)]
    parts = [",".join(columns), str(sums["row_count"]), *map(str, totals)]
    return hashlib.sha256(":".join(parts).encode()).hexdigest()


def dataset_fingerprint(df: DataFrame) -> str:
    return fingerprint_frame(df).first()["data_hash"]
