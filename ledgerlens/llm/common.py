"""Small helpers shared by the operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_root

# White space of the contracts: blank and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored in the session's shared checkpoint folder: computed once,
    readable by every executor, not lost with one."""
    spark = df.sparkSession
    root = scratch_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows.

    Counts first, so the broadcast is always of a known size; above the bound
    the same join shuffles both sides, with the same result.
    """
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged.  ``lower`` does just that
    to a text without multi-byte characters, and is much faster."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where body
    uses it inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(first: Column, last: Column) -> Column:
    """``first..last`` as an array, empty if last < first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(
        F.array().cast("array<int>"))


def text_key(text: Column) -> Column:
    """Tells rows that share a document id but not their text apart."""
    return F.xxhash64(text)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)
