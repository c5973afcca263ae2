"""Catalog tables that are appended to, and compacted into keyed snapshots.

Every user action appends one small file.  ``compact`` merges the newest
snapshot with the appended files into a new snapshot, which names the files it
holds.  A reader takes the newest complete snapshot and the files that it does
not name, so at any moment each appended row counts once:

* a snapshot counts only when the list of its files is complete, which is
  written last; one left half-written is never read;
* merged files and the snapshot before are removed only by the next
  compaction, after a newer snapshot is complete; a removal that was cut short
  is taken up then.

So a compaction may be stopped anywhere and run again.  Compactions of one
table must not run at the same time; appends and readers may.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlens.session import delete_path, list_entries, path_exists

SNAPSHOTS = "_snapshots"          # ignored by Parquet readers of the folder
ROWS_PER_FILE = 1_000_000


@dataclass(frozen=True)
class Snapshot:
    version: int
    path: str
    merged: frozenset


def _snapshots(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    """(version, path) of all snapshot folders, newest first."""
    top = f"{table}/{SNAPSHOTS}"
    found = [(int(name.split("-")[0]), f"{top}/{name}") for name, folder in list_entries(spark, top) if folder]
    return sorted(found, reverse=True)


def _complete(spark: SparkSession, table: str) -> Snapshot | None:
    for version, path in _snapshots(spark, table):
        if path_exists(spark, f"{path}/merged/_SUCCESS"):
            names = spark.read.schema("name string").parquet(f"{path}/merged").collect()      # of one compaction
            return Snapshot(version, path, frozenset(r[0] for r in names))
    return None


def _appended(spark: SparkSession, table: str) -> list[str]:
    return sorted(name for name, folder in list_entries(spark, table) if not folder and name.endswith(".parquet"))


def append(spark: SparkSession, table: str, schema: T.StructType, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(table)


def read(spark: SparkSession, table: str, schema: T.StructType, of_snapshot: Callable[[DataFrame], DataFrame] = lambda df: df,
         snapshot_schema: T.StructType | None = None, of_rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Snapshot and newer rows together; ``of_rows`` brings appended rows into
    the snapshot's form."""
    newest = _complete(spark, table)
    names = [n for n in _appended(spark, table) if newest is None or n not in newest.merged]
    files = [f"{table}/{n}" for n in names]
    rows = of_rows(spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema))
    if newest is None:
        return rows
    return of_snapshot(spark.read.schema(snapshot_schema or schema).parquet(f"{newest.path}/rows")).unionByName(rows)


def compact(spark: SparkSession, table: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame] = lambda df: df,
            snapshot_schema: T.StructType | None = None, of_rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """One new snapshot of everything appended so far; ``merge`` unites the
    records of a key."""
    newest = _complete(spark, table)
    names = _appended(spark, table)
    if newest is not None:
        # Left from the compaction before: files it merged, and what preceded it.
        for name in names:
            if name in newest.merged:
                delete_path(spark, f"{table}/{name}")
        for version, path in _snapshots(spark, table):
            if path != newest.path:
                delete_path(spark, path)
        names = [n for n in names if n not in newest.merged]
    if not names:
        return
    target = f"{table}/{SNAPSHOTS}/{(newest.version if newest else 0) + 1:012d}-{uuid.uuid4().hex}"
    files = [f"{table}/{n}" for n in names]
    rows = of_rows(spark.read.schema(schema).parquet(*files))
    if newest is not None:
        rows = spark.read.schema(snapshot_schema or schema).parquet(f"{newest.path}/rows").unionByName(rows)
    merged = merge(rows)
    tasks = max(1, -(-rows.count() // ROWS_PER_FILE))
    (merged.coalesce(tasks).write.option("compression", "zstd").parquet(f"{target}/rows"))
    (spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(f"{target}/merged"))
