"""Parquet scan and sink.

Reads are lazy scans: Catalyst pushes filters (``PushedFilters``) and prunes
columns (``ReadSchema``) into them.  Writes go through Spark's commit
protocol, so a lost executor's partial output never becomes visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else list(path)))


def sink_parquet(df: DataFrame, path: str, *, compression: str = "zstd", mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Write ``df`` as Parquet; ``partition_by`` enables directory pruning on
    later filters (e.g. posting year/month for date-bounded views)."""
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
