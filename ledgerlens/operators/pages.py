"""Raw data pages and display type labels.

A page is a ``row_id`` range: ids are consecutive from 0, so the range
filter is pushed into the Parquet scan and row groups outside it are
skipped by their statistics; no sort of the whole table is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_PAGE = 50
MAX_PAGE = 500


def type_label(dtype: T.DataType) -> str:
    """Physical type -> display type (str, integer, float, date, datetime, boolean, unknown)."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "str"
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    # timestamps before dates: a timestamp is a "datetime", not a "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "unknown"


def column_types(df: DataFrame, hide=("row_id",)) -> list[dict]:
    return [{"name": f.name, "dtype": type_label(f.dataType)} for f in df.schema.fields if f.name not in hide]


def raw_page(df: DataFrame, offset: int = 0, limit: int = DEFAULT_PAGE, row_count: int | None = None) -> dict:
    """Page of a dataset with ``row_id``: rows [offset, offset+limit) in file order."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    page = (df.where((F.col("row_id") >= offset) & (F.col("row_id") < offset + limit))
              .orderBy("row_id"))
    if row_count is None:
        row_count = df.count()
    return {
        "offset": offset,
        "limit": limit,
        "row_count": row_count,
        "columns": column_types(df),
        "data": page.drop("row_id"),
        "has_next": offset + limit < row_count,
    }


def raw_dataset_page(spark, raw_path: str, offset: int = 0, limit: int = DEFAULT_PAGE,
                     row_count: int | None = None) -> dict:
    """Page of an ingested raw dataset; the row range becomes a scan filter."""
    from ledgerlens.sources.csv_ingest import _HELPERS, raw_rows
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    if row_count is None:
        row_count = int(spark.read.parquet(f"{raw_path.rstrip('/')}/_row_offsets")
                        .agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0])
    schema_df = spark.read.parquet(raw_path).drop(*_HELPERS)     # schema from the footers, no job
    return {
        "offset": offset,
        "limit": limit,
        "row_count": row_count,
        "columns": column_types(schema_df),
        "data": raw_rows(spark, raw_path, offset, limit).drop("row_id"),
        "has_next": offset + limit < row_count,
    }
