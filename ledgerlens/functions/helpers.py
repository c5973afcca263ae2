"""Helper (analysis) columns added after standardisation.

Every helper is a native expression; each group is added only when its
source column exists in the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import text


def _as_date(df: DataFrame, name: str, formats) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.col(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(F.col(name))
    return text.parse_date(F.col(name), text.layouts_of(formats, name))


def monetary(amount: Column) -> list[Column]:
    whole = F.abs(amount).try_cast("bigint").cast("string")
    return [
        F.abs(amount).alias("abs_amount"),
        F.when(amount > 0, F.lit(1)).otherwise(F.lit(-1)).alias("amount_sign"),
        F.substring(whole, 1, 1).alias("first_digit"),
        F.substring(whole, 1, 2).alias("first_two_digits"),
    ]


def date_parts(d: Column) -> list[Column]:
    return [
        F.year(d).alias("posting_year"),
        F.month(d).alias("posting_month"),
        F.dayofmonth(d).alias("posting_day"),
        # weekday(): Monday 0 .. Sunday 6  ->  ISO Monday 1 .. Sunday 7
        (F.weekday(d) + 1).alias("posting_weekday"),
    ]


def time_parts(col: Column, fmt: str = text.DEFAULT_TIME_FORMAT) -> list[Column]:
    hour, minute = text.time_of_day_parts(col, fmt)
    return [hour.alias("posting_hour"), minute.alias("posting_minute")]


def helper_columns(df: DataFrame, date_formats=text.DEFAULT_DATE_FORMATS,
                   time_format: str = text.DEFAULT_TIME_FORMAT) -> list[Column]:
    cols = set(df.columns)
    out: list[Column] = []
    if "amount" in cols:
        out += monetary(F.col("amount"))
    if "posting_date" in cols:
        out += date_parts(_as_date(df, "posting_date", date_formats))
    if "posting_time" in cols:
        out += time_parts(F.col("posting_time"), time_format)
    if "description" in cols:
        out += [F.char_length("description").alias("description_length"),
                F.col("description").isNotNull().alias("has_description")]
    if "reference" in cols:
        out += [F.col("reference").isNotNull().alias("has_reference")]
    return out
