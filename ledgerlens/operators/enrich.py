"""Transform stage: valid rows -> typed, standardised rows with helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.functions import text
from ledgerlens.functions.helpers import helper_columns
from ledgerlens.functions.registry import FieldRegistry, registry as default_registry
from ledgerlens.operators.standardize import (
    cast_to_registry, keep_valid, standardize_account_codes, standardize_amounts,
)


def add_helper_columns(df: DataFrame, date_formats=text.DEFAULT_DATE_FORMATS,
                       time_format: str = text.DEFAULT_TIME_FORMAT) -> DataFrame:
    extra = helper_columns(df, date_formats, time_format)
    return df.select("*", *extra) if extra else df


def transform(validated: DataFrame, registry: FieldRegistry = default_registry,
              date_formats=text.DEFAULT_DATE_FORMATS,
              time_format: str = text.DEFAULT_TIME_FORMAT) -> DataFrame:
    """keep valid -> registry types -> amounts/indicator -> account codes -> helpers.

    All steps are projections over one scan; Catalyst collapses them into a
    single whole-stage-codegen span.
    """
    df = keep_valid(validated)
    df = cast_to_registry(df, registry, date_formats)
    df = standardize_amounts(df)
    df = standardize_account_codes(df)
    return add_helper_columns(df, date_formats, time_format)
