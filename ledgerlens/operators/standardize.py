"""Standardisation of valid rows: registry types, signed amounts, indicator,
account codes.  Pure projections (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.functions.registry import FieldRegistry, registry as default_registry
from ledgerlens.operators.mapping import DEBIT_CREDIT_GROUP, AMOUNT_INDICATOR_GROUP


class StandardizeError(ValueError):
    pass


# FIXED VALUE: message that clients of the application match.
MSG_NO_AMOUNT_COLUMNS = "Unknown debit/credit column combination."


def keep_valid(validated: DataFrame) -> DataFrame:
    """Valid rows only; the constant bookkeeping columns are dropped."""
    return validated.filter(F.col("is_valid")).drop("is_valid", "error_messages")


def cast_to_registry(df: DataFrame, registry: FieldRegistry = default_registry,
                     date_formats=text.DEFAULT_DATE_FORMATS) -> DataFrame:
    """Give every canonical column its registry type.

    Validation only proved the values parse; this performs the parse:
    integer -> bigint, float -> double, date -> date.  ``str`` and the
    time-of-day field stay text.
    """
    out = []
    for name in df.columns:
        try:
            dtype = registry.by_name(name).dtype
        except KeyError:
            dtype = None
        c = F.col(name)
        if dtype == "integer":
            out.append(text.parse_long(c).alias(name))
        elif dtype == "float":
            out.append(text.parse_double(c).alias(name))
        elif dtype == "date":
            out.append(text.parse_date(c, text.layouts_of(date_formats, name)).alias(name))
        else:
            out.append(c)
    return df.select(*out)


def standardize_amounts(df: DataFrame) -> DataFrame:
    """Signed ``amount`` and a ``debit_credit_indicator`` of D / C / N / UNKNOWN.

    Separate debit/credit columns win when both are present: amount =
    debit - |credit| (nulls as 0) and the indicator follows its sign
    (UNKNOWN when both sides are null).  Otherwise the indicator text is
    normalised from its first letter.  Finally D forces a positive and C a
    negative amount.
    """
    cols = set(df.columns)
    ind = F.col("debit_credit_indicator")
    if set(DEBIT_CREDIT_GROUP) <= cols:
        debit, credit = F.col("debit_amount"), F.col("credit_amount")
        signed = F.coalesce(debit, F.lit(0.0)) - F.coalesce(F.abs(credit), F.lit(0.0))
        indicator = (F.when(debit.isNull() & credit.isNull(), F.lit("UNKNOWN"))
                     .when(signed > 0, F.lit("D"))
                     .when(signed < 0, F.lit("C"))
                     .otherwise(F.lit("N")))
        df = (df.withColumn("amount", signed)
                .withColumn("debit_credit_indicator", indicator)
                .drop(*DEBIT_CREDIT_GROUP))
    elif set(AMOUNT_INDICATOR_GROUP) <= cols:
        first = F.substring(F.lower(text.strip(ind)), 1, 1)
        df = df.withColumn(
            "debit_credit_indicator",
            F.when(first == "c", F.lit("C")).when(first == "d", F.lit("D")).otherwise(F.lit("UNKNOWN")))
    else:
        raise StandardizeError(MSG_NO_AMOUNT_COLUMNS)

    amount = F.col("amount")
    return df.withColumn(
        "amount",
        F.when(ind == "D", F.abs(amount))
         .when(ind == "C", -F.abs(amount) + F.lit(0.0))   # + 0.0 turns -0.0 into 0.0
         .otherwise(amount))


def standardize_account_codes(df: DataFrame) -> DataFrame:
    """Account codes as trimmed upper-case text."""
    for name in ("account_number", "offset_account_number"):
        if name in df.columns:
            df = df.withColumn(name, F.upper(text.strip(F.col(name))))
    return df
