"""Scalar text/parse expressions shared by the validation and transform stages.

All are native Catalyst expressions with code generation (no Python UDFs,
no higher-order functions, no per-value regex where a plain string test
does), so whole-stage codegen covers the stage.  User data is always
parsed with ``try_*`` variants: ANSI mode is on by default and a plain cast
of 'abc' would fail the job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: accepted layouts.
# Decimal literal accepted by the float rule (after trimming): optional sign,
# digits with optional fraction or a bare fraction, optional exponent.
NUMERIC_LITERAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Default date layout for posting/entry dates, and the time-of-day layout.
DEFAULT_DATE_FORMATS = ("yyyy-MM-dd",)
DEFAULT_TIME_FORMAT = "HH:mm:ss"

# Layouts tried on a date column when none is given, most usual first.
DATE_LAYOUTS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd",
                "MM/dd/yyyy")

# White space removed at both ends of text values: Unicode's White_Space.
WHITESPACE = (" \t\n\r\f\u000b\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")
_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_HMS = r"^[0-9]{2}:[0-9]{2}:[0-9]{2}$"


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace, tabs included (no regex)."""
    return F.btrim(col.cast("string"), F.lit(WHITESPACE))


def parse_long(col: Column) -> Column:
    """Text -> bigint, null when not an integer literal."""
    return strip(col).try_cast("bigint")


def parse_double(col: Column) -> Column:
    """Text -> double, null unless it is a plain decimal literal of a finite value.

    ``try_cast`` alone accepts Java spellings such as ``1.0d``, ``12f``,
    ``nan`` and ``inf``; the literal pattern rules those out.
    """
    trimmed = strip(col)
    value = trimmed.try_cast("double")
    return F.when(trimmed.rlike(NUMERIC_LITERAL) & (F.abs(value) < float("inf")), value)


def _parse_one_date(text: Column, fmt: str) -> Column:
    if fmt == "yyyy-MM-dd":
        # Same result as the strict formatter (4-digit year, 2-digit month
        # and day, real calendar date) through the cheap built-in cast.
        return F.when(text.rlike(_ISO_DATE), text.try_cast("date"))
    return F.try_to_date(text, fmt)


def layouts_of(formats, name: str):
    """The layouts of one column: ``formats`` is a sequence for all columns, or
    a mapping by canonical name."""
    if isinstance(formats, Mapping):
        return formats.get(name, DEFAULT_DATE_FORMATS)
    return formats


def choose_layouts(df: DataFrame, columns: list[str], layouts=DATE_LAYOUTS) -> dict[str, tuple[str]]:
    """For every text column, the layout that parses most of its values (ties:
    the earlier one), found from the whole columns.

    The columns' different texts are counted first (partially in every task),
    so each is parsed once however often it occurs; per layout the counts of
    the texts it parses are summed.
    """
    if not columns:
        return {}
    entries = F.array(*[F.struct(F.lit(i).alias("at"), strip(F.col(c)).alias("value")) for i, c in enumerate(columns)])
    dictionary = (df.select(F.explode(entries).alias("e")).select("e.at", "e.value").where(F.col("value").isNotNull())
                  .groupBy("at", "value").agg(F.count(F.lit(1)).alias("n")))
    parsed = [F.coalesce(F.sum(F.when(_parse_one_date(F.col("value"), f).isNotNull(), F.col("n"))), F.lit(0)).alias(str(j))
              for j, f in enumerate(layouts)]
    found = {r["at"]: r for r in dictionary.groupBy("at").agg(*parsed).collect()}       # one row a column
    none = {str(j): 0 for j in range(len(layouts))}
    return {c: (max(enumerate(layouts), key=lambda x: (found.get(i, none)[str(x[0])], -x[0]))[1],) for i, c in enumerate(columns)}


def parse_date(col: Column, formats=DEFAULT_DATE_FORMATS) -> Column:
    """Text -> date using the first layout that parses, else null."""
    text = strip(col)
    parsed = [_parse_one_date(text, fmt) for fmt in formats]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def time_of_day_parts(col: Column, fmt: str = DEFAULT_TIME_FORMAT) -> tuple[Column, Column]:
    """(hour, minute) of a time-of-day text, both null when it does not parse."""
    text = strip(col)
    if fmt == "HH:mm:ss":
        hour = text.substr(1, 2).try_cast("int")
        minute = text.substr(4, 2).try_cast("int")
        second = text.substr(7, 2).try_cast("int")
        ok = (text.rlike(_HMS) & (hour <= 23) & (minute <= 59) & (second <= 59))
        return F.when(ok, hour), F.when(ok, minute)
    ts = F.try_to_timestamp(text, F.lit(fmt))
    return F.hour(ts), F.minute(ts)
