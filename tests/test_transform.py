import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.registry import registry
from ledgerlens.operators.enrich import transform
from ledgerlens.operators.standardize import StandardizeError, standardize_amounts
from ledgerlens.operators.validate import validate
from ledgerlens.plans.journal import run_journal


def _t(spark, rows, schema, names):
    df = spark.createDataFrame(rows, schema)
    mapping = {c: registry.id_of(n) for c, n in zip(df.columns, names)}
    return transform(validate(df, mapping))


def test_end_to_end_fixture(spark, tmp_path, data_path, mapping):
    run = run_journal(spark, data_path("journal_invalid.csv"), mapping, str(tmp_path), "ds1")
    assert run.summary == {"total_rows": 10, "invalid_rows": 4}
    t = spark.read.parquet(run.transformed_path)
    assert t.count() == 6
    types = dict(t.dtypes)
    assert types["amount"] == "double" and types["line_number"] == "bigint" and types["posting_date"] == "date"
    r = t.where("document_number = 'JE100'").first()
    assert (r.amount, r.debit_credit_indicator, r.account_number) == (1250.5, "D", "0100")
    assert (r.abs_amount, r.amount_sign, r.first_digit, r.first_two_digits) == (1250.5, 1, "1", "12")
    assert (r.posting_year, r.posting_month, r.posting_day, r.posting_weekday) == (2025, 7, 1, 2)
    assert run.view["signature"] and run.view["dimensions"] == []


def test_indicator_normalisation_and_sign(spark):
    rows = [("1", " Debit", "-5"), ("2", "credit ", "7"), ("3", "\tc", "0"), ("4", "?", "-3"), ("5", "d", "0")]
    t = _t(spark, rows, "d string, i string, a string", ["document_number", "debit_credit_indicator", "amount"])
    got = {r.document_number: (r.debit_credit_indicator, r.amount) for r in t.collect()}
    assert got["1"] == ("D", 5.0)
    assert got["2"] == ("C", -7.0)
    assert got["3"][0] == "C" and math.copysign(1, got["3"][1]) == 1.0   # no -0.0
    assert got["4"] == ("UNKNOWN", -3.0)
    assert got["5"] == ("D", 0.0)


def test_debit_credit_columns(spark):
    rows = [("1", "100", None), ("2", None, "40"), ("3", None, "-40"), ("4", None, None), ("5", "10", "10")]
    t = _t(spark, rows, "d string, dr string, cr string", ["document_number", "debit_amount", "credit_amount"])
    got = {r.document_number: (r.amount, r.debit_credit_indicator) for r in t.collect()}
    assert got == {"1": (100.0, "D"), "2": (-40.0, "C"), "3": (-40.0, "C"), "4": (0.0, "UNKNOWN"), "5": (0.0, "N")}
    assert "debit_amount" not in t.columns and "credit_amount" not in t.columns


def test_no_amount_columns_refused(spark):
    df = spark.createDataFrame([("1",)], "document_number string")
    with pytest.raises(StandardizeError):
        standardize_amounts(df)


def test_helpers(spark):
    rows = [("1", "D", "0.5", "2026-03-01", "23:59:58", "héllo", None),
            ("2", "C", "98765.4", "2026-03-08", "bad", None, "R")]
    names = ["document_number", "debit_credit_indicator", "amount", "posting_date", "posting_time",
             "description", "reference"]
    t = _t(spark, rows, "a string, b string, c string, d string, e string, f string, g string", names)
    r1, r2 = sorted(t.collect(), key=lambda r: r.document_number)
    assert (r1.first_digit, r1.first_two_digits, r1.amount_sign) == ("0", "0", 1)
    assert (r2.first_digit, r2.first_two_digits, r2.amount_sign) == ("9", "98", -1)
    assert (r1.posting_weekday, r2.posting_weekday) == (7, 7)          # Sundays
    assert (r1.posting_hour, r1.posting_minute, r2.posting_hour) == (23, 59, None)
    assert (r1.description_length, r1.has_description, r2.has_description) == (5, True, False)
    assert (r1.has_reference, r2.has_reference) == (False, True)


def test_account_codes_trimmed_upper(spark):
    rows = [("1", "D", "1", " ab-01\t", "x ")]
    t = _t(spark, rows, "a string, b string, c string, d string, e string",
           ["document_number", "debit_credit_indicator", "amount", "account_number", "offset_account_number"])
    r = t.first()
    assert (r.account_number, r.offset_account_number) == ("AB-01", "X")


def test_extra_date_layouts(spark):
    import datetime as dt
    fmts = ("yyyy-MM-dd", "dd.MM.yyyy")
    df = spark.createDataFrame([("1", "D", "5", "01.03.2026"), ("2", "D", "5", "2026-03-02"), ("3", "D", "5", "3/4/2026")],
                               "a string, b string, c string, d string")
    mapping = {c: registry.id_of(n) for c, n in zip(df.columns, ["document_number", "debit_credit_indicator",
                                                                  "amount", "posting_date"])}
    v = validate(df, mapping, date_formats=fmts)
    assert {r.document_number: r.is_valid for r in v.collect()} == {"1": True, "2": True, "3": False}
    t = transform(v, date_formats=fmts)
    got = {r.document_number: (r.posting_date, r.posting_weekday) for r in t.collect()}
    assert got == {"1": (dt.date(2026, 3, 1), 7), "2": (dt.date(2026, 3, 2), 1)}
