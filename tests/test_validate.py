from pyspark.sql import functions as F

from ledgerlens.functions.registry import registry
from ledgerlens.operators.validate import error_counts, validate, validation_summary
from ledgerlens.plans.journal import validate_dataset
from ledgerlens.sources.csv_ingest import ingest_csv


def _run(spark, tmp_path, data_path, mapping, name):
    raw = str(tmp_path / "raw")
    ingest_csv(spark, data_path(name), raw)
    dest = str(tmp_path / "validated")
    summary = validate_dataset(spark, raw, mapping, dest)
    return summary, spark.read.parquet(dest)


def test_valid_file_has_no_invalid_rows(spark, tmp_path, data_path, mapping):
    summary, df = _run(spark, tmp_path, data_path, mapping, "journal_valid.csv")
    assert summary == {"total_rows": 10, "invalid_rows": 0}
    assert df.columns[0] == "row_id"
    assert set(df.columns) == {"row_id", *[registry.get_field(i).canonical_name for i in mapping.values()],
                               "error_messages", "is_valid"}


def test_invalid_file_follows_the_rules(spark, tmp_path, data_path, mapping):
    summary, df = _run(spark, tmp_path, data_path, mapping, "journal_invalid.csv")
    # lines 3, 7, 9, 11 of the file = row ids 1, 5, 7, 9
    assert summary == {"total_rows": 10, "invalid_rows": 4}
    bad = {r.row_id: r.error_messages for r in df.where(~F.col("is_valid")).collect()}
    assert bad == {
        1: ["posting_date invalid date"],
        5: ["transaction_number is required"],
        7: ["debit_credit_indicator is required"],
        9: ["amount must be decimal number"],
    }
    assert df.where("is_valid").where(F.size("error_messages") != 0).count() == 0


def test_messages_in_mapping_order_required_before_type(spark):
    df = spark.createDataFrame([(None, "x", "2026-13-01", None)], "a string, b string, c string, d string")
    mapping = {"a": registry.id_of("document_number"), "b": registry.id_of("line_number"),
               "c": registry.id_of("posting_date"), "d": registry.id_of("amount")}
    row = validate(df, mapping).first()
    assert row.error_messages == ["document_number is required", "line_number must be integer",
                                  "posting_date invalid date", "amount is required"]
    assert row.is_valid is False


def test_float_rule_rejects_java_spellings(spark):
    vals = ["1.5", " -2 ", ".5", "1e3", "1.0d", "12f", "nan", "inf", "1,5", "abc", "+3.", "-"]
    df = spark.createDataFrame([(v,) for v in vals], "a string")
    out = {r.amount: r.is_valid for r in validate(df, {"a": registry.id_of("amount")}).collect()}
    assert out == {"1.5": True, " -2 ": True, ".5": True, "1e3": True, "+3.": True, "1.0d": False,
                   "12f": False, "nan": False, "inf": False, "1,5": False, "abc": False, "-": False}


def test_date_rule_is_strict(spark):
    vals = ["2026-03-01", "2026-3-1", "2026/03/01", "2026", "2026-02-30", "2026-03-01T10", " 2026-03-01 "]
    df = spark.createDataFrame([(v,) for v in vals], "a string")
    out = {r.entry_date: r.is_valid for r in validate(df, {"a": registry.id_of("entry_date")}).collect()}
    assert out == {"2026-03-01": True, "2026-3-1": False, "2026/03/01": False, "2026": False,
                   "2026-02-30": False, "2026-03-01T10": False, " 2026-03-01 ": True}


def test_str_and_datetime_fields_only_required(spark):
    df = spark.createDataFrame([("anything", None)], "a string, b string")
    m = {"a": registry.id_of("posting_time"), "b": registry.id_of("description")}
    assert validate(df, m).first().is_valid


def test_no_rules_all_valid(spark):
    df = spark.createDataFrame([(None,)], "a string")
    row = validate(df, {"a": registry.id_of("account_name")}).first()
    assert row.error_messages == [] and row.is_valid


def test_summary_and_error_counts(spark):
    df = spark.createDataFrame([(None, "x"), ("a", "1"), (None, "2")], "a string, b string")
    v = validate(df, {"a": registry.id_of("document_number"), "b": registry.id_of("line_number")})
    s = validation_summary(v).first()
    assert (s.total_rows, s.invalid_rows) == (3, 2)
    counts = {r.message: r.n_rows for r in error_counts(v).collect()}
    assert counts == {"document_number is required": 2, "line_number must be integer": 1}


def test_layout_found_from_the_whole_column(spark):
    from ledgerlens.functions import text
    df = spark.createDataFrame([("01/02/2026", "20260301", None, "2026-03-01"), ("13/02/2026", "20260302", None, "x"),
                                ("03/04/2026", "bla", None, "2026/03/05")], "a string, b string, c string, d string")
    assert text.choose_layouts(df, ["a", "b", "c", "d"]) == {
        "a": ("dd/MM/yyyy",), "b": ("yyyyMMdd",), "c": ("yyyy-MM-dd",), "d": ("yyyy-MM-dd",)}
    american = df.select(F.lit("02/13/2026").alias("a"))
    assert text.choose_layouts(american, ["a"]) == {"a": ("MM/dd/yyyy",)}


def test_finite_numbers_and_unicode_blanks(spark):
    from ledgerlens.functions import text
    df = spark.createDataFrame([("1e400",), ("-1e400",), ("1e308",), ("  4 ",), ("　5.5",)], "v string")
    assert [r[0] for r in df.select(text.parse_double(F.col("v"))).collect()] == [None, None, 1e308, 4.0, 5.5]
    assert [r[0] for r in df.select(text.parse_long(F.col("v"))).collect()] == [None, None, None, 4, None]
    assert df.select(text.strip(F.lit(" 4000 "))).first()[0] == "4000"


def test_stored_flag_equals_direct_flag(spark):
    from ledgerlens.sources import sample
    raw = sample.journal_raw(spark, "/root/testdata/sf0.001")
    a = validate(raw, sample.sample_mapping())
    b = validate(raw, sample.sample_mapping(), stored=True)
    assert a.exceptAll(b).count() == 0


def test_layouts_from_the_dictionary_of_values(spark):
    from ledgerlens.functions import text
    rows = ([("2024-01-02", " 03/04/2024 ", None)] * 50 + [("2024/01/02", "2024-13-01", "x")] * 20 + [("31/12/2023", "31/12/2023", "")])
    df = spark.createDataFrame(rows, "a string, b string, c string")
    found = text.choose_layouts(df, ["a", "b", "c"])
    assert found == {"a": ("yyyy-MM-dd",), "b": ("dd/MM/yyyy",), "c": ("yyyy-MM-dd",)}
    assert text.choose_layouts(df.where("false"), ["a"]) == {"a": ("yyyy-MM-dd",)}
    plain = {c: [df.where(text.parse_date(df[c], (f,)).isNotNull()).count() for f in text.DATE_LAYOUTS] for c in df.columns}
    assert all(found[c][0] == text.DATE_LAYOUTS[n.index(max(n))] for c, n in plain.items())


def test_summary_is_observed_while_writing(spark, tmp_path):
    from ledgerlens.operators.validate import summary_figures
    from ledgerlens.sources.observed import Figures
    df = spark.range(1000, numPartitions=7).selectExpr("id % 3 = 0 AS is_valid")
    seen = Figures(df, **summary_figures())
    seen.data.write.parquet(str(tmp_path / "t"))
    assert seen.get() == {"total_rows": 1000, "invalid_rows": 666}
