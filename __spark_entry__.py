"""

Every query reads the driver's tables (``lineitem``, ``orders``, ``events``)
through the projections in ``ledgerlens.sources.sample`` and runs the whole
table; the oracle SQL restates the same projection and semantics in DuckDB.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from ledgerlens.functions.registry import registry  # noqa: E402
from ledgerlens.operators.enrich import transform  # noqa: E402
from ledgerlens.operators.exact_sum import exact_sums  # noqa: E402
from ledgerlens.operators.validate import error_counts, validate, validation_summary  # noqa: E402
from ledgerlens.operators.view import compile_view  # noqa: E402
from ledgerlens.plans import views as V  # noqa: E402
from ledgerlens.plans.journal import query_view  # noqa: E402
from ledgerlens.operators import catalog as C  # noqa: E402
from ledgerlens.sources import sample  # noqa: E402
from ledgerlens.sources import sample_catalog as SC  # noqa: E402
from ledgerlens.session import scratch_path  # noqa: E402
from ledgerlens.sources.csv_ingest import ingest_csv, read_raw  # noqa: E402
from ledgerlens.sources.fingerprint import fingerprint_frame  # noqa: E402
from ledgerlens.sources.parquet_io import sink_parquet  # noqa: E402
from oracle_catalog import catalog_oracle  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


def _training_data():
    """Queries and oracle SQL of the training-data operators; none if their
    subpackage has been taken out.  Other import errors are errors."""
    try:
        import corpus_pipeline
        from ledgerlens.llm.queries import ORACLE, QUERIES
    except ModuleNotFoundError as e:
        if e.name not in ("corpus_pipeline", "ledgerlens.llm", "ledgerlens.llm.queries"):
            raise
        return {}, {}
    sql = dict(ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**QUERIES, "pipeline": corpus_pipeline.run}, sql


# --------------------------------------------------------------------- spark
def _validated(spark, sf_dir):
    return validate(sample.journal_raw(spark, sf_dir), sample.sample_mapping())


def _transformed(spark, sf_dir):
    return transform(validate(sample.journal_raw(spark, sf_dir), sample.sample_mapping(), filtered=True))


def _transformed_dc(spark, sf_dir):
    return transform(validate(sample.journal_raw_debit_credit(spark, sf_dir), sample.debit_credit_mapping(), filtered=True))


def _view(name):
    return lambda spark, sf_dir: compile_view(_transformed(spark, sf_dir), V.VIEWS[name])


def q_validate_summary(spark, sf_dir):
    return validation_summary(_validated(spark, sf_dir))


def q_validate_error_counts(spark, sf_dir):
    return error_counts(_validated(spark, sf_dir))


def q_validate_error_lists(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return (v.groupBy(F.array_join("error_messages", "|").alias("error_list"), "is_valid")
             .agg(F.count(F.lit(1)).alias("n_rows")))


def q_validate_debit_credit_error_counts(spark, sf_dir):
    v = validate(sample.journal_raw_debit_credit(spark, sf_dir), sample.debit_credit_mapping())
    return error_counts(v)


def q_validated_rows(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.select(*[c for c in v.columns if c != "error_messages"],
                    F.array_join("error_messages", "|").alias("error_list"))


def q_transform_rows(spark, sf_dir):
    return _transformed(spark, sf_dir)


def q_transform_debit_credit_rows(spark, sf_dir):
    return _transformed_dc(spark, sf_dir)


def _text_stats(df, cols):
    """Integrity figures of text columns: non-null count and total length."""
    out = []
    for c in cols:
        out += [F.count(c).alias(f"{c}_n"), F.sum(F.length(c)).alias(f"{c}_len")]
    return out


def q_ingest_roundtrip(spark, sf_dir):
    """Sample journal exported as CSV, ingested back: rows, ids and text intact."""
    work = scratch_path(spark, "ingest-roundtrip")
    # Some account names break over two lines inside their quotes.
    broken = F.when(F.col("Currency") == "EUR", F.concat("AccountName", F.lit('\n"second", line'))).otherwise(F.col("AccountName"))
    sample.write_csv_export(sample.journal_raw(spark, sf_dir).withColumn("AccountName", broken), f"{work}/export")
    res = ingest_csv(spark, f"{work}/export", f"{work}/raw")
    raw = read_raw(spark, res.path)
    cols = [c for c in raw.columns if c != "row_id"]
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("row_id_sum"),
                   F.min("row_id").alias("row_id_min"), F.max("row_id").alias("row_id_max"),
                   *_text_stats(raw, cols))


def _sorted_ingest(spark, sf_dir, name):
    """The sample journal exported in a total order (so that file order has a
    SQL form) and ingested."""
    work = scratch_path(spark, name)
    sample.write_csv_export(sample.journal_sorted(spark, sf_dir), f"{work}/export")
    return ingest_csv(spark, f"{work}/export", f"{work}/raw")


def q_ingest_raw_page(spark, sf_dir):
    """A raw page (rows 1000-1049 in file order) of the ingested export."""
    from ledgerlens.operators.pages import raw_dataset_page
    res = _sorted_ingest(spark, sf_dir, "raw-page")
    page = raw_dataset_page(spark, res.path, offset=1000, limit=50, row_count=res.row_count)
    return page["data"].withColumn("has_next", F.lit(page["has_next"]))


def q_ingest_preview(spark, sf_dir):
    """The upload answer: the first 50 rows, with the row count."""
    res = _sorted_ingest(spark, sf_dir, "preview")
    return res.preview.withColumn("row_count", F.lit(res.row_count).cast("bigint"))


def q_dataset_fingerprint(spark, sf_dir):
    return fingerprint_frame(sample.journal_raw(spark, sf_dir))


_SAVE_KEYS = ("dataset_id", "save_no")


def _valid_saves(spark, sf_dir):
    saves = C.checked_saves(SC.mappings(spark, sf_dir), SC.save_times(spark, sf_dir), keys=_SAVE_KEYS)
    return saves.where(F.col("rule") == 0).select(*_SAVE_KEYS, "mapping", "saved_at")


def _signature_mappings(spark, sf_dir):
    return C.signature_mappings(_valid_saves(spark, sf_dir), SC.datasets(spark, sf_dir))


def q_catalog_header_signatures(spark, sf_dir):
    return (SC.datasets(spark, sf_dir).groupBy("signature")
            .agg(F.count(F.lit(1)).alias("n_datasets"),
                 F.min("header_variant").alias("min_variant"), F.max("header_variant").alias("max_variant")))


def q_catalog_mapping_violations(spark, sf_dir):
    return C.mapping_violations(SC.mappings(spark, sf_dir), keys=_SAVE_KEYS)


def q_catalog_mapping_status(spark, sf_dir):
    return C.mapping_status(SC.mappings(spark, sf_dir), keys=_SAVE_KEYS)


def q_catalog_current_mappings(spark, sf_dir):
    cur = C.current_mappings(_valid_saves(spark, sf_dir))
    return cur.select("dataset_id", C.mapping_text(F.col("mapping")).alias("mapping"), "saved_at")


def q_catalog_signature_mappings(spark, sf_dir):
    sig = _signature_mappings(spark, sf_dir)
    return sig.select("signature", C.mapping_text(F.col("mapping")).alias("mapping"), "saved_at")


def q_catalog_suggested_mappings(spark, sf_dir):
    sug = C.suggested_mappings(SC.datasets(spark, sf_dir), _signature_mappings(spark, sf_dir))
    return sug.select("dataset_id", C.mapping_text(F.col("suggested_mapping")).alias("suggested_mapping"))


def q_catalog_latest_dataset(spark, sf_dir):
    return C.latest_dataset_per_user(SC.datasets(spark, sf_dir))


def q_catalog_views(spark, sf_dir):
    return C.view_catalog(SC.view_accesses(spark, sf_dir))


def q_catalog_view_lineage(spark, sf_dir):
    """Root and depth of every view by its parents; circles marked."""
    return C.view_lineage(SC.view_parents(spark, sf_dir))


def q_exact_charge_totals(spark, sf_dir):
    """Charges (price after discount, with tax) summed exactly by return flag and line status."""
    charge = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) * (F.lit(1.0) + F.col("l_tax"))
    lines = sample.read_table(spark, sf_dir, "lineitem").withColumn("charge", charge)
    return exact_sums(lines, ["l_returnflag", "l_linestatus"], {"charge_sum": "charge", "discount_sum": "l_discount"})


def q_view_distinct_counts(spark, sf_dir):
    """Distinct counts of all three measures, beside other aggregates, over a stored transformed table."""
    path = scratch_path(spark, "distinct-counts")
    sink_parquet(_transformed(spark, sf_dir), path)
    return query_view(spark, path, V.DISTINCT_COUNTS)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: raw lines -> validate -> transform -> view (sum and count of
    amount by indicator and posting month, OR-group amount range)."""
    return compile_view(_transformed(spark, SMOKE_DIR), V.VIEWS["view_flagship"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        "validate_summary": q_validate_summary,
        "validate_error_counts": q_validate_error_counts,
        "validate_error_lists": q_validate_error_lists,
        "validate_debit_credit_error_counts": q_validate_debit_credit_error_counts,
        "validated_rows": q_validated_rows,
        "transform_rows": q_transform_rows,
        "transform_debit_credit_rows": q_transform_debit_credit_rows,
    }
    for name in V.VIEWS:
        q[name] = _view(name)
    q.update({
        "view_distinct_counts": q_view_distinct_counts,
        "exact_charge_totals": q_exact_charge_totals,
        "ingest_roundtrip": q_ingest_roundtrip,
        "dataset_fingerprint": q_dataset_fingerprint,
        "ingest_raw_page": q_ingest_raw_page,
        "ingest_preview": q_ingest_preview,
        "catalog_header_signatures": q_catalog_header_signatures,
        "catalog_mapping_violations": q_catalog_mapping_violations,
        "catalog_mapping_status": q_catalog_mapping_status,
        "catalog_current_mappings": q_catalog_current_mappings,
        "catalog_signature_mappings": q_catalog_signature_mappings,
        "catalog_suggested_mappings": q_catalog_suggested_mappings,
        "catalog_latest_dataset": q_catalog_latest_dataset,
        "catalog_views": q_catalog_views,
        "catalog_view_lineage": q_catalog_view_lineage,
    })
    q.update(_training_data()[0])
    return q


# -------------------------------------------------------------------- oracle
_BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TRIM = f"regexp_replace({{c}}, '^{_BLANK.replace('{', '{{').replace('}', '}}')}|{_BLANK.replace('{', '{{').replace('}', '}}')}$', '', 'g')"


def _trim(c):
    return _TRIM.format(c=c)


_NUMERIC = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

_RAW_COMMON = """
    'DOC' || CAST(l_orderkey AS VARCHAR) AS DocumentNo,
    CASE WHEN l_orderkey % 89 = 0 THEN NULL
         ELSE 'TXN' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS TransactionNo,
    CASE WHEN l_orderkey % 79 = 0 THEN 'x'
         WHEN l_orderkey % 101 = 0 THEN CAST(l_linenumber AS VARCHAR) || '.0'
         WHEN l_orderkey % 103 = 0 THEN ' ' || CAST(l_linenumber AS VARCHAR) || ' '
         ELSE CAST(l_linenumber AS VARCHAR) END AS LineNo,
    CASE WHEN l_orderkey % 97 = 0 THEN 'bla' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS PostingDate,
    CASE WHEN l_orderkey % 61 = 0 THEN NULL
         ELSE strftime(CAST(l_shipdate AS DATE) - CAST(l_orderkey % 3 AS INTEGER), '%Y-%m-%d') END AS EntryDate,
    CASE WHEN l_orderkey % 71 = 0 THEN 'xx'
         ELSE lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0')
              || ':00' END AS PostingTime,"""

_RAW_TAIL = """
    CASE WHEN l_returnflag = 'A' THEN 'EUR' ELSE 'USD' END AS Currency,
    CASE WHEN l_orderkey % 113 = 0 THEN chr(160) ELSE ' ' END || 'acc-' || CAST(l_partkey AS VARCHAR) AS Account,
    'Account ' || CAST(l_partkey % 100 AS VARCHAR) AS AccountName,
    'acc-' || CAST(l_suppkey AS VARCHAR) || ' ' AS OffsetAccount,
    'USR' || lpad(CAST(l_suppkey % 25 AS VARCHAR), 2, '0') AS CreatedBy,
    'APR' || CAST(l_partkey % 7 AS VARCHAR) AS ApprovedBy,
    CASE l_orderkey % 3 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Pending' ELSE 'Rejected' END AS ApprovalStatus,
    CASE WHEN l_returnflag = 'R' THEN 'Manual' ELSE 'System' END AS JournalType,
    CASE WHEN l_linestatus = 'O' THEN 'Revenue' ELSE 'Invoice' END AS Category,
    CASE WHEN l_quantity > 40 THEN NULL ELSE 'qty ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS Text,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE 'INV' || CAST(l_orderkey AS VARCHAR) END AS Reference,
    CAST(l_linenumber AS VARCHAR) AS SourceLine"""

_CENTS = "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)"

_RAW_SQL = f"""raw AS (
  SELECT {_RAW_COMMON}
    CASE WHEN l_orderkey % 83 = 0 THEN 'abc' WHEN l_orderkey % 109 = 0 THEN 'nan'
         WHEN l_orderkey % 107 = 0 THEN ' ' || {_CENTS} || '.50 '
         WHEN l_orderkey % 127 = 0 THEN '1e400' ELSE {_CENTS} END AS Amount,
    CASE WHEN l_orderkey % 73 = 0 THEN NULL WHEN l_partkey % 50 = 0 THEN '?'
         WHEN l_linenumber = 7 THEN chr(9) || 'dr'
         WHEN l_linenumber = 6 THEN chr(8195) || 'Credit' || chr(160)
         WHEN l_linestatus = 'O' THEN ' Debit' ELSE 'credit ' END AS DrCr,{_RAW_TAIL}
  FROM lineitem)"""

_RAW_DC_SQL = f"""raw AS (
  SELECT {_RAW_COMMON}
    CASE WHEN l_orderkey % 67 = 0 OR l_linestatus <> 'O' THEN NULL
         WHEN l_orderkey % 83 = 0 THEN 'n/a' ELSE {_CENTS} END AS Debit,
    CASE WHEN l_orderkey % 67 = 0 OR l_linestatus = 'O' THEN NULL
         WHEN l_linenumber = 3 THEN '-' || {_CENTS} ELSE {_CENTS} END AS Credit,{_RAW_TAIL}
  FROM lineitem)"""


def _sql_rules(mapping_header):
    """DuckDB list of rule messages in mapping order (mirrors functions.rules)."""
    parts = []
    for raw, name in mapping_header.items():
        f = registry.by_name(name)
        if f.is_required:
            parts.append(f"CASE WHEN {raw} IS NULL THEN '{name} is required' END")
        if f.dtype == "integer":
            parts.append(f"CASE WHEN {raw} IS NOT NULL AND (NOT regexp_full_match({_trim(raw)}, '[+-]?[0-9]+') "
                         f"OR TRY_CAST({_trim(raw)} AS BIGINT) IS NULL) "
                         f"THEN '{name} must be integer' END")
        elif f.dtype == "float":
            parts.append(f"CASE WHEN {raw} IS NOT NULL AND NOT (regexp_full_match({_trim(raw)}, '{_NUMERIC}') "
                         f"AND coalesce(isfinite(TRY_CAST({_trim(raw)} AS DOUBLE)), FALSE)) "
                         f"THEN '{name} must be decimal number' END")
        elif f.dtype == "date":
            parts.append(f"CASE WHEN {raw} IS NOT NULL AND TRY_STRPTIME({_trim(raw)}, '%Y-%m-%d') IS NULL "
                         f"THEN '{name} invalid date' END")
    return "list_filter([" + ",\n      ".join(parts) + "], lambda x: x IS NOT NULL)"


def _sql_validated(header):
    cols = ", ".join(f"{raw} AS {name}" for raw, name in header.items())
    return f"""checked AS (
  SELECT *, {_sql_rules(header)} AS errs FROM raw),
validated AS (
  SELECT {cols}, array_to_string(errs, '|') AS error_list, len(errs) = 0 AS is_valid FROM checked)"""


def _sql_typed(dc: bool):
    money = ("""coalesce(CAST({t} AS DOUBLE), 0.0) - coalesce(abs(CAST({c} AS DOUBLE)), 0.0) AS amount,
    CASE WHEN debit_amount IS NULL AND credit_amount IS NULL THEN 'UNKNOWN'
         WHEN coalesce(CAST({t} AS DOUBLE), 0.0) - coalesce(abs(CAST({c} AS DOUBLE)), 0.0) > 0 THEN 'D'
         WHEN coalesce(CAST({t} AS DOUBLE), 0.0) - coalesce(abs(CAST({c} AS DOUBLE)), 0.0) < 0 THEN 'C'
         ELSE 'N' END AS debit_credit_indicator"""
             .format(t=_trim("debit_amount"), c=_trim("credit_amount"))) if dc else (
        f"""CAST({_trim('amount')} AS DOUBLE) AS amount,
    CASE substr(lower({_trim('debit_credit_indicator')}), 1, 1) WHEN 'c' THEN 'C' WHEN 'd' THEN 'D'
         ELSE 'UNKNOWN' END AS debit_credit_indicator""")
    return f"""typed AS (
  SELECT document_number, transaction_number, CAST({_trim('line_number')} AS BIGINT) AS line_number,
    CAST(TRY_STRPTIME({_trim('posting_date')}, '%Y-%m-%d') AS DATE) AS posting_date,
    CAST(TRY_STRPTIME({_trim('entry_date')}, '%Y-%m-%d') AS DATE) AS entry_date,
    posting_time,
    {money},
    currency, upper({_trim('account_number')}) AS account_number, account_name,
    upper({_trim('offset_account_number')}) AS offset_account_number,
    user_id, approver_id, approval_status, journal_type, journal_category, description, reference
  FROM validated WHERE is_valid),
signed AS (
  SELECT * REPLACE (CASE WHEN debit_credit_indicator = 'D' THEN abs(amount)
                         WHEN debit_credit_indicator = 'C' THEN -abs(amount) + 0.0
                         ELSE amount END AS amount)
  FROM typed),
transformed AS (
  SELECT *,
    abs(amount) AS abs_amount,
    CAST(CASE WHEN amount > 0 THEN 1 ELSE -1 END AS INTEGER) AS amount_sign,
    substr(CAST(CAST(trunc(abs(amount)) AS BIGINT) AS VARCHAR), 1, 1) AS first_digit,
    substr(CAST(CAST(trunc(abs(amount)) AS BIGINT) AS VARCHAR), 1, 2) AS first_two_digits,
    CAST(year(posting_date) AS INTEGER) AS posting_year,
    CAST(month(posting_date) AS INTEGER) AS posting_month,
    CAST(day(posting_date) AS INTEGER) AS posting_day,
    CAST(isodow(posting_date) AS INTEGER) AS posting_weekday,
    CAST(hour(TRY_STRPTIME({_trim('posting_time')}, '%H:%M:%S')) AS INTEGER) AS posting_hour,
    CAST(minute(TRY_STRPTIME({_trim('posting_time')}, '%H:%M:%S')) AS INTEGER) AS posting_minute,
    CAST(length(description) AS INTEGER) AS description_length,
    description IS NOT NULL AS has_description,
    reference IS NOT NULL AS has_reference
  FROM signed)"""


_WITH_VALIDATED = f"WITH {_RAW_SQL},\n{_sql_validated(sample.SAMPLE_HEADER)}\n"
_WITH_TRANSFORMED = f"{_WITH_VALIDATED.rstrip()},\n{_sql_typed(False)}\n"
_WITH_TRANSFORMED_DC = (f"WITH {_RAW_DC_SQL},\n{_sql_validated(sample.DEBIT_CREDIT_HEADER)},\n"
                        f"{_sql_typed(True)}\n")


def oracle_sql() -> dict[str, str]:
    sql = {
        "validate_summary": _WITH_VALIDATED + """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE NOT is_valid) AS invalid_rows FROM validated""",
        "validate_error_counts": f"WITH {_RAW_SQL},\n" + f"""checked AS (SELECT {_sql_rules(sample.SAMPLE_HEADER)} AS errs FROM raw)
SELECT message, count(*) AS n_rows FROM (SELECT unnest(errs) AS message FROM checked) GROUP BY message""",
        "validate_debit_credit_error_counts": f"WITH {_RAW_DC_SQL},\n" + f"""checked AS (
  SELECT {_sql_rules(sample.DEBIT_CREDIT_HEADER)} AS errs FROM raw)
SELECT message, count(*) AS n_rows FROM (SELECT unnest(errs) AS message FROM checked) GROUP BY message""",
        "validate_error_lists": _WITH_VALIDATED + """
SELECT error_list, is_valid, count(*) AS n_rows FROM validated GROUP BY error_list, is_valid""",
        "validated_rows": _WITH_VALIDATED + "SELECT * FROM validated",
        "transform_rows": _WITH_TRANSFORMED + "SELECT * FROM transformed",
        "transform_debit_credit_rows": _WITH_TRANSFORMED_DC + "SELECT * FROM transformed",
    }
    for name, body in V.ORACLE.items():
        sql[name] = _WITH_TRANSFORMED + body
    sql["view_distinct_counts"] = _WITH_TRANSFORMED + V.DISTINCT_COUNTS_ORACLE
    sql.update(catalog_oracle())
    text = [c for c in list(sample.SAMPLE_HEADER) + list(sample.UNMAPPED_COLUMNS)]
    stats = ", ".join(f"count({c}) AS {c}_n, CAST(sum(length({c})) AS BIGINT) AS {c}_len" for c in text)
    sql["ingest_roundtrip"] = f"WITH {_RAW_SQL}\n" + f"""
SELECT count(*) AS n_rows, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS row_id_sum,
       CAST(0 AS BIGINT) AS row_id_min, CAST(count(*) - 1 AS BIGINT) AS row_id_max, {stats}
FROM (SELECT * REPLACE (CASE WHEN Currency = 'EUR' THEN AccountName || chr(10) || '"second", line' ELSE AccountName END AS AccountName)
      FROM raw)"""
    columns = ", ".join(text)
    order = ", ".join(f"{c} ASC NULLS LAST" for c in text)
    sql["ingest_raw_page"] = f"WITH {_RAW_SQL}\n" + f"""
SELECT {columns}, (SELECT count(*) FROM raw) > 1050 AS has_next FROM raw ORDER BY {order} LIMIT 50 OFFSET 1000"""
    sql["ingest_preview"] = f"WITH {_RAW_SQL}\n" + f"""
SELECT {columns}, (SELECT count(*) FROM raw) AS row_count FROM raw ORDER BY {order} LIMIT 50"""
    parts = " || ',' || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in text)
    sums = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(4))
    sql["dataset_fingerprint"] = f"WITH {_RAW_SQL},\n" + f"""
hashed AS (SELECT sha256({parts}) AS h FROM (SELECT {columns} FROM raw)),
summed AS (SELECT count(*) AS row_count, {sums} FROM hashed)
SELECT row_count, sha256(concat_ws(':', '{",".join(text)}', CAST(row_count AS VARCHAR), s0, s1, s2, s3)) AS data_hash
FROM summed"""
    # 2^60 times a value is a whole number here; only the last division's operand is rounded.
    exact = "CAST(CAST(sum(CAST({} * 1152921504606846976.0::DOUBLE AS HUGEINT)) AS VARCHAR) AS DOUBLE) / 1152921504606846976.0::DOUBLE"
    sql["exact_charge_totals"] = f"""
SELECT l_returnflag, l_linestatus, {exact.format("charge")} AS charge_sum, {exact.format("l_discount")} AS discount_sum
FROM (SELECT *, l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax) AS charge FROM lineitem)
GROUP BY l_returnflag, l_linestatus"""
    sql.update(_training_data()[1])
    return sql
