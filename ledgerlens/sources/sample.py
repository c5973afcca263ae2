"""Raw journal lines derived from the TPC-H-like ``lineitem`` table.

The projection turns every ``lineitem`` row into one raw ledger-export line,
all text, under export-style headers, with deterministic planted faults so
that every validation rule fires somewhere.  The same projection is written
in SQL in ``__spark_entry__.oracle_sql`` for the DuckDB cross-check.

It is a pure per-row projection: no shuffle, the Parquet scan only reads the
lineitem columns used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.registry import registry

# Export header -> canonical field name for the sample export.
SAMPLE_HEADER = {
    "DocumentNo": "document_number",
    "TransactionNo": "transaction_number",
    "LineNo": "line_number",
    "PostingDate": "posting_date",
    "EntryDate": "entry_date",
    "PostingTime": "posting_time",
    "Amount": "amount",
    "DrCr": "debit_credit_indicator",
    "Currency": "currency",
    "Account": "account_number",
    "AccountName": "account_name",
    "OffsetAccount": "offset_account_number",
    "CreatedBy": "user_id",
    "ApprovedBy": "approver_id",
    "ApprovalStatus": "approval_status",
    "JournalType": "journal_type",
    "Category": "journal_category",
    "Text": "description",
    "Reference": "reference",
}
# The debit/credit export replaces Amount/DrCr with two money columns.
DEBIT_CREDIT_HEADER = {
    **{k: v for k, v in SAMPLE_HEADER.items() if k not in ("Amount", "DrCr")},
    "Debit": "debit_amount",
    "Credit": "credit_amount",
}
UNMAPPED_COLUMNS = ("SourceLine",)


def sample_mapping() -> dict[str, str]:
    """Raw column -> field id for the amount/indicator export."""
    return {raw: registry.id_of(name) for raw, name in SAMPLE_HEADER.items()}


def debit_credit_mapping() -> dict[str, str]:
    return {raw: registry.id_of(name) for raw, name in DEBIT_CREDIT_HEADER.items()}


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _common(li: DataFrame) -> list[Column]:
    k = F.col("l_orderkey")
    ship = F.col("l_shipdate")
    return [
        F.concat(F.lit("DOC"), _s(k)).alias("DocumentNo"),
        F.when(k % 89 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("TXN"), _s(k), F.lit("-"), _s("l_linenumber"))).alias("TransactionNo"),
        F.when(k % 79 == 0, F.lit("x"))
         .when(k % 101 == 0, F.concat(_s("l_linenumber"), F.lit(".0")))        # not an integer literal
         .when(k % 103 == 0, F.concat(F.lit(" "), _s("l_linenumber"), F.lit(" ")))   # padded: valid
         .otherwise(_s("l_linenumber")).alias("LineNo"),
        F.when(k % 97 == 0, F.lit("bla")).otherwise(F.to_date(ship).cast("string")).alias("PostingDate"),
        F.when(k % 61 == 0, F.lit(None).cast("string"))
         .otherwise(F.date_sub(F.to_date(ship), (k % 3).cast("int")).cast("string")).alias("EntryDate"),
        F.when(k % 71 == 0, F.lit("xx"))
         .otherwise(F.concat(_pad2(F.col("l_partkey") % 24), F.lit(":"),
                             _pad2(F.col("l_suppkey") % 60), F.lit(":00"))).alias("PostingTime"),
    ]


def _tail(li: DataFrame) -> list[Column]:
    k = F.col("l_orderkey")
    return [
        F.when(F.col("l_returnflag") == "A", F.lit("EUR")).otherwise(F.lit("USD")).alias("Currency"),
        F.concat(F.when(k % 113 == 0, F.lit("\u00a0acc-")).otherwise(F.lit(" acc-")), _s("l_partkey")).alias("Account"),
        F.concat(F.lit("Account "), _s(F.col("l_partkey") % 100)).alias("AccountName"),
        F.concat(F.lit("acc-"), _s("l_suppkey"), F.lit(" ")).alias("OffsetAccount"),
        F.concat(F.lit("USR"), _pad2(F.col("l_suppkey") % 25)).alias("CreatedBy"),
        F.concat(F.lit("APR"), _s(F.col("l_partkey") % 7)).alias("ApprovedBy"),
        F.when(k % 3 == 0, F.lit("Approved")).when(k % 3 == 1, F.lit("Pending"))
         .otherwise(F.lit("Rejected")).alias("ApprovalStatus"),
        F.when(F.col("l_returnflag") == "R", F.lit("Manual")).otherwise(F.lit("System")).alias("JournalType"),
        F.when(F.col("l_linestatus") == "O", F.lit("Revenue")).otherwise(F.lit("Invoice")).alias("Category"),
        F.when(F.col("l_quantity") > 40, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("qty "), _s(F.col("l_quantity").cast("bigint")))).alias("Text"),
        F.when(F.col("l_linenumber") == 1, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("INV"), _s(k))).alias("Reference"),
        _s("l_linenumber").alias("SourceLine"),
    ]


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")


def _journal(li: DataFrame) -> list[Column]:
    k = F.col("l_orderkey")
    amount = (F.when(k % 83 == 0, F.lit("abc"))
              .when(k % 109 == 0, F.lit("nan"))                                    # Java spelling: invalid
              .when(k % 107 == 0, F.concat(F.lit(" "), _cents(), F.lit(".50 ")))   # padded decimal: valid
              .when(k % 127 == 0, F.lit("1e400"))                                  # beyond a double: invalid
              .otherwise(_cents())).alias("Amount")
    indicator = (F.when(k % 73 == 0, F.lit(None).cast("string"))
                 .when(F.col("l_partkey") % 50 == 0, F.lit("?"))
                 .when(F.col("l_linenumber") == 7, F.lit("\tdr"))
                 .when(F.col("l_linenumber") == 6, F.lit("\u2003Credit\u00a0"))
                 .when(F.col("l_linestatus") == "O", F.lit(" Debit"))
                 .otherwise(F.lit("credit "))).alias("DrCr")
    return [*_common(li), amount, indicator, *_tail(li)]


def journal_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw journal lines, amount + indicator layout (all columns text)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(*_journal(li))


# The columns that name a journal line: document, transaction, line.
LINE_KEYS = 3


def journal_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``journal_raw`` in a total order: all its columns, ascending, nulls last.

    Ranges are of the first columns only, the names of a line.  So choosing
    the ranges and dealing out the rows take these and the table's own narrow
    columns; the other texts are made once, by the task that sorts them.
    """
    li = read_table(spark, sf_dir, "lineitem")
    columns, names = _journal(li), [*SAMPLE_HEADER, *UNMAPPED_COLUMNS]
    rows = li.select("*", *columns[:LINE_KEYS]).repartitionByRange(*[F.col(c).asc_nulls_last() for c in names[:LINE_KEYS]])
    return (rows.select(*names[:LINE_KEYS], *columns[LINE_KEYS:])
            .sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in names]))


def journal_raw_debit_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw journal lines, separate debit / credit columns."""
    li = read_table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    both_blank = k % 67 == 0
    is_open = F.col("l_linestatus") == "O"
    debit = (F.when(both_blank | ~is_open, F.lit(None).cast("string"))
             .when(k % 83 == 0, F.lit("n/a"))
             .otherwise(_cents())).alias("Debit")
    credit = (F.when(both_blank | is_open, F.lit(None).cast("string"))
              .when(F.col("l_linenumber") == 3, F.concat(F.lit("-"), _cents()))
              .otherwise(_cents())).alias("Credit")
    return li.select(*_common(li), debit, credit, *_tail(li))


def write_csv_export(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write raw lines as a headered CSV export, text kept verbatim.

    Spark's CSV writer trims leading/trailing blanks unless told otherwise;
    an export must keep them (' Debit', 'acc-1 ') for the rules to see them.
    """
    if files:
        df = df.repartition(files)
    (df.write.mode("overwrite")
       .option("header", "true").option("escape", '"')
       .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
       .csv(path))
