"""Catalog tables derived from the driver's ``orders`` and ``events`` tables.

Each order stands for one uploaded ledger export (a dataset); its key picks
one of four export headers and plants mapping faults, so every mapping rule
fires somewhere.  Each event stands for one opening of a view.  The SQL
twin of every table lives in ``__spark_entry__`` for the DuckDB check.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.registry import registry
from ledgerlens.operators.catalog import view_signature_col
from ledgerlens.plans import views as V
from ledgerlens.plans.spec import ViewSpec
from ledgerlens.sources.csv_ingest import header_signature_col
from ledgerlens.sources.sample import DEBIT_CREDIT_HEADER, SAMPLE_HEADER, read_table

# Export headers by variant (o_orderkey % 4).  Variant 3 is variant 0 in
# another column order, so both share one signature.
_V0 = list(SAMPLE_HEADER) + ["SourceLine"]
HEADER_VARIANTS = [
    _V0,
    [c for c in _V0 if c != "ApprovalStatus"],
    list(DEBIT_CREDIT_HEADER) + ["SourceLine"],
    list(reversed(_V0)),
]
_ALL_HEADERS = {**SAMPLE_HEADER, **DEBIT_CREDIT_HEADER}


def variant_mapping(variant: int) -> list[tuple[str, str]]:
    """(raw column, field id) entries of a variant's correct mapping."""
    return [(c, registry.id_of(_ALL_HEADERS[c])) for c in HEADER_VARIANTS[variant] if c in _ALL_HEADERS]


# Mapping faults planted by dataset key (checked in this order by the rules).
FAULT_UNKNOWN_ID = 11       # Currency mapped to an id that does not exist
FAULT_DUPLICATE = 13        # an extra column mapped to document_number again
FAULT_NO_ACCOUNT = 17       # account_number left unmapped
FAULT_NO_AMOUNT_GROUP = 19  # Amount / Credit left unmapped
FAULT_BOTH_GROUPS = 23      # the other amount group mapped as well


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per uploaded dataset."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    variant = (k % 4).cast("int")
    header = F.element_at(F.from_json(F.lit(json.dumps(HEADER_VARIANTS)), "array<array<string>>"), variant + 1)
    return o.select(
        F.concat(F.lit("DS"), k.cast("string")).alias("dataset_id"),
        k.alias("dataset_key"),
        F.concat(F.lit("Company "), (F.col("o_custkey") % 50).cast("string")).alias("company_name"),
        F.year("o_orderdate").alias("fiscal_year"),
        (F.col("o_custkey") % 100).alias("uploaded_by_id"),
        F.col("o_orderdate").alias("uploaded_at"),
        F.timestamp_add("MINUTE", (k % 1440).cast("int"), F.col("o_orderdate")).alias("last_accessed_at"),
        variant.alias("header_variant"),
        header_signature_col(header).alias("signature"),
    )


def _entries(pairs) -> Column:
    return F.from_json(F.lit(_json(pairs)), _EMPTY)


def _json(pairs) -> str:
    return json.dumps([{"raw_column": r, "field_id": f} for r, f in pairs])


RESAVE_EVERY = 5            # these datasets save a corrected mapping a day later
_EMPTY = "array<struct<raw_column:string,field_id:string>>"


def _std_entries(variant: Column) -> Column:
    variants = f"[{','.join(_json(variant_mapping(v)) for v in range(4))}]"
    return F.element_at(F.from_json(F.lit(variants), f"array<{_EMPTY}>"), variant + 1)


def _first_attempt(k: Column, variant: Column) -> Column:
    """The entries of a dataset's first save, with the planted faults.

    Built per dataset as an array (entries dropped, replaced or added by the
    dataset key), so every dataset is processed and nothing is filtered out.
    """
    def keep(e):
        return (~((k % FAULT_NO_ACCOUNT == 0) & (e["raw_column"] == "Account"))
                & ~((k % FAULT_NO_AMOUNT_GROUP == 0) & e["raw_column"].isin("Amount", "Credit")))

    def fault_id(e):
        fid = F.when((k % FAULT_UNKNOWN_ID == 0) & (e["raw_column"] == "Currency"), F.lit("fake-id")) \
               .otherwise(e["field_id"])
        return F.struct(e["raw_column"].alias("raw_column"), fid.alias("field_id"))

    empty = F.array().cast(_EMPTY)
    base = F.transform(F.filter(_std_entries(variant), keep), fault_id)
    dup = F.when(k % FAULT_DUPLICATE == 0, _entries([("Extra", registry.id_of("document_number"))])).otherwise(empty)
    other = F.when(variant == 2, _entries([("Amount", registry.id_of("amount")),
                                           ("DrCr", registry.id_of("debit_credit_indicator"))])) \
             .otherwise(_entries([("Debit", registry.id_of("debit_amount")), ("Credit", registry.id_of("credit_amount"))]))
    both = F.when(k % FAULT_BOTH_GROUPS == 0, other).otherwise(empty)
    return F.concat(base, dup, both)


def _saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (dataset, save): save 1 for every dataset, save 2 (the
    corrected mapping) for datasets whose key is a multiple of RESAVE_EVERY."""
    ds = datasets(spark, sf_dir)
    k = F.col("dataset_key")
    save_nos = F.when(k % RESAVE_EVERY == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return ds.select("dataset_id", "dataset_key", "header_variant", "uploaded_at",
                     F.explode(save_nos).alias("save_no"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, save_no, raw_column, field_id): every saved mapping's entries.

    Save 1 is the first attempt, faults included; save 2 is the correct mapping.
    """
    sv = _saves(spark, sf_dir)
    k, variant = F.col("dataset_key"), F.col("header_variant")
    entries = F.when(F.col("save_no") == 1, _first_attempt(k, variant)).otherwise(_std_entries(variant))
    return (sv.select("dataset_id", "save_no", F.explode(entries).alias("e"))
              .select("dataset_id", "save_no", "e.raw_column", "e.field_id"))


def save_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, save_no, saved_at): save 1 some minutes after the upload,
    save 2 (when there is one) a day after it."""
    k = F.col("dataset_key")
    minutes = F.when(F.col("save_no") == 1, (k % 97).cast("int")).otherwise(F.lit(1440))
    return _saves(spark, sf_dir).select("dataset_id", "save_no",
                                        F.timestamp_add("MINUTE", minutes, F.col("uploaded_at")).alias("saved_at"))


# View opened per event type (each event is one opening of a view).
EVENT_VIEWS = {
    "view": ViewSpec(),                                  # the initial, empty view
    "click": ViewSpec.from_dict(V.VIEWS["view_flagship"]),
    "purchase": ViewSpec.from_dict(V.VIEWS["view_all_aggregations"]),
    "signup": ViewSpec.from_dict(V.VIEWS["view_filter_tree"]),
    "error": ViewSpec.from_dict(V.VIEWS["view_pivot"]),
}
VIEW_DATASETS = 40


def view_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, signature, user_id, accessed_at), one row per event."""
    ev = read_table(spark, sf_dir, "events")
    ds_id = F.concat(F.lit("DS"), (F.col("user_id") % VIEW_DATASETS).cast("string"))
    sig = None
    for etype, spec in EVENT_VIEWS.items():
        branch = view_signature_col(spec, ds_id)
        sig = F.when(F.col("event_type") == etype, branch) if sig is None else sig.when(
            F.col("event_type") == etype, branch)
    return ev.select(ds_id.alias("dataset_id"), sig.alias("signature"), "user_id",
                     F.col("ts").alias("accessed_at"))


def view_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, view_id, parent_view_id), a view per event: opening a page
    starts a view, other events derive theirs from an earlier event's.  Parents
    of another dataset do not exist in theirs; some views name each other."""
    ev = read_table(spark, sf_dir, "events")
    e, pairs = F.col("event_id"), F.col("event_id") % 500 < 2
    parent = (F.when(pairs, F.when(e % 500 == 0, e + 1).otherwise(e - 1))
              .when(F.col("event_type") == "view", F.lit(None))
              .otherwise(F.when(e % 3 == 0, F.floor(e / 4)).otherwise(e - 3)))
    return ev.select(F.concat(F.lit("DS"), F.when(pairs, F.floor(e / 500)).otherwise(F.floor(e / 700)).cast("string")).alias("dataset_id"),
                     e.cast("string").alias("view_id"), parent.cast("bigint").cast("string").alias("parent_view_id"))
