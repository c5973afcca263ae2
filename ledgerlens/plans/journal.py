"""End-to-end journal jobs over stored tables.

    CSV --ingest_csv--> raw (row_id + text columns)
        --validate_dataset--> validated (canonical text columns, error_messages, is_valid)
        --transform_dataset--> transformed (typed, standardised, helper columns)
        --query_view--> view result

Each stage is one Spark job writing zstd Parquet.  The validation summary
and the content fingerprint are observed by the job that writes the table, so
the rules run once and nothing is read again.  Views read the transformed table, so their filters and column
selection reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.functions import text
from ledgerlens.functions.registry import FieldRegistry, registry as default_registry
from ledgerlens.operators.enrich import transform
from ledgerlens.operators.mapping import check_mapping, qcol
from ledgerlens.operators.validate import date_layouts, summary_figures, validate
from ledgerlens.operators.view import compile_view
from ledgerlens.plans.spec import ViewSpec
from ledgerlens.sources.csv_ingest import IngestResult, ingest_csv, read_raw
from ledgerlens.sources.fingerprint import dataset_fingerprint
from ledgerlens.sources.observed import Figures
from ledgerlens.sources.parquet_io import scan_parquet, sink_parquet


def find_date_formats(spark: SparkSession, raw_path: str, mapping: Mapping[str, str],
                      registry: FieldRegistry = default_registry) -> dict:
    """Layouts by canonical date column, from one aggregation over the raw table."""
    return date_layouts(scan_parquet(spark, raw_path), mapping, registry)


def validate_dataset(spark: SparkSession, raw_path: str, mapping: Mapping[str, str], dest: str, *,
                     registry: FieldRegistry = default_registry,
                     date_formats=None) -> dict:
    """raw -> validated Parquet (row_id materialised); returns ``{"total_rows", "invalid_rows"}``.

    Without ``date_formats`` (layouts, or layouts by canonical name) each date
    column's layout is found from the whole column (``find_date_formats``;
    give ``transform_dataset`` the same).
    """
    if date_formats is None:
        date_formats = find_date_formats(spark, raw_path, mapping, registry)
    seen = Figures(validate(read_raw(spark, raw_path), mapping, registry, date_formats, stored=True), **summary_figures())
    sink_parquet(seen.data, dest)
    return {name: int(n) for name, n in seen.get().items()}


def transform_dataset(spark: SparkSession, validated_path: str, dest: str, *,
                      registry: FieldRegistry = default_registry,
                      date_formats=text.DEFAULT_DATE_FORMATS,
                      time_format: str = text.DEFAULT_TIME_FORMAT,
                      partition_by: list[str] | None = None,
                      cluster_by: list[str] | None = None) -> None:
    """validated -> transformed Parquet (valid rows only).

    ``cluster_by`` sorts each task's rows before writing (no shuffle), so
    Parquet row-group min/max statistics become selective and range filters
    on those columns (e.g. ``posting_date``) skip most row groups.
    ``partition_by`` adds directory pruning (e.g. ``posting_year``).
    """
    out = transform(scan_parquet(spark, validated_path), registry, date_formats, time_format)
    if cluster_by:
        out = out.sortWithinPartitions(*cluster_by)
    sink_parquet(out, dest, partition_by=partition_by)


def query_view(spark: SparkSession, transformed_path: str, spec: ViewSpec | dict, *,
               registry: FieldRegistry = default_registry, exact_money: bool = False, exact_sums: bool = False) -> DataFrame:
    return compile_view(scan_parquet(spark, transformed_path), spec, registry, exact_money, exact_sums=exact_sums, stored=True)


def initial_view(dataset_id: str) -> dict:
    """The empty view recorded when a dataset is transformed."""
    spec = ViewSpec()
    return {"id": str(dataset_id), "dataset_id": str(dataset_id), **spec.to_dict(),
            "signature": spec.signature(dataset_id)}


def upload_record(spark: SparkSession, ing: IngestResult, *, dataset_id: str, company_name: str,
                  fiscal_year: int, uploaded_by_id: int, original_filename: str,
                  signature_mappings: DataFrame | None = None, fingerprint: bool = True) -> dict:
    """Metadata of one upload: the catalog row plus the suggested mapping.

    ``data_hash`` is the content fingerprint that the ingest observed while
    writing; an ingest told not to has none, and the stored table is read for
    it unless ``fingerprint=False`` (``data_hash`` is then None).  The suggestion is the first mapping saved
    for the same header signature, looked up in the signature-mapping table.
    """
    suggested = {}
    if signature_mappings is not None:
        hit = signature_mappings.where(signature_mappings["signature"] == ing.signature).select("mapping").first()
        suggested = dict(hit["mapping"]) if hit else {}
    return {
        "dataset_id": dataset_id,
        "company_name": company_name,
        "fiscal_year": int(fiscal_year),
        "stored_path": ing.path,
        "uploaded_by_id": uploaded_by_id,
        "original_filename": original_filename,
        "signature": ing.signature,
        "row_count": ing.row_count,
        "data_hash": None if not fingerprint else ing.data_hash or dataset_fingerprint(
            scan_parquet(spark, ing.path).select(*[qcol(c) for c in ing.columns])),
        "columns": ing.columns,
        "suggested_mapping": suggested,
    }


@dataclass
class JournalRun:
    raw_path: str
    validated_path: str
    transformed_path: str
    ingest: IngestResult
    summary: dict
    view: dict


def run_journal(spark: SparkSession, csv_path, mapping: Mapping[str, str], workdir: str, dataset_id: str, *,
                registry: FieldRegistry = default_registry, multi_line: bool | None = None,
                date_formats=None) -> JournalRun:
    """Ingest, check the mapping, validate and transform one dataset."""
    base = workdir.rstrip("/")
    raw, validated, transformed = (f"{base}/raw/{dataset_id}", f"{base}/validated/{dataset_id}",
                                   f"{base}/transformed/{dataset_id}")
    check_mapping(mapping, registry)          # cheap: refuse a bad mapping before any job runs
    ing = ingest_csv(spark, csv_path, raw, multi_line=multi_line)
    if date_formats is None:
        date_formats = find_date_formats(spark, raw, mapping, registry)
    summary = validate_dataset(spark, raw, mapping, validated, registry=registry, date_formats=date_formats)
    transform_dataset(spark, validated, transformed, registry=registry, date_formats=date_formats)
    return JournalRun(raw, validated, transformed, ing, summary, initial_view(dataset_id))
