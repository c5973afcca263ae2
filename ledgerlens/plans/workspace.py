"""One workspace per storage root: the user-facing workflow by dataset id.

    upload_csv -> suggested_mapping / save_mapping -> validate -> transform -> query
    raw_page, latest_dataset, fields, views

Data lives in ``<root>/raw|validated|transformed/<dataset_id>``.  Metadata
lives in three append-only Parquet catalogs under ``<root>/catalog``: one row
per upload, per accepted mapping save and per view opening.  The current
state is derived from them by the catalog jobs (latest save per dataset,
first save per header signature, latest accessed dataset per user, one view
record per signature), so concurrent writers never update in place.
Catalog appends are one row per user action, i.e. tiny next to the data.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.registry import FieldRegistry, registry as default_registry
from ledgerlens.operators import catalog as C
from ledgerlens.operators.mapping import check_mapping
from ledgerlens.operators.pages import DEFAULT_PAGE, raw_dataset_page
from ledgerlens.operators.view import compile_view
from ledgerlens.plans import catalog_store, journal
from ledgerlens.plans.spec import ViewSpec
from ledgerlens.session import path_exists
from ledgerlens.sources.csv_ingest import ingest_csv


# FIXED VALUES: messages that clients of the application match.
MSG_NO_DATASET = "Dataset not found"
MSG_NO_MAPPING = "Mapping not found"
MSG_NO_RAW = "Raw file missing"
MSG_NO_VALIDATED = "Validated file missing"
MSG_NO_TRANSFORMED = "Transformed data missing"


class NotFound(KeyError):
    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class MissingStep(ValueError):
    """A stage was asked for before the stage it depends on ran."""


_DATASETS = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("company_name", T.StringType(), True),
    T.StructField("fiscal_year", T.IntegerType(), True),
    T.StructField("uploaded_by_id", T.LongType(), True),
    T.StructField("original_filename", T.StringType(), True),
    T.StructField("signature", T.StringType(), False),
    T.StructField("row_count", T.LongType(), False),
    T.StructField("data_hash", T.StringType(), True),
    T.StructField("columns", T.ArrayType(T.StringType()), True),
    T.StructField("uploaded_at", T.TimestampType(), False),
])
_SAVES = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("mapping", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("saved_at", T.TimestampType(), False),
])
_ACCESSES = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("signature", T.StringType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("accessed_at", T.TimestampType(), False),
    T.StructField("spec", T.StringType(), True),
    T.StructField("parent_view_id", T.StringType(), True),
])
# What compaction keeps of the openings: one record per (dataset, signature).
_VIEWS = T.StructType([
    T.StructField("dataset_id", T.StringType()), T.StructField("signature", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("last_accessed_at", T.TimestampType()),
    T.StructField("created_by", T.LongType()), T.StructField("accesses", T.LongType()),
    T.StructField("spec", T.StringType()), T.StructField("parent_view_id", T.StringType()),
])
_VALIDATIONS = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("date_formats", T.StringType(), False),
    T.StructField("validated_at", T.TimestampType(), False),
])


def _now() -> _dt.datetime:
    return _dt.datetime.now()


class Workspace:
    def __init__(self, spark: SparkSession, root: str, registry: FieldRegistry = default_registry):
        self.spark = spark
        self.root = root.rstrip("/")
        self.registry = registry

    # ------------------------------------------------------------ paths
    def _data(self, stage: str, dataset_id: str) -> str:
        return f"{self.root}/{stage}/{dataset_id}"

    def _catalog(self, name: str) -> str:
        return f"{self.root}/catalog/{name}"

    def _append(self, name: str, schema: T.StructType, row: tuple) -> None:
        catalog_store.append(self.spark, self._catalog(name), schema, row)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        return catalog_store.read(self.spark, self._catalog(name), schema)

    def datasets(self) -> DataFrame:
        return self._read("datasets", _DATASETS)

    def mapping_saves(self) -> DataFrame:
        return self._read("mapping_saves", _SAVES)

    def view_records(self) -> DataFrame:
        """One record per (dataset, view signature) from all openings."""
        return C.merge_view_records(catalog_store.read(
            self.spark, self._catalog("view_accesses"), _ACCESSES, snapshot_schema=_VIEWS, of_rows=C.view_records))

    def compact(self) -> None:
        """Merge the small files that user actions have left (``catalog_store``).
        One compaction at a time; users may go on working."""
        for name, schema in (("datasets", _DATASETS), ("mapping_saves", _SAVES), ("validations", _VALIDATIONS)):
            catalog_store.compact(self.spark, self._catalog(name), schema)
        catalog_store.compact(self.spark, self._catalog("view_accesses"), _ACCESSES, C.merge_view_records, _VIEWS, C.view_records)

    def _dataset(self, dataset_id: str):
        row = self.datasets().where(F.col("dataset_id") == dataset_id).first()
        if row is None:
            raise NotFound(MSG_NO_DATASET)
        return row

    # ------------------------------------------------------------ upload
    def fields(self, include_derived: bool = False) -> list[dict]:
        return [f.as_dict() for f in self.registry.fields(include_derived)]

    def upload_csv(self, path, *, company_name: str, fiscal_year: int, user_id: int,
                   original_filename: str | None = None, multi_line: bool | None = None) -> dict:
        """Ingest one export; returns id, columns, a 50-row preview, row count
        and the mapping suggested by an earlier upload with the same header."""
        dataset_id = str(uuid.uuid4())
        ing = ingest_csv(self.spark, path, self._data("raw", dataset_id), multi_line=multi_line)
        sig = C.signature_mappings(self.mapping_saves(), self.datasets())
        rec = journal.upload_record(self.spark, ing, dataset_id=dataset_id, company_name=company_name,
                                    fiscal_year=fiscal_year, uploaded_by_id=user_id,
                                    original_filename=original_filename or str(path).rsplit("/", 1)[-1],
                                    signature_mappings=sig)
        self._append("datasets", _DATASETS, (
            dataset_id, company_name, int(fiscal_year), int(user_id), rec["original_filename"], ing.signature,
            int(ing.row_count), rec["data_hash"], list(ing.columns), _now()))
        return {
            "dataset_id": dataset_id,
            "columns": ing.columns,
            "preview": [r.asDict() for r in ing.preview.collect()],     # at most 50 rows
            "suggested_mapping": rec["suggested_mapping"],
            "row_count": ing.row_count,
        }

    def raw_page(self, dataset_id: str, offset: int = 0, limit: int = DEFAULT_PAGE) -> dict:
        ds = self._dataset(dataset_id)
        page = raw_dataset_page(self.spark, self._data("raw", dataset_id), offset, limit, int(ds["row_count"]))
        page["data"] = [r.asDict() for r in page["data"].collect()]      # at most 500 rows
        return page

    # ----------------------------------------------------------- mapping
    def suggested_mapping(self, dataset_id: str) -> dict:
        ds = self._dataset(dataset_id)
        sig = C.signature_mappings(self.mapping_saves(), self.datasets())
        hit = sig.where(F.col("signature") == ds["signature"]).select("mapping").first()
        return dict(hit["mapping"]) if hit else {}

    def save_mapping(self, dataset_id: str, mapping: Mapping[str, str]) -> dict:
        """Check the mapping rules (raises ``MappingError``), then store it."""
        check_mapping(mapping, self.registry)
        self._dataset(dataset_id)
        self._append("mapping_saves", _SAVES, (dataset_id, dict(mapping), _now()))
        return {"status": "mapped", "canonical_columns": list(mapping.values())}

    def current_mapping(self, dataset_id: str) -> dict | None:
        saves = self.mapping_saves().where(F.col("dataset_id") == dataset_id)
        row = C.current_mappings(saves).first()
        return dict(row["mapping"]) if row else None

    # ------------------------------------------------------------ stages
    def validate(self, dataset_id: str, date_formats=None) -> dict:
        """Check every row; date layouts are found from the data if not given."""
        self._dataset(dataset_id)
        mapping = self.current_mapping(dataset_id)
        if mapping is None:
            raise MissingStep(MSG_NO_MAPPING)
        if not path_exists(self.spark, self._data("raw", dataset_id)):
            raise NotFound(MSG_NO_RAW)
        if date_formats is None:
            date_formats = journal.find_date_formats(self.spark, self._data("raw", dataset_id), mapping, self.registry)
        done = journal.validate_dataset(self.spark, self._data("raw", dataset_id), mapping,
                                        self._data("validated", dataset_id), registry=self.registry,
                                        date_formats=date_formats)
        self._append("validations", _VALIDATIONS, (dataset_id, json.dumps(date_formats), _now()))
        return done

    def transform(self, dataset_id: str, user_id: int, **layout) -> dict:
        self._dataset(dataset_id)
        validated = self._data("validated", dataset_id)
        if not path_exists(self.spark, validated):
            raise NotFound(MSG_NO_VALIDATED)
        if "date_formats" not in layout:           # those the rows were validated with
            done = (self._read("validations", _VALIDATIONS).where(F.col("dataset_id") == dataset_id)
                    .orderBy(F.col("validated_at").desc()).first())
            if done is not None:
                layout["date_formats"] = json.loads(done["date_formats"])
        journal.transform_dataset(self.spark, validated, self._data("transformed", dataset_id),
                                  registry=self.registry, **layout)
        view = journal.initial_view(dataset_id)
        self._record_view(dataset_id, ViewSpec(), user_id)
        return view

    def query(self, dataset_id: str, request: dict | ViewSpec, user_id: int, *,
              exact_money: bool = False, exact_sums: bool = False) -> DataFrame:
        """Compile a view request over the transformed table and record the opening."""
        transformed = self._data("transformed", dataset_id)
        if not path_exists(self.spark, transformed):
            raise NotFound(MSG_NO_TRANSFORMED)
        spec = request if isinstance(request, ViewSpec) else ViewSpec.from_dict(request)
        out = compile_view(self.spark.read.parquet(transformed), spec, self.registry, exact_money, exact_sums=exact_sums, stored=True)
        self._record_view(dataset_id, spec, user_id)
        return out

    def _record_view(self, dataset_id: str, spec: ViewSpec, user_id: int) -> None:
        self._append("view_accesses", _ACCESSES, (dataset_id, spec.signature(dataset_id), int(user_id), _now(),
                                                  json.dumps(spec.to_dict(), sort_keys=True), spec.parent_view_id))

    # ------------------------------------------------------------ catalog
    def view(self, dataset_id: str, signature: str) -> ViewSpec:
        """The view request recorded under a signature, as it was last opened
        (sorting and page are not part of the signature)."""
        row = (self.view_records().where((F.col("dataset_id") == dataset_id) & (F.col("signature") == signature))
               .select("spec").first())
        if row is None:
            raise NotFound("View not found")
        return ViewSpec.from_json(row["spec"])

    def views(self, dataset_id: str | None = None) -> DataFrame:
        records = self.view_records()
        return records if dataset_id is None else records.where(F.col("dataset_id") == dataset_id)

    def view_lineage(self, dataset_id: str | None = None) -> DataFrame:
        """Root and depth of every view (its id is its signature; the first,
        empty view also goes by the dataset's id)."""
        initial = C.view_signature_col(ViewSpec(), F.col("dataset_id"))
        parent = F.when(F.col("parent_view_id") == F.col("dataset_id"), initial).otherwise(F.col("parent_view_id"))
        return C.view_lineage(self.views(dataset_id).select("dataset_id", F.col("signature").alias("view_id"),
                                                            parent.alias("parent_view_id")))

    def droppable_views(self, keep: int, dataset_id: str | None = None) -> DataFrame:
        """Records beyond the ``keep`` last used ones of each dataset."""
        return C.least_recently_used(self.views(dataset_id), keep)

    def latest_dataset(self, user_id: int) -> dict | None:
        """The uploader's most recently used dataset (upload or view opening)."""
        ds = self.datasets().where(F.col("uploaded_by_id") == int(user_id))
        last_use = self.view_records().groupBy("dataset_id").agg(F.max("last_accessed_at").alias("_used"))
        ds = (ds.join(last_use, "dataset_id", "left")
                .withColumn("last_accessed_at", F.greatest("uploaded_at", F.coalesce("_used", "uploaded_at"))))
        row = C.latest_dataset_per_user(ds).first()
        if row is None:
            return None
        return self._dataset(row["dataset_id"]).asDict()
