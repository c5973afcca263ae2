import pyarrow as pa

from ledgerlens.operators.pages import column_types, raw_dataset_page, type_label
from ledgerlens.sources.arrow_out import arrow_ipc_stream, arrow_result
from ledgerlens.sources.csv_ingest import ingest_csv, read_raw
from ledgerlens.sources.fingerprint import dataset_fingerprint
from pyspark.sql import types as T


def test_type_labels():
    assert type_label(T.TimestampType()) == "datetime"
    assert type_label(T.DateType()) == "date"
    assert type_label(T.LongType()) == "integer"
    assert type_label(T.ArrayType(T.StringType())) == "unknown"


def test_raw_page(spark, tmp_path, data_path):
    res = ingest_csv(spark, data_path("journal_valid.csv"), str(tmp_path / "raw"))
    page = raw_dataset_page(spark, res.path, offset=8, limit=5)
    assert page["row_count"] == 10 and page["has_next"] is False
    assert [r.document_number for r in page["data"].collect()] == ["JE108", "JE109"]
    assert page["columns"][0] == {"name": "document_number", "dtype": "str"}
    assert raw_dataset_page(spark, res.path, 0, 5)["has_next"] is True


def test_fingerprint_is_layout_independent(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) as s")
    a = dataset_fingerprint(df)
    b = dataset_fingerprint(df.repartition(5).orderBy("s"))
    c = dataset_fingerprint(df.where("id > 0"))
    assert a == b and a != c and len(a) == 64


def test_arrow_outputs(spark):
    df = spark.range(3).selectExpr("id", "cast(id as string) as s")
    tbl = arrow_result(df)
    assert tbl.num_rows == 3
    data = arrow_ipc_stream(df)
    assert pa.ipc.open_stream(data).read_all().num_rows == 3
