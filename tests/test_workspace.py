"""The workflow end to end, the way the application's own tests drive it."""
import shutil

import pytest

from ledgerlens.functions.registry import registry
from ledgerlens.operators.mapping import MappingError
from ledgerlens.plans.spec import ViewSpec
from ledgerlens.plans.workspace import MissingStep, NotFound, Workspace
from ledgerlens.sources.csv_ingest import MSG_CORRUPT, MSG_ONLY_CSV, IngestError

ID = registry.id_of


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "ws"))


def _upload(ws, data_path, name="journal_valid.csv", user=1):
    return ws.upload_csv(data_path(name), company_name="COMP A", fiscal_year=2025, user_id=user)


def test_upload_and_raw_page(ws, data_path):
    up = _upload(ws, data_path)
    assert up["row_count"] == 10 and len(up["preview"]) == 10 and up["suggested_mapping"] == {}
    page = ws.raw_page(up["dataset_id"], offset=2, limit=3)
    assert [r["document_number"] for r in page["data"]] == ["JE102", "JE103", "JE104"]
    assert page["has_next"] is True


def test_upload_rejects(ws, data_path, tmp_path):
    with pytest.raises(IngestError, match=MSG_CORRUPT):
        _upload(ws, data_path, "journal_corrupted.csv")
    txt = tmp_path / "test.txt"
    txt.write_text("hello")
    with pytest.raises(IngestError, match=MSG_ONLY_CSV):
        ws.upload_csv(str(txt), company_name="A", fiscal_year=2025, user_id=1)


def test_mapping_rules_and_suggestion(ws, data_path, mapping):
    a = _upload(ws, data_path)["dataset_id"]
    bad = dict(mapping, amount="fake-id")
    with pytest.raises(MappingError):
        ws.save_mapping(a, bad)
    with pytest.raises(NotFound):
        ws.save_mapping("unknown", mapping)
    assert ws.save_mapping(a, mapping)["status"] == "mapped"
    # a second export with the same header, columns in any order, gets the mapping suggested
    b = _upload(ws, data_path, "journal_invalid.csv")
    assert b["suggested_mapping"] == mapping
    assert ws.suggested_mapping(b["dataset_id"]) == mapping


def test_validate_transform_query(ws, data_path, mapping):
    d = _upload(ws, data_path, "journal_invalid.csv")["dataset_id"]
    with pytest.raises(MissingStep):
        ws.validate(d)
    with pytest.raises(NotFound):
        ws.transform(d, user_id=1)
    ws.save_mapping(d, mapping)
    assert ws.validate(d) == {"total_rows": 10, "invalid_rows": 4}
    view = ws.transform(d, user_id=1)
    assert view["dimensions"] == [] and view["measures"] == [] and view["filters"] is None
    req = {"dimensions": [{"field_id": ID("debit_credit_indicator"), "axis": "row"}],
           "measures": [{"field_id": ID("amount"), "aggregations": ["sum", "count"]}]}
    got = {r.debit_credit_indicator: (r.amount_sum, r.amount_count) for r in ws.query(d, req, user_id=1).collect()}
    # valid rows: JE100, JE102, JE104, JE106, JE108 (debits) and JE103 (credit)
    assert got == {"D": (1250.5 + 99 + 7000 + 5400 + 250, 5), "C": (-45.25, 1)}
    ws.query(d, req, user_id=2)
    views = {r.signature: r.accesses for r in ws.views(d).collect()}
    assert len(views) == 2 and sorted(views.values()) == [1, 2]


def test_latest_dataset(ws, data_path):
    assert ws.latest_dataset(9) is None
    first = _upload(ws, data_path, user=9)["dataset_id"]
    second = _upload(ws, data_path, user=9)["dataset_id"]
    assert ws.latest_dataset(9)["dataset_id"] == second
    assert first != second


def test_validate_without_raw_data(ws, data_path, mapping, spark):
    from ledgerlens.session import delete_path
    d = _upload(ws, data_path)["dataset_id"]
    ws.save_mapping(d, mapping)
    delete_path(spark, ws._data("raw", d))
    with pytest.raises(NotFound, match="Raw file missing"):
        ws.validate(d)


def test_other_date_layouts(ws, data_path, mapping, tmp_path):
    import csv
    with open(data_path("journal_valid.csv"), newline="") as f:
        rows = list(csv.reader(f))
    at = rows[0].index("posting_date")
    for r in rows[1:]:
        y, m, d = r[at].split("-")
        r[at] = f"{d}.{m}.{y}"
    p = tmp_path / "dotted.csv"
    with open(p, "w", newline="") as f:
        csv.writer(f).writerows(rows)
    up = ws.upload_csv(str(p), company_name="A", fiscal_year=2026, user_id=1)
    ws.save_mapping(up["dataset_id"], mapping)
    assert ws.validate(up["dataset_id"])["invalid_rows"] == 0
    ws.transform(up["dataset_id"], user_id=1)
    out = ws.query(up["dataset_id"], {"dimensions": [], "measures": []}, user_id=1)
    assert out.where("posting_date IS NULL").count() == 0
    assert ws.validate(up["dataset_id"], date_formats=("yyyy-MM-dd",))["invalid_rows"] == len(rows) - 1


def test_stored_view_is_read_back(ws, data_path, mapping):
    up = ws.upload_csv(data_path("journal_valid.csv"), company_name="A", fiscal_year=2026, user_id=1)
    ws.save_mapping(up["dataset_id"], mapping)
    ws.validate(up["dataset_id"])
    ws.transform(up["dataset_id"], user_id=1)
    request = {"dimensions": [{"field_id": registry.id_of("currency"), "axis": "row"}],
               "measures": [{"field_id": registry.id_of("amount"), "aggregations": ["sum"]}],
               "sorting": [{"field_id": registry.id_of("amount"), "sorting_direction": "desc"}],
               "pagination": {"limit": 5, "offset": 0}}
    ws.query(up["dataset_id"], request, user_id=1)
    spec = ViewSpec.from_dict(request)
    assert ws.view(up["dataset_id"], spec.signature(up["dataset_id"])).to_dict() == spec.to_dict()
    with pytest.raises(NotFound):
        ws.view(up["dataset_id"], "0" * 64)
