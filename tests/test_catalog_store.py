import datetime as dt
import random

import pytest

from ledgerlens.operators import catalog as C
from ledgerlens.plans import catalog_store as S
from ledgerlens.plans import workspace as W
from ledgerlens.plans.workspace import Workspace
from ledgerlens.session import delete_path, list_entries


def _openings(spark, n, files, seed=1):
    rng = random.Random(seed)
    start = dt.datetime(2025, 1, 1)
    rows = [(f"d{rng.randrange(3)}", f"s{rng.randrange(9)}", rng.randrange(4), start + dt.timedelta(minutes=rng.randrange(5000)),
             f"spec{i}", rng.choice([None, "p"])) for i in range(n)]
    return spark.createDataFrame(rows, W._ACCESSES).repartition(files)


def _expected(df):
    out = {}
    for r in df.collect():
        rec = out.setdefault((r.dataset_id, r.signature), [])
        rec.append(r)
    return {k: (min(r.accessed_at for r in v), max(r.accessed_at for r in v), min((r.accessed_at, r.user_id) for r in v)[1], len(v),
                max((r.accessed_at, r.spec) for r in v)[1]) for k, v in out.items()}


def _views(ws):
    rows = ws.views().collect()
    assert len(rows) == len({(r.dataset_id, r.signature) for r in rows})
    return {(r.dataset_id, r.signature): (r.created_at, r.last_accessed_at, r.created_by, r.accesses, r.spec) for r in rows}


def _files(spark, table):
    return [n for n, folder in list_entries(spark, table) if n.endswith(".parquet")]


def test_compaction_keeps_the_records_and_few_files(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    table = ws._catalog("view_accesses")
    all_ = _openings(spark, 400, 60)
    all_.write.parquet(table)
    want = _expected(all_)
    assert _views(ws) == want
    ws.compact()
    assert _views(ws) == want
    more = _openings(spark, 50, 5, seed=2)
    more.write.mode("append").parquet(table)
    want = _expected(all_.unionByName(more))
    assert _views(ws) == want                      # snapshot and newer files together
    ws.compact()
    assert _views(ws) == want and len(_files(spark, table)) <= 5
    ws.compact()                                   # nothing new: only removes what the last one merged
    assert _views(ws) == want and _files(spark, table) == []
    assert len([1 for n, folder in list_entries(spark, f"{table}/_snapshots") if folder]) == 1


@pytest.mark.parametrize("stop", ["before the list", "after the list", "while removing"])
def test_compaction_stopped_anywhere(spark, tmp_path, monkeypatch, stop):
    ws = Workspace(spark, str(tmp_path))
    table = ws._catalog("view_accesses")
    all_ = _openings(spark, 60, 6)
    all_.write.parquet(table)
    want = _expected(all_)
    if stop == "while removing":
        ws.compact()
        done = []

        def once(session, path):
            if done:
                raise RuntimeError("stopped")
            done.append(path)
            delete_path(session, path)
        monkeypatch.setattr(S, "delete_path", once)
        with pytest.raises(RuntimeError):
            ws.compact()
        monkeypatch.undo()
    elif stop == "before the list":
        ws.compact()
        for name, _ in list_entries(spark, f"{table}/_snapshots"):
            delete_path(spark, f"{table}/_snapshots/{name}/merged")
    else:
        ws.compact()
    assert _views(ws) == want
    ws.compact()
    ws.compact()
    assert _views(ws) == want


def test_least_recently_used(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    _openings(spark, 100, 3).write.parquet(ws._catalog("view_accesses"))
    dropped = {(r.dataset_id, r.signature) for r in ws.droppable_views(keep=4).collect()}
    views = _views(ws)
    for d in {k[0] for k in views}:
        by_use = sorted((k for k in views if k[0] == d), key=lambda k: (-views[k][1].timestamp(), k[1]))
        assert dropped & set(by_use) == set(by_use[4:])


def test_lineage(spark):
    chain = [("a", f"v{i}", f"v{i - 1}" if i else None) for i in range(21)]
    rows = chain + [("a", "orphan", "gone"), ("a", "other", "w"), ("b", "w", None), ("b", "v0", "w"),
                    ("a", "x", "y"), ("a", "y", "x"), ("a", "below", "x"), ("a", "self", "self")]
    got = {(r.dataset_id, r.view_id): tuple(r)[2:] for r in C.view_lineage(
        spark.createDataFrame(rows, "dataset_id string, view_id string, parent_view_id string")).collect()}
    assert len(got) == len(rows)
    assert all(got["a", f"v{i}"] == (f"v{i - 1}" if i else None, "v0", i, False) for i in range(21))
    assert got["a", "orphan"] == (None, "orphan", 0, False) and got["a", "other"] == (None, "other", 0, False)
    assert got["b", "v0"] == ("w", "w", 1, False)
    assert {k[1] for k, v in got.items() if v[3]} == {"x", "y", "below", "self"}
    assert all(v[1:3] == (None, None) for v in got.values() if v[3])


def test_parent_of_a_request(spark, data_path, mapping, tmp_path):
    from ledgerlens.plans.spec import ViewSpec
    ws = Workspace(spark, str(tmp_path))
    d = ws.upload_csv(data_path("journal_valid.csv"), company_name="A", fiscal_year=2026, user_id=1)["dataset_id"]
    ws.save_mapping(d, mapping)
    ws.validate(d)
    ws.transform(d, user_id=1)
    from ledgerlens.functions.registry import registry
    request = {"dimensions": [{"field_id": registry.id_of("currency"), "axis": "row"}], "parent_view_id": d}
    ws.query(d, request, user_id=1)
    child = ViewSpec.from_dict(request).signature(d)
    assert child == ViewSpec.from_dict({**request, "parent_view_id": None}).signature(d)
    below = {"dimensions": [{"field_id": registry.id_of("account_number"), "axis": "row"}], "parent_view_id": child}
    ws.query(d, below, user_id=1)
    root = ViewSpec().signature(d)
    got = {r.view_id: (r.root_view_id, r.depth) for r in ws.view_lineage(d).collect()}
    assert got == {root: (root, 0), child: (root, 1), ViewSpec.from_dict(below).signature(d): (root, 2)}
    assert ws.view(d, child).parent_view_id == d


def test_lineage_plans_stay_small_over_rounds(spark):
    # Estimates of checkpointed joins square every round; files are as large as they are.
    n = 1200
    views = spark.range(n).selectExpr("'a' AS dataset_id", "concat('v', id) AS view_id", "if(id > 0, concat('v', id - 1), null) AS parent_view_id")
    circle = spark.createDataFrame([("a", "x", "y"), ("a", "y", "x")], "dataset_id string, view_id string, parent_view_id string")
    out = C.view_lineage(views.unionByName(circle))
    assert int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 40
    got = {r.view_id: (r.root_view_id, r.depth, r.cyclic) for r in out.collect()}
    assert got == {**{f"v{i}": ("v0", i, False) for i in range(n)}, "x": (None, None, True), "y": (None, None, True)}
