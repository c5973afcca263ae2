import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions.registry import registry
from ledgerlens.operators import catalog as C
from ledgerlens.operators.mapping import MappingError, check_mapping
from ledgerlens.plans.spec import ViewSpec

ID = registry.id_of


def _good():
    return {"doc": ID("document_number"), "txn": ID("transaction_number"), "line": ID("line_number"),
            "date": ID("posting_date"), "acc": ID("account_number"), "off": ID("offset_account_number"),
            "amt": ID("amount"), "dc": ID("debit_credit_indicator")}


def _frame(spark, mappings):
    rows = [(ds, raw, fid) for ds, m in mappings.items() for raw, fid in m.items()]
    return spark.createDataFrame(rows, "dataset_id string, raw_column string, field_id string")


def _first_rule(m):
    try:
        check_mapping(m)
        return 0
    except MappingError as e:
        return e.rule


def test_catalog_rules_agree_with_single_mapping_check(spark):
    cases = {"ok": _good()}
    m = _good(); m["amt"] = "fake-id"; cases["unknown"] = m
    m = _good(); m["x"] = ID("document_number"); cases["dup"] = m
    m = _good(); m.pop("acc"); cases["missing"] = m
    m = _good(); m.pop("amt"); m["dr"] = ID("debit_amount"); cases["nogroup"] = m
    m = _good(); m["dr"] = ID("debit_amount"); m["cr"] = ID("credit_amount"); cases["both"] = m
    m = _good(); m["amt"] = "zzz"; m.pop("acc"); cases["two_faults"] = m
    status = {r.dataset_id: (r.rule, r.message) for r in C.mapping_status(_frame(spark, cases)).collect()}
    for ds, m in cases.items():
        assert status[ds][0] == _first_rule(m), ds
        if status[ds][0]:
            try:
                check_mapping(m)
            except MappingError as e:
                assert status[ds][1] == str(e)
    v = C.mapping_violations(_frame(spark, cases)).where("dataset_id = 'two_faults'")
    # the unknown id also leaves no amount group complete
    assert sorted(r.rule for r in v.collect()) == [1, 3, 4]


def test_saves_current_signature_and_suggested(spark):
    t = dt.datetime
    saves = spark.createDataFrame([
        ("a", {"x": "1"}, t(2026, 1, 1, 10)), ("a", {"x": "2"}, t(2026, 1, 2)),
        ("b", {"y": "3"}, t(2026, 1, 1, 9)), ("c", {"z": "4"}, t(2026, 1, 5))],
        "dataset_id string, mapping map<string,string>, saved_at timestamp")
    datasets = spark.createDataFrame([
        ("a", "S1", t(2026, 1, 1), 1, t(2026, 1, 3)), ("b", "S1", t(2026, 1, 1), 1, t(2026, 1, 4)),
        ("c", "S2", t(2026, 1, 4), 2, t(2026, 1, 4)), ("d", "S1", t(2026, 1, 6), 2, t(2026, 1, 4))],
        "dataset_id string, signature string, uploaded_at timestamp, uploaded_by_id int, last_accessed_at timestamp")
    cur = {r.dataset_id: r.mapping for r in C.current_mappings(saves).collect()}
    assert cur == {"a": {"x": "2"}, "b": {"y": "3"}, "c": {"z": "4"}}
    sig = C.signature_mappings(saves, datasets)
    assert {r.signature: r.mapping for r in sig.collect()} == {"S1": {"y": "3"}, "S2": {"z": "4"}}
    sug = {r.dataset_id: r.suggested_mapping for r in C.suggested_mappings(datasets, sig).collect()}
    assert sug == {"a": {}, "b": {}, "c": {}, "d": {"y": "3"}}
    latest = {r.uploaded_by_id: r.dataset_id for r in C.latest_dataset_per_user(datasets).collect()}
    assert latest == {1: "b", 2: "d"}     # user 2: tie on time, larger id wins


def test_view_signature_column_matches_driver_hash(spark):
    spec = ViewSpec.from_dict({"dimensions": [{"field_id": ID("currency")}],
                               "measures": [{"field_id": ID("amount"), "aggregations": ["sum"]}]})
    df = spark.createDataFrame([("DS1",), ("DS2",)], "dataset_id string")
    got = {r.dataset_id: r.s for r in df.select("dataset_id", C.view_signature_col(spec, F.col("dataset_id")).alias("s")).collect()}
    assert got == {"DS1": spec.signature("DS1"), "DS2": spec.signature("DS2")}


def test_view_catalog(spark):
    t = dt.datetime
    acc = spark.createDataFrame([("d", "s", 7, t(2026, 1, 2)), ("d", "s", 5, t(2026, 1, 1)),
                                 ("d", "s2", 1, t(2026, 1, 3))],
                                "dataset_id string, signature string, user_id int, accessed_at timestamp")
    out = {(r.dataset_id, r.signature): (r.created_by, r.accesses, r.last_accessed_at)
           for r in C.view_catalog(acc).collect()}
    assert out == {("d", "s"): (5, 2, t(2026, 1, 2)), ("d", "s2"): (1, 1, t(2026, 1, 3))}


def test_checked_saves_match_separate_jobs(spark):
    import datetime as dt
    cases = {"ok": _good()}
    m = _good(); m.pop("acc"); cases["missing"] = m
    entries = _frame(spark, cases).withColumn("save_no", F.lit(1))
    times = spark.createDataFrame([("ok", 1, dt.datetime(2026, 1, 1)), ("missing", 1, dt.datetime(2026, 1, 2))],
                                  "dataset_id string, save_no int, saved_at timestamp")
    got = {r.dataset_id: (r.rule, dict(r.mapping)) for r in C.checked_saves(entries, times).collect()}
    assert got["ok"] == (0, _good()) and got["missing"][0] == 3


def test_faulty_saves_do_not_fail_the_others(spark):
    from ledgerlens.operators import catalog as C
    from ledgerlens.sources.sample import sample_mapping
    good = [("d1", 1, r, f) for r, f in sample_mapping().items()]
    twice = [("d2", 1, r, f) for r, f in sample_mapping().items()] + [("d2", 1, "Amount", "x")]
    null_id = [("d3", 1, r, f) for r, f in sample_mapping().items()] + [("d3", 1, "Extra", None)]
    unnamed = [("d4", 1, r, f) for r, f in sample_mapping().items() if r != "Text"] + [("d4", 1, None, sample_mapping()["Text"])]
    m = spark.createDataFrame(good + twice + null_id + unnamed, "dataset_id string, save_no int, raw_column string, field_id string")
    at = m.select("dataset_id", "save_no").distinct().withColumn("saved_at", F.current_timestamp())
    saves = {r.dataset_id: r for r in C.checked_saves(m, at).collect()}
    assert {k: r.rule for k, r in saves.items()} == {"d1": 0, "d2": 1, "d3": 1, "d4": 6}
    assert saves["d1"].mapping == sample_mapping() and saves["d2"].mapping is None and saves["d4"].mapping is None
    assert saves["d3"].message == "Invalid field ids: ['None']"
    status = {r.dataset_id: r.rule for r in C.mapping_status(m, keys=("dataset_id", "save_no")).collect()}
    assert status == {"d1": 0, "d2": 1, "d3": 1, "d4": 0}
    assert {r.dataset_id: r.mapping is None for r in C.mapping_saves(m, at).collect()} == {"d1": False, "d2": True, "d3": False, "d4": True}


def test_known_entries_use_a_plain_hash_aggregate(spark):
    from ledgerlens.operators import catalog as C
    from ledgerlens.sources import sample_catalog as SC
    plan = C.mapping_status(SC.mappings(spark, "/root/testdata/sf0.001"), keys=("dataset_id", "save_no"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate") == 2 and "bit_or" in plan        # partial and final, of unknown ids only


def test_suggestions_do_not_shuffle_datasets_by_signature(spark):
    from ledgerlens.operators import catalog as C
    ds = spark.range(200).selectExpr("concat('d', id) AS dataset_id", "if(id % 9 = 0, 'rare', 'hot') AS signature",
                                     "timestamp'2026-01-02 00:00:00' AS uploaded_at")
    sig = spark.createDataFrame([("hot", {"a": "1"}), ("rare", {"b": "2"})], "signature string, mapping map<string,string>") \
        .withColumn("saved_at", F.expr("timestamp'2026-01-01 00:00:00'"))
    small, large = C.suggested_mappings(ds, sig), C.suggested_mappings(ds, sig, broadcast_rows=0)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(signature" not in plan
    rows = lambda df: sorted((r.dataset_id, tuple(r.suggested_mapping.items())) for r in df.collect())
    assert rows(small) == rows(large) and len(rows(small)) == 200


def test_saves_shuffle_their_entries_once_and_packed(spark):
    from ledgerlens.sources import sample_catalog as SC
    sf, keys = "/root/testdata/sf0.001", ("dataset_id", "save_no")
    saves = C.checked_saves(SC.mappings(spark, sf), SC.save_times(spark, sf), keys=keys).where("rule = 0")
    plan = C.current_mappings(saves)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(dataset_id#" in plan and "SortMergeJoin" not in plan
    rows = C._packed(SC.mappings(spark, sf), registry, keys)
    assert rows.count() <= 2 * SC.save_times(spark, sf).count()


def test_saves_with_scattered_entries(spark):
    good = [("d1", 1, r, f) for r, f in _good().items()]
    odd = [("d2", 1, r, f) for r, f in _good().items() if r != "doc"] + [("d2", 1, None, _good()["doc"]), ("d2", 1, '!q"', "zz"), ("d2", 1, "", "A")]
    both = [x for pair in zip(good, odd) for x in pair] + odd[len(good):] + [(None, 1, "x", "y"), ("d9", 1, "doc", _good()["doc"])]
    m = spark.createDataFrame(both, "dataset_id string, save_no int, raw_column string, field_id string").repartition(3)
    at = spark.createDataFrame([("d1", 1, None), ("d2", 1, dt.datetime(2026, 1, 2)), ("d8", 1, None)], "dataset_id string, save_no int, saved_at timestamp")
    got = {r.dataset_id: r for r in C.checked_saves(m, at).collect()}
    assert set(got) == {"d1", "d2"}                       # saves with entries and a time's row
    assert got["d1"].rule == 0 and got["d1"].mapping == _good() and got["d1"].saved_at is None
    assert got["d2"].rule == 1 and got["d2"].message == "Invalid field ids: ['A', 'zz']" and got["d2"].mapping is None
