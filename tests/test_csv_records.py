"""Records broken over lines, against Python's csv module."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import csv_records as R
from ledgerlens.sources.csv_ingest import MSG_CORRUPT, MSG_TWICE, IngestError, ingest_csv, raw_rows, read_raw
from ledgerlens.sources.fingerprint import dataset_fingerprint


def ends_inside(line, inside, sep=","):
    """State machine over characters."""
    state, at_start = ("quoted" if inside else "text"), not inside
    i = 0
    while i < len(line):
        ch = line[i]
        if state == "quoted":
            if ch == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state = "text"
        elif ch == '"' and at_start:
            state, at_start = "quoted", False
        else:
            at_start = ch == sep
        i += 1
    return state == "quoted"


def test_line_maps(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice('",ab') for _ in range(rng.randrange(9))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "value string").select(
        "value", R.ends_inside(F.col("value"), False).alias("a"), R.ends_inside(F.col("value"), True).alias("b"))
    for value, a, b in df.collect():
        assert (a, b) == (ends_inside(value, False), ends_inside(value, True)), value


def _rows(rng, n, width=3):
    pieces = ["x", "long text", "a,b", 'say "hi"', "line\nbreak", "two\n\nbreaks", "\n", ",\n\"", 'pipe 5"', "é", "end\r\nof"]
    return [[f"r{i}"] + [rng.choice(pieces) + str(rng.randrange(100)) for _ in range(width - 1)] for i in range(n)]


def _text(rows, stop="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=stop).writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("stop", ["\n", "\r\n"])
def test_equals_csv_module_over_many_splits(spark, tmp_path, small_splits, stop):
    rng = random.Random(len(stop))
    up = tmp_path / "up"
    up.mkdir()
    expected = []
    for i, n in enumerate((700, 1, 40, 0)):
        rows = _rows(rng, n)
        if n == 40:
            rows[7][1] = "over many\n" * 900                      # one field longer than several splits
        text = _text([["k", "a", "b"], *rows], stop).replace(stop + "r5,", stop * 3 + "r5,")      # blank lines between records
        (up / f"f{i}.csv").write_text(text, newline="")
        expected += rows
    assert R.text_lines(spark, str(up)).rdd.getNumPartitions() > 8
    res = ingest_csv(spark, str(up), str(tmp_path / "raw"))
    got = [tuple(r) for r in read_raw(spark, res.path).orderBy("row_id").collect()]
    assert got == [(i, *r) for i, r in enumerate(expected)]
    assert res.row_count == len(expected)
    assert res.data_hash == dataset_fingerprint(read_raw(spark, res.path).drop("row_id"))
    assert [r.k for r in raw_rows(spark, res.path, 690, 20).collect()] == [r[0] for r in expected[690:710]]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["raw", "up"]


def test_quotes_inside_plain_fields_break_nothing(spark, tmp_path, small_splits):
    p = tmp_path / "plain.csv"
    p.write_text("k,a\n" + "".join(f'{i},pipe 5" wide\n' for i in range(400)) + '400,"x\ny"\n')
    rows = read_raw(spark, ingest_csv(spark, str(p), str(tmp_path / "raw")).path).orderBy("row_id").collect()
    assert [r.k for r in rows] == [str(i) for i in range(401)]
    assert rows[0].a == 'pipe 5" wide' and rows[400].a == "x\ny"


def test_faulty_files(spark, tmp_path):
    p = tmp_path / "bad.csv"

    def refused(text):
        p.write_text(text)
        with pytest.raises(IngestError, match=MSG_CORRUPT):
            ingest_csv(spark, str(p), str(tmp_path / "raw"))
        assert [x.name for x in tmp_path.iterdir()] == ["bad.csv"]

    refused('a,b\n1,"never closed\n2,3\n')
    refused('a,b\n1,"x\ny",3\n')                     # too many fields
    refused('a,b\n"x\ny"\n')                         # too few
    p.write_text('a,b\n1,"x\ny"\n')
    try:                                              # one file named twice: read once, or refused
        assert ingest_csv(spark, [str(p), str(tmp_path / "b*.csv")], str(tmp_path / "raw")).row_count == 1
    except IngestError as e:
        assert str(e) == MSG_TWICE


def test_lone_carriage_returns_are_read_whole(spark, tmp_path):
    p = tmp_path / "mac.csv"
    p.write_text('a,b\r1,"x\ry"\r2,z\r', newline="")
    assert ingest_csv(spark, str(p), str(tmp_path / "raw")).row_count == 2


def test_observed_hash_is_the_tables(spark, data_path, tmp_path):
    res = ingest_csv(spark, data_path("journal_valid.csv"), str(tmp_path / "raw"))
    assert res.data_hash == dataset_fingerprint(read_raw(spark, res.path).drop("row_id"))
    assert ingest_csv(spark, data_path("journal_valid.csv"), str(tmp_path / "raw2"), fingerprint=False).data_hash is None


def test_lines_are_numbered_where_they_are_read(spark, tmp_path, small_splits):
    up = tmp_path / "up"
    up.mkdir()
    for i in range(3):
        (up / f"{i}.csv").write_text(_text([["a", "b", "c"], *_rows(random.Random(i), 300)]))
    R.running(R.text_lines(spark, str(up))).write.parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    states = R.split_states(R.split_maps(lines))
    assert states.count() > 8 and states.agg(F.sum("_rows")).first()[0] == 900
    order = "sum(_rows) over (order by _file, _block rows between unbounded preceding and 1 preceding)"
    splits = states.withColumn("_base", F.coalesce(F.expr(order), F.lit(0)))
    splits.write.parquet(f"{tmp_path}/splits")
    splits = spark.read.parquet(f"{tmp_path}/splits")
    near = R.record_texts(R.numbered_lines(lines, splits))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(n#" in plan
    rows = sorted(tuple(r) for r in near.collect())
    assert [n for n, _ in rows] == list(range(900))
    assert rows == sorted(tuple(r) for r in R.record_texts(R.numbered_lines(lines, splits, broadcast_rows=0)).collect())
