import shutil

from ledgerlens.sources.csv_ingest import read_header
from ledgerlens.streaming.journal_stream import start_journal_stream, stream_summary


def test_stream_validates_and_transforms_new_files(spark, tmp_path, data_path, mapping):
    src = tmp_path / "landing"
    src.mkdir()
    shutil.copy(data_path("journal_valid.csv"), src / "a.csv")
    shutil.copy(data_path("journal_invalid.csv"), src / "b.csv")
    cols = read_header(spark, str(src))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    q = start_journal_stream(spark, str(src), cols, mapping, out, ckpt)
    q.awaitTermination(120)
    assert stream_summary(spark, out) == {"total_rows": 20, "invalid_rows": 4, "quarantined_rows": 0}
    t = spark.read.parquet(f"{out}/transformed")
    assert t.count() == 16 and "abs_amount" in t.columns

    # a new file with one long line: the good lines flow, the bad one is quarantined
    shutil.copy(data_path("journal_corrupted.csv"), src / "c.csv")
    q = start_journal_stream(spark, str(src), cols, mapping, out, ckpt)
    q.awaitTermination(120)
    assert stream_summary(spark, out) == {"total_rows": 29, "invalid_rows": 4, "quarantined_rows": 1}
    assert spark.read.parquet(f"{out}/transformed").count() == 25
