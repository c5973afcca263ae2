"""Journal exports arriving as files, validated and transformed as they land.

Validation, standardisation and helper columns are per-row, so they run on
a streaming DataFrame unchanged.  Each micro-batch:

* rows whose field count does not match the header go to ``quarantine``
  (a stream cannot refuse a file after the fact, so bad lines are kept
  aside with their source file instead of failing the whole stream);
* the other rows are validated and written to ``validated/batch_id=N``;
* the valid rows of that written batch are transformed into
  ``transformed/batch_id=N``.

Every batch overwrites its own ``batch_id`` folder, so a batch replayed
after a failure (``foreachBatch`` is at-least-once) rewrites the same output
instead of duplicating it.  Progress lives in the checkpoint folder, which
must be on shared storage on a cluster.

The file-order ``row_id`` of the batch ingest needs global offsets, which a
stream does not have; stream rows carry ``source_file`` instead.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions import text
from ledgerlens.functions.registry import FieldRegistry, registry as default_registry
from ledgerlens.operators.enrich import transform
from ledgerlens.operators.validate import validate, validation_summary
from ledgerlens.sources.csv_ingest import CORRUPT_COL, read_csv_text


def read_journal_stream(spark: SparkSession, src_dir: str, columns: list[str], *,
                        max_files_per_trigger: int | None = None, options: dict | None = None) -> DataFrame:
    """Streaming all-text read of the CSV files landing in ``src_dir``."""
    static = read_csv_text(spark, src_dir, columns, options=options)
    reader = (spark.readStream.schema(static.schema)
              .option("header", "true").option("escape", '"')
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COL)
              .option("enforceSchema", "false").option("pathGlobFilter", "*.csv"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if options:
        reader = reader.options(**options)
    return reader.csv(src_dir).withColumn("source_file", F.col("_metadata.file_path"))


def _batch_writer(out_dir: str, mapping: Mapping[str, str], registry: FieldRegistry, date_formats):
    out = out_dir.rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = f"batch_id={batch_id}"
        (batch.where(F.col(CORRUPT_COL).isNotNull()).select("source_file", CORRUPT_COL)
              .write.mode("overwrite").parquet(f"{out}/quarantine/{part}"))
        good = batch.where(F.col(CORRUPT_COL).isNull()).drop(CORRUPT_COL)
        validated = validate(good, mapping, registry, date_formats, keep=("source_file",))
        validated.write.mode("overwrite").parquet(f"{out}/validated/{part}")
        # Transform reads what was just written: the rules run once per row.
        written = spark.read.parquet(f"{out}/validated/{part}")
        transform(written, registry, date_formats).write.mode("overwrite").parquet(f"{out}/transformed/{part}")

    return write_batch


def start_journal_stream(spark: SparkSession, src_dir: str, columns: list[str], mapping: Mapping[str, str],
                         out_dir: str, checkpoint_dir: str, *, available_now: bool = True,
                         processing_time: str | None = None, max_files_per_trigger: int | None = None,
                         registry: FieldRegistry = default_registry,
                         date_formats=text.DEFAULT_DATE_FORMATS) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    stream = read_journal_stream(spark, src_dir, columns, max_files_per_trigger=max_files_per_trigger)
    writer = (stream.writeStream
              .foreachBatch(_batch_writer(out_dir, mapping, registry, date_formats))
              .option("checkpointLocation", checkpoint_dir))
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_summary(spark: SparkSession, out_dir: str) -> dict:
    """total_rows / invalid_rows over everything validated so far, plus quarantined lines."""
    out = out_dir.rstrip("/")
    s = validation_summary(spark.read.parquet(f"{out}/validated")).first()
    q = spark.read.parquet(f"{out}/quarantine").count()
    return {"total_rows": int(s["total_rows"]), "invalid_rows": int(s["invalid_rows"]), "quarantined_rows": q}
