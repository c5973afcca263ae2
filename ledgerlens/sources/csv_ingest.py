"""CSV ingest: headered CSV -> raw Parquet, with a file-order ``row_id``.

Every column is read as text (leading zeros in account codes survive) with a
schema built from the header, in PERMISSIVE mode with a corrupt-record
column: rows whose field count differs from the header land there and fail
the ingest, as does a file whose header differs from the first file's.

A first pass over the physical lines compares the headers of all files and
counts lines with an odd number of quotes: only then can a quoted field hold
a line break.  Such uploads are read line by line too, with the state of the
quotes carried over splits (``csv_records``); their ``_mid`` is the row number.

The data is written once, next to the destination, and moved there when all
checks have passed; a failed ingest leaves an earlier dataset untouched.
Each row keeps the ``monotonically_increasing_id`` it got while being read
(``_mid``: partition id in the upper 31 bits, row position in the lower 33)
and the source file / split it came from.  Storing the ids makes them final:
later jobs see the same values even if executors come and go and a re-read
would pack splits differently.

A sidecar table ``_row_offsets`` (one row per file split as read, ignored by
Parquet readers because of the leading underscore) holds the split's first
``_mid``, its row count and ``_base``, the number of rows before it in (file,
split) order.  ``read_raw`` derives ``row_id = _base + _mid - _min_mid``
through a broadcast equi-join on the partition id (``_mid >> 33``, a long)
plus a range check.  The broadcast side is four longs per split of the
ingest's scan - fewer bytes than the scan's own split descriptors, which the
driver held to plan that scan (~800k splits, ~50 MB hashed, for 100 TB read
in 128 MB splits) - so its size is bounded by what has been planned before.

Offsets are a distributed prefix sum over (file, split) order: the split
statistics are range-partitioned, running sums run inside each range
partition, and only one total per range partition is summed in a single
task.  Nothing is collected to the driver.
"""

from __future__ import annotations

import csv
import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.mapping import qcol
from ledgerlens.session import delete_path, list_files, move_path, path_exists, path_is_dir
from ledgerlens.sources import csv_records
from ledgerlens.sources.fingerprint import data_hash, hash_pieces, piece_sums
from ledgerlens.sources.observed import Figures

# FIXED VALUES: ingest error messages.
MSG_ONLY_CSV = "Only CSV files allowed"
MSG_EMPTY = "CSV file is empty"
MSG_CORRUPT = "Corrupted CSV file"
MSG_NOT_FOUND = "CSV file not found"
MSG_TWICE = "The same CSV file is named more than once"

CORRUPT_COL = "_corrupt"
PREVIEW_ROWS = 50
# FIXED VALUE: how a repeated column name is told apart (n counts from 0).
DUPLICATE_NAME = "{name}_duplicated_{n}"


class IngestError(ValueError):
    pass


@dataclass
class IngestResult:
    path: str
    columns: list[str]
    row_count: int
    signature: str
    preview: DataFrame = field(repr=False)
    data_hash: str | None = None


def header_signature(columns) -> str:
    """SHA-256 of the sorted, comma-joined header (column-order-insensitive)."""
    return hashlib.sha256(",".join(sorted(columns)).encode()).hexdigest()


def header_signature_col(columns_array) -> "F.Column":
    """The same signature as a Spark expression over an ``array<string>`` column."""
    return F.sha2(F.array_join(F.array_sort(columns_array), ","), 256)


def _paths(path) -> list[str]:
    """The paths, each once."""
    return [path] if isinstance(path, str) else list(dict.fromkeys(path))


def check_csv_name(spark: SparkSession, path) -> None:
    """A file must be named ``*.csv``; a folder is read with its subfolders and
    may hold nothing else (names starting with ``_`` or ``.`` are ignored, as
    by Spark's readers); glob patterns are left to the reader."""
    for p in _paths(path):
        if any(ch in p for ch in "*?[{"):
            continue
        if path_is_dir(spark, p):
            if not all(name.endswith(".csv") for name in list_files(spark, p)):
                raise IngestError(MSG_ONLY_CSV)
            continue
        if not p.rstrip("/").endswith(".csv"):
            raise IngestError(MSG_ONLY_CSV)
        if not path_exists(spark, p):
            raise IngestError(MSG_NOT_FOUND)


def column_names(header: str, separator: str = ",") -> list[str]:
    """Column names from a header line, all different.

    A name that repeats an earlier one, in whatever case, or one that the
    stored table uses itself gets a suffix; a blank name is ``column_<place>``.
    """
    taken, out = {c.lower() for c in (*_HELPERS, "row_id")}, []
    for i, raw in enumerate(next(csv.reader([header], delimiter=separator))):
        base = raw if raw.strip() else f"column_{i + 1}"
        name, n = base, 0
        while name.lower() in taken:
            name, n = DUPLICATE_NAME.format(name=base, n=n), n + 1
        taken.add(name.lower())
        out.append(name)
    return out


BOM = "\ufeff"


def _first_line(text: DataFrame) -> str | None:
    """The first line of the first file that has one."""
    value, file, block = F.col("value"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    for name in sorted(set(text.inputFiles())):
        # ``file_path`` leaves out an empty host: file:/x for file:///x.
        first = text.where(file.isin(name, name.replace(":///", ":/", 1)) & (block == 0)).select("value").first()
        if first is not None:
            return first["value"]
    # No rows at all, or names spelt in another way.
    place = F.struct(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("id"))
    return text.select(value, place.alias("place")).agg(F.min_by("value", "place")).first()[0]


def _file_facts(text: DataFrame, header: str) -> DataFrame:
    """One row per file: its odd lines, and whether it starts with the header,
    which it does if its first row and its first row that equals the header
    have one id.  The aggregates are numbers only, kept in a hash table; a line
    among them would have every line sorted by its file."""
    value, first_block = F.col("value"), F.col("block") == 0
    line = F.when(F.startswith(value, F.lit(BOM)), F.substring(value, 2, 2**31 - 1)).otherwise(value)
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    odd = F.when(F.contains(value, F.lit('"')), quotes % 2).otherwise(0)
    return (text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("id"))
            .groupBy("file").agg(F.sum(odd).alias("odd"), F.min(F.when(first_block, F.col("id"))).alias("first"),
                                 F.min(F.when(first_block & (line == header), F.col("id"))).alias("as_header"))
            .select("odd", F.col("first").eqNullSafe(F.col("as_header")).alias("same")))


def line_facts(spark: SparkSession, path, options: dict | None = None) -> dict:
    """``header`` (the first line of the first file that has one, or None; read
    alone), ``same`` (all files start with it) and ``open_lines`` (lines with
    an odd number of quotes)."""
    encoding = {"encoding": options["encoding"]} if options and "encoding" in options else {}
    text = spark.read.options(recursiveFileLookup="true", pathGlobFilter="*.csv", **encoding).text(_paths(path))
    header = _first_line(text)
    if header is None:
        return {"header": None, "same": True, "open_lines": 0}
    header = header.removeprefix(BOM)
    facts = _file_facts(text, header).agg(F.bool_and("same").alias("same"), F.sum("odd").alias("open_lines")).first()
    return {"header": header, **facts.asDict()}


def read_header(spark: SparkSession, path, options: dict | None = None) -> list[str]:
    """Column names of the first file."""
    header = line_facts(spark, path, options)["header"]
    return column_names(header, (options or {}).get("sep", ",")) if header else []


def read_csv_text(spark: SparkSession, path, columns: list[str], multi_line: bool = False,
                  options: dict | None = None) -> DataFrame:
    """All-text read by position, with a corrupt-record column."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns]
                          + [T.StructField(CORRUPT_COL, T.StringType(), True)])
    opts = {"header": "true", "escape": '"', "multiLine": str(bool(multi_line)).lower(),
            "pathGlobFilter": "*.csv", "recursiveFileLookup": "true", **(options or {})}
    return (spark.read.options(**opts)
            .schema(schema)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT_COL)
            .csv(_paths(path)))


OFFSETS_DIR = "_row_offsets"
# Offsets (four longs each) broadcast at most: under 100 MB.
BROADCAST_ROWS = 1_000_000
STATS_DIR = "_split_stats"
_HELPERS = ("_mid", "_file", "_block", CORRUPT_COL)


def split_stats(raw: DataFrame) -> DataFrame:
    """One row per split as read: first id, rows, corrupt rows (one scan of the
    helper columns).  A split read twice (overlapping patterns) is two rows."""
    return (raw.groupBy(F.shiftright("_mid", 33).alias("_part"), "_file", "_block")
            .agg(F.min("_mid").alias("_min_mid"),
                 F.count(F.lit(1)).alias("_rows"),
                 F.count(CORRUPT_COL).alias("_corrupt_rows"),
                 (F.max("_mid") - F.min("_mid") + 1 - F.count(F.lit(1))).alias("_gap")))


def range_stats(stats: DataFrame) -> DataFrame:
    """Split statistics range-partitioned in (file, split) order, each row
    stamped with its range partition (``_pid`` increases with the order)."""
    return (stats.repartitionByRange("_file", "_block", "_part")
            .withColumn("_pid", F.spark_partition_id()))


def offsets_from_stats(stats: DataFrame) -> DataFrame:
    """Range-stamped split statistics -> _part, _min_mid, _rows, _corrupt_rows, _base.

    A distributed prefix sum over (file, split) order: running sums inside
    each range partition run in parallel; only the partition totals (one row
    per range partition, bounded by the shuffle partition count, not by the
    data) are summed in one task and broadcast back.
    """
    before = Window.unboundedPreceding
    inside = Window.partitionBy("_pid").orderBy("_file", "_block", "_part").rowsBetween(before, -1)
    local = stats.withColumn("_local_base", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    totals = stats.groupBy("_pid").agg(F.sum("_rows").alias("_ptot"))
    part_base = totals.select("_pid", F.coalesce(F.sum("_ptot").over(Window.orderBy("_pid").rowsBetween(before, -1)),
                                                 F.lit(0)).alias("_pbase"))
    return (local.join(F.broadcast(part_base), "_pid")
            .select("_part", "_min_mid", "_rows", "_corrupt_rows", "_gap",
                    (F.col("_pbase") + F.col("_local_base")).alias("_base"), "_file", "_block"))


def split_offsets(raw: DataFrame) -> DataFrame:
    """One row per (file, split): _part, _min_mid, _rows, _corrupt_rows, _base.

    (Single-plan form for inspection; ``ingest_csv`` stores the range-stamped
    statistics first so the stamps are fixed before they are used twice.)
    """
    return offsets_from_stats(range_stats(split_stats(raw)))


def _replace(spark: SparkSession, staging: str, dest: str) -> None:
    """``staging`` becomes ``dest``; an earlier ``dest`` stays aside until that
    has happened, and comes back if it fails."""
    aside = f"{dest}._before-{uuid.uuid4().hex}"
    earlier = path_exists(spark, dest)
    if earlier:
        move_path(spark, dest, aside)
    try:
        move_path(spark, staging, dest)
    except Exception:
        if earlier:
            move_path(spark, aside, dest)
        raise
    if earlier:
        delete_path(spark, aside)


def _observed(df: DataFrame, columns: list[str], fingerprint: bool) -> Figures:
    """Observed figures are taken row by row, each by itself; what they share,
    the row's hash, is computed in the projection below them."""
    if not fingerprint:
        return Figures(df, _corrupt_rows=F.count(CORRUPT_COL), row_count=F.count(F.lit(1)))
    pieces = hash_pieces(columns)
    seen = Figures(df.select("*", *[c.alias(name) for name, c in pieces.items()]), _corrupt_rows=F.count(CORRUPT_COL), **piece_sums(columns))
    seen.data = seen.data.drop(*pieces)
    return seen


def _write_lines(spark, path, columns, options, compression, staging, fingerprint) -> dict:
    """Records that are lines, in one pass; offsets from the helper columns."""
    raw = read_csv_text(spark, path, columns, False, options)
    return _write_rows(spark, raw, columns, compression, staging, fingerprint)


def _write_rows(spark, raw, columns, compression, staging, fingerprint) -> dict:
    seen = _observed(raw.select("*", F.monotonically_increasing_id().alias("_mid"),
                                F.col("_metadata.file_path").alias("_file"),
                                F.col("_metadata.file_block_start").alias("_block")), columns, fingerprint)
    seen.data.write.option("compression", compression).parquet(staging)
    figures = seen.get()
    if figures["_corrupt_rows"] > 0:
        raise IngestError(MSG_CORRUPT)
    # One scan of the small helper columns of what was just written gives
    # the per-split statistics; they are stored first (tiny) so that the
    # two branches of the offsets computation do not scan the data twice.
    stats_path = f"{staging}/{STATS_DIR}"
    range_stats(split_stats(spark.read.parquet(staging))).write.parquet(stats_path)
    offsets_from_stats(spark.read.parquet(stats_path)).write.parquet(f"{staging}/{OFFSETS_DIR}")
    delete_path(spark, stats_path)
    gap = spark.read.parquet(f"{staging}/{OFFSETS_DIR}").agg(F.max("_gap")).first()[0]
    if (gap or 0) > 0:               # one split read twice by one task: its ids are not one range
        raise IngestError(MSG_TWICE)
    return figures


def _write_records(spark, path, columns, options, compression, staging, fingerprint) -> dict | None:
    """Records that may break over lines (``csv_records``); None if the lines
    do not end in a line feed, so that files have to be read whole."""
    work = f"{staging}-lines"
    try:
        found = csv_records.running(csv_records.text_lines(spark, _paths(path), options))
        found.write.option("compression", compression).parquet(f"{work}/lines")
        lines = spark.read.parquet(f"{work}/lines")
        csv_records.split_maps(lines).write.parquet(f"{work}/maps")
        states = csv_records.split_states(spark.read.parquet(f"{work}/maps"))
        starts = states.where("_first").select("_file", "_block", "_min_mid")
        lone = lines.join(starts.withColumnRenamed("_min_mid", "_mid"), ["_file", "_block", "_mid"]).where(
            F.contains(F.regexp_replace("value", "\r$", ""), F.lit("\r")))
        if not lone.isEmpty():
            return None
        faults = csv_records.file_faults(states).first()
        if faults["twice"] and "encoding" not in (options or {}):
            raise IngestError(MSG_TWICE)
        if faults["open"]:
            raise IngestError(MSG_CORRUPT)
        stats = states.select("*", F.shiftright("_min_mid", 33).alias("_part"), F.lit(0).cast("bigint").alias("_corrupt_rows"))
        range_stats(stats).write.parquet(f"{work}/stats")
        stats = spark.read.parquet(f"{work}/stats")
        bases = offsets_from_stats(stats).select("_file", "_block", "_base")
        bases.join(stats, ["_file", "_block"]).write.parquet(f"{work}/splits")
        numbered = csv_records.numbered_lines(lines, spark.read.parquet(f"{work}/splits"))
        rows = csv_records.parse_records(csv_records.record_texts(numbered), columns, CORRUPT_COL, options)
        seen = _observed(rows.withColumnRenamed("n", "_mid"), columns, fingerprint)
        seen.data.write.option("compression", compression).parquet(staging)
        figures = seen.get()
        if figures["_corrupt_rows"] > 0:
            raise IngestError(MSG_CORRUPT)
        # The ids are the row numbers already: one range per 2^33 rows.
        n, size = int(figures["row_count"]), 1 << 33
        (spark.range(-(-n // size)).select(
            F.col("id").alias("_part"), F.shiftleft("id", 33).alias("_min_mid"),
            F.least(F.lit(size), F.lit(n) - F.shiftleft("id", 33)).alias("_rows"),
            F.lit(0).cast("bigint").alias("_corrupt_rows"), F.lit(0).cast("bigint").alias("_gap"),
            F.shiftleft("id", 33).alias("_base")).write.parquet(f"{staging}/{OFFSETS_DIR}"))
        return figures
    finally:
        delete_path(spark, work)


def ingest_csv(spark: SparkSession, path, dest: str, *, multi_line: bool | None = None, options: dict | None = None,
               compression: str = "zstd", fingerprint: bool = True) -> IngestResult:
    """CSV file(s) -> raw Parquet at ``dest`` (read it back with ``read_raw``).

    ``multi_line`` is found out from the quotes if not given.  Only faults of
    the CSV itself raise ``IngestError``; other failures are raised as they are.
    Row count, corrupt rows and (unless ``fingerprint=False``) the content
    fingerprint are observed while the table is written.
    """
    check_csv_name(spark, path)
    facts = line_facts(spark, path, options)
    if not facts["header"]:
        raise IngestError(MSG_EMPTY)
    if not facts["same"]:
        raise IngestError(MSG_CORRUPT)
    columns = column_names(facts["header"], (options or {}).get("sep", ","))
    if multi_line is None:
        multi_line = facts["open_lines"] > 0

    dest = dest.rstrip("/")
    staging = f"{dest}._staging-{uuid.uuid4().hex}"
    try:
        to = (columns, options, compression, staging, fingerprint)
        figures = None
        if not multi_line:
            figures = _write_lines(spark, path, *to)
        elif csv_records.splittable(options):
            figures = _write_records(spark, path, *to)
        if figures is None:
            figures = _write_rows(spark, read_csv_text(spark, path, columns, True, options), columns, compression, staging, fingerprint)
        _replace(spark, staging, dest)
    finally:
        delete_path(spark, staging)

    return IngestResult(
        path=dest,
        columns=columns,
        row_count=int(figures["row_count"]),
        signature=header_signature(columns),
        preview=raw_rows(spark, dest, 0, PREVIEW_ROWS).drop("row_id"),
        data_hash=data_hash(columns, figures) if fingerprint else None,
    )


def _offsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{OFFSETS_DIR}").select("_part", "_min_mid", "_rows", "_base")


def _with_row_id(data: DataFrame, offsets: DataFrame, few: bool) -> DataFrame:
    """``few`` offsets (one row per split of the ingest's scan) are broadcast.
    More of them are merged with the rows by split: a key is one task's rows."""
    side = F.broadcast(offsets) if few else offsets.hint("merge")
    d = data.withColumn("_p", F.shiftright("_mid", 33))
    on = ((d["_p"] == side["_part"]) & (d["_mid"] >= side["_min_mid"])
          & (d["_mid"] < side["_min_mid"] + side["_rows"]))
    cols = [c for c in data.columns if c not in _HELPERS]
    return d.join(side, on).select((F.col("_base") + F.col("_mid") - F.col("_min_mid")).alias("row_id"),
                                   *[qcol(c) for c in cols])


def read_raw(spark: SparkSession, path: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Raw dataset: ``row_id`` (0-based, file order) + the text columns.

    The offsets are counted, from the Parquet footers, before they are
    broadcast; above ``broadcast_rows`` they are merged instead, with the same
    result.
    A Parquet table that did not come through ``ingest_csv`` (no offsets
    sidecar) is returned as it is, without ``row_id``.
    """
    if not path_exists(spark, f"{path.rstrip('/')}/{OFFSETS_DIR}"):
        return spark.read.parquet(path)
    offsets = _offsets(spark, path)
    return _with_row_id(spark.read.parquet(path), offsets, offsets.count() <= broadcast_rows)


def raw_rows(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """Rows with ``offset <= row_id < offset + limit``, ordered by row_id.

    The splits overlapping the range (a handful for a page) are found in the
    sidecar and turned into ``_mid`` ranges, which the Parquet scan can use
    to skip row groups; only those rows are joined.
    """
    hi = offset + limit
    offs = (_offsets(spark, path)
            .where((F.col("_base") < hi) & (F.col("_base") + F.col("_rows") > offset)))
    lo_mid = F.col("_min_mid") + F.greatest(F.lit(offset) - F.col("_base"), F.lit(0))
    hi_mid = F.col("_min_mid") + F.least(F.lit(hi) - F.col("_base"), F.col("_rows"))
    ranges = offs.select(lo_mid.alias("lo"), hi_mid.alias("hi")).collect()   # <= limit rows
    data = spark.read.parquet(path)
    if ranges:
        cond = None
        for r in ranges:
            c = (F.col("_mid") >= r["lo"]) & (F.col("_mid") < r["hi"])
            cond = c if cond is None else (cond | c)
        data = data.where(cond)
    else:
        data = data.where(F.lit(False))
    return _with_row_id(data, offs.select("_part", "_min_mid", "_rows", "_base"), len(ranges) <= BROADCAST_ROWS).orderBy("row_id")
