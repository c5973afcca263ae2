"""CSV records that break over lines, read in parallel.

A quoted field may hold line breaks, so where a record starts depends on the
quotes before it, back to the start of the file.  The files are still read
split by split, as plain lines:

1. Every line is a map from the state it starts in (outside or inside a quoted
   field) to the state it ends in.  A split is read by one task, line after
   line, so that task composes the maps as it reads: each line is stored with
   the state before it and the number of records begun up to it, for both
   states its split may begin in.
2. One row per split: the state each split really begins in follows from the
   splits before it in its file, the number of its first record from the record
   counts of all splits before it (``offsets_from_stats``, a distributed prefix
   sum).
3. With those (broadcast, unless there are very many splits), every line picks
   the number of its record.  A line that is a whole record is parsed where it
   is; only lines of broken records are shuffled, to be gathered by record
   number.

The lines are stored once, so that splits are the same in both readings of them
whatever the cluster does in between.  A record's number is its ``row_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Options under which the lines' quotes are understood here.
_KNOWN_OPTIONS = {"sep", "encoding"}

# States while a line is read, from quote to quote.
_TEXT, _QUOTED, _CLOSED, _START = 0, 1, 2, 3


def splittable(options: dict | None) -> bool:
    """Whether files with these reader options can be read by lines."""
    return set(options or {}) <= _KNOWN_OPTIONS and len((options or {}).get("sep", ",")) == 1


def ends_inside(line: Column, inside: bool, sep: str = ",") -> Column:
    """Whether a line that starts outside (or inside) a quoted field ends
    inside one.  A quote opens a field only where the field starts; within one,
    two quotes are one of its text; what follows the closing quote up to the
    separator is plain text.
    """
    def after_quote(state: Column, before: Column) -> Column:
        opens = F.endswith(before, F.lit(sep))
        empty = before == ""
        return (F.when(state == _QUOTED, _CLOSED)
                .when(opens | ((state != _TEXT) & empty), _QUOTED)
                .otherwise(_TEXT))

    pieces = F.split(line, '"', -1)
    last = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(_QUOTED if inside else _START), after_quote)
    return F.when(F.contains(line, F.lit('"')), last == _QUOTED).otherwise(F.lit(inside))


def text_lines(spark: SparkSession, paths, options: dict | None = None) -> DataFrame:
    """Lines as they are stored: place, text (a carriage return at the end
    stays), and the state each starting state leads to."""
    options = options or {}
    encoding = {"encoding": options["encoding"]} if "encoding" in options else {}
    sep = options.get("sep", ",")
    value = F.col("value")
    return (spark.read.options(recursiveFileLookup="true", pathGlobFilter="*.csv", lineSep="\n", **encoding).text(paths)
            .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                    F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_mid"), "value",
                    (F.octet_length(value) + 1).cast("bigint").alias("_bytes"),
                    ends_inside(value, False, sep).cast("int").alias("_out0"), ends_inside(value, True, sep).cast("int").alias("_out1"),
                    (F.btrim(value, F.lit(" \t\r")) == "").alias("_blank")))


_SPLIT = ("_file", "_block")


def _state_before(order, start: Column) -> Column:
    """State a line starts in, if its window starts in ``start``: what the last
    setting line before it set, turned over by the swaps since."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum("_swap").over(before), F.lit(0))
    return (F.coalesce(F.last("_set", ignorenulls=True).over(before), start) + swaps) % 2


def _maps(rows: DataFrame, order) -> DataFrame:
    """``_swap`` and ``_set`` of rows that lead from 0 to _out0 and from 1 to
    _out1; what a row sets is written so that swaps before it cancel out."""
    swap = ((F.col("_out0") == 1) & (F.col("_out1") == 0)).cast("int")
    rows = rows.withColumn("_swap", swap)
    upto = F.sum("_swap").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_set", F.when(F.col("_out0") == F.col("_out1"), (F.col("_out0") + upto) % 2))


def _follow(out0: np.ndarray, out1: np.ndarray, start: int) -> np.ndarray:
    """State before every line, and after the last, of lines that follow each
    other; the first starts in ``start``."""
    swaps = np.concatenate(([0], np.cumsum((out0 == 1) & (out1 == 0))))
    sets = np.concatenate(([True], out0 == out1))                   # the start sets the state, too
    value = np.concatenate(([start], out0)) ^ (swaps & 1)
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), 0))
    return value[last] ^ (swaps & 1)


def running(lines: DataFrame) -> DataFrame:
    """The lines as they are read, with ``_in0``, ``_in1`` (the state before the
    line if its split begins outside or inside a field) and ``_n0``, ``_n1``
    (the records that the split has begun up to it; blank lines and the file's
    first line, its header, begin none).

    What a task carries from batch to batch is two states and two counts."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, states, counts = None, [0, 1], [0, 0]
        for b in batches:
            if b.num_rows == 0:
                continue
            file, block = b.column("_file"), b.column("_block")
            new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            out = [b.column(f"_out{x}").to_numpy() for x in (0, 1)]
            text = ~b.column("_blank").to_numpy(zero_copy_only=False)
            found: dict[str, list[np.ndarray]] = {c: [] for c in ("_in0", "_in1", "_n0", "_n1")}
            for lo, hi in zip(starts, starts[1:]):
                here, begins = (file[lo].as_py(), block[lo].as_py()), text[lo:hi]
                if here != at:
                    at, states, counts = here, [0, 1], [0, 0]
                    if here[1] == 0:
                        begins = begins & (np.arange(hi - lo) > 0)
                for x in (0, 1):
                    state = _follow(out[0][lo:hi], out[1][lo:hi], states[x])
                    n = counts[x] + np.cumsum((state[:-1] == 0) & begins)
                    states[x], counts[x] = int(state[-1]), int(n[-1])
                    found[f"_in{x}"].append(state[:-1].astype(np.int32))
                    found[f"_n{x}"].append(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.concatenate(v)) for v in found.values()]],
                                             names=[*b.schema.names, *found])

    more = [T.StructField(c, T.IntegerType()) for c in ("_in0", "_in1")] + [T.StructField(c, T.LongType()) for c in ("_n0", "_n1")]
    return lines.mapInArrow(read, T.StructType([*lines.schema.fields, *more]))


def split_maps(lines: DataFrame) -> DataFrame:
    """One row per split of ``running`` lines: its map of states and, for both
    states it may begin in, the number of records that start in it."""
    first = F.min("_mid")
    return (lines.groupBy(*_SPLIT)
            .agg(first.alias("_min_mid"), F.max("_size").alias("_size"), F.sum("_bytes").alias("_bytes"),
                 (F.max("_mid") - first + 1 - F.count(F.lit(1))).alias("_gap"),
                 *[F.max_by(F.when(F.col(f"_in{x}") == 0, F.col("_out0")).otherwise(F.col("_out1")), "_mid").alias(f"_out{x}") for x in (0, 1)],
                 *[F.max(f"_n{x}").alias(f"_starts{x}") for x in (0, 1)]))


def split_states(maps: DataFrame) -> DataFrame:
    """Split rows with ``_state`` (0 or 1, where it begins), ``_first`` (its file
    begins with it) and ``_rows`` (records it starts)."""
    order = Window.partitionBy("_file").orderBy("_block")             # splits of one file
    rows = _maps(maps, order).withColumns({
        "_state": _state_before(order, F.lit(0)), "_first": F.row_number().over(order) == 1})
    starts = F.when(F.col("_state") == 0, F.col("_starts0")).otherwise(F.col("_starts1"))
    return rows.withColumn("_rows", starts)


def file_faults(states: DataFrame) -> DataFrame:
    """One row: ``open`` (a file ends inside a quoted field), ``twice`` (a file
    was read more than once)."""
    last = F.when(F.col("_state") == 0, F.col("_out0")).otherwise(F.col("_out1"))
    files = states.groupBy("_file").agg(F.max_by(last, "_block").alias("last"), F.sum("_bytes").alias("bytes"),
                                        F.max("_size").alias("size"), F.max("_gap").alias("gap"))
    return files.agg(F.coalesce(F.max(F.col("last") == 1), F.lit(False)).alias("open"),
                     F.coalesce(F.max((F.col("gap") > 0) | (F.col("bytes") > F.col("size") + 1)), F.lit(False)).alias("twice"))


SPLITS_BROADCAST = 100_000      # rows of a file path and five numbers each


def numbered_lines(lines: DataFrame, splits: DataFrame, broadcast_rows: int = SPLITS_BROADCAST) -> DataFrame:
    """(n, place, value, whole): every line of a record with its number.

    The splits are counted first; above ``broadcast_rows`` they are merged with
    the lines instead, with the same result."""
    side = splits.select(*_SPLIT, "_state", "_first", "_base", "_min_mid")
    side = F.broadcast(side) if splits.count() <= broadcast_rows else side.hint("merge")
    rows = lines.drop("_size").join(side, list(_SPLIT))
    outside = F.col("_state") == 0
    rows = rows.withColumns({"_in": F.when(outside, F.col("_in0")).otherwise(F.col("_in1")),
                             "_upto": F.when(outside, F.col("_n0")).otherwise(F.col("_n1"))})
    header = F.col("_first") & (F.col("_mid") == F.col("_min_mid"))
    begins = (F.col("_in") == 0) & ~F.col("_blank") & ~header
    closes = F.when(F.col("_in") == 0, F.col("_out0")).otherwise(F.col("_out1")) == 0
    # A record's lines are of one file.
    return (rows.where((F.col("_in") == 1) | begins)
            .select((F.col("_base") + F.col("_upto") - 1).alias("n"), F.struct("_block", "_mid").alias("place"), "value",
                    (begins & closes).alias("whole")))


def record_texts(numbered: DataFrame) -> DataFrame:
    """(n, text): the records, line breaks inside them kept."""
    whole = numbered.where("whole").select("n", F.col("value").alias("text"))
    # Only lines of broken records are shuffled; a group is one record.
    broken = (numbered.where(~F.col("whole")).groupBy("n")
              .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("parts"))
              .select("n", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("text")))
    return whole.unionByName(broken).select("n", F.regexp_replace("text", "\r$", "").alias("text"))


def parse_records(records: DataFrame, columns: list[str], corrupt: str, options: dict | None = None) -> DataFrame:
    """The records' fields as text, with the corrupt-record column and ``n``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, corrupt]])
    opts = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "sep": (options or {}).get("sep", ",")}
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in schema.fieldNames())
    return records.select("n", F.from_csv("text", F.lit(ddl), opts).alias("r")).select("r.*", "n")
