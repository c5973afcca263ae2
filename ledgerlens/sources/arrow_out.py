"""Query results as Arrow (table or IPC stream bytes).

For bounded results only (a view page, an aggregate): the whole result
passes through the driver.  ``max_rows``, if given, refuses larger results.
Anything unbounded is written by the executors instead (``sink_parquet``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

ARROW_STREAM_MEDIA_TYPE = "application/vnd.apache.arrow.stream"


def arrow_result(df: DataFrame, max_rows: int | None = None) -> pa.Table:
    if max_rows is not None:
        df = df.limit(max_rows + 1)
    table = df.toArrow()
    if max_rows is not None and table.num_rows > max_rows:
        raise ValueError(f"Result has more than {max_rows} rows; page it, or write it with sink_parquet")
    return table


def arrow_ipc_stream(df: DataFrame, max_rows: int | None = None) -> bytes:
    table = arrow_result(df, max_rows)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()
