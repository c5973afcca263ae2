import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlens.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    assert sorted(map(tuple, df.select(sorted(df.columns)).collect())) == sorted(
        con.execute(f"SELECT {columns} FROM ({queries.ORACLE[name]})").fetchall())
