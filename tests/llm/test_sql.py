"""Queries with SQL of their own give that SQL's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from tallyspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    round_ = lambda v: round(v, 12) if isinstance(v, float) else v
    got = sorted((tuple(map(round_, r)) for r in df.select(*columns).collect()), key=repr)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(round_(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
