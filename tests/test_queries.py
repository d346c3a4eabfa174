"""Every query with SQL of its own gives that SQL's rows on the smallest tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest
from tallyspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        at = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in found.fetchall())
    assert got == want


def test_every_query_runs_without_python_rows_in_the_plans_that_need_none(spark):
    for name in ("macro_mean_nested", "kappa_labels", "interval_overlap", "hash_chain"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
