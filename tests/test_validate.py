from pyspark.sql import functions as F

from bundles import CASES, documents
from tallyspark.operators import validate
from tallyspark.sources.schemas import BUNDLE


def test_each_broken_bundle_gives_its_code(spark):
    rows = spark.createDataFrame(documents(), "name string, body string").select(F.from_json("body", BUNDLE).alias("b")).select("b.*")
    issues = validate.bundle_issues(rows.persist())
    found: dict[str, set[str]] = {}
    for r in issues.collect():
        found.setdefault(r.bundle_id, set()).add(r.code)
    wrong = {n: (code, sorted(found.get(n, set()))) for n, (_, code) in CASES.items() if (code not in found.get(n, set()) if code else n in found)}
    assert not wrong
    valid = {r.bundle_id for r in validate.validity(rows, issues).where("valid").collect()}
    assert valid == {n for n, (_, code) in CASES.items() if code is None}


def test_no_table_of_a_bundle_goes_through_the_driver(spark, tmp_path):
    at = str(tmp_path / "bundles")
    spark.createDataFrame(documents()[:3], "name string, body string").select(F.from_json("body", BUNDLE).alias("b")).select("b.*").write.parquet(at)
    plan = validate.bundle_issues(spark.read.parquet(at))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
