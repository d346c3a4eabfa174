from tallyspark.llm.graph import components


def test_long_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(301)) and all(found[1000 + i] == 1000 for i in range(200))
    assert found[6001] == found[6000] == 6000 and 5000 not in found
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
