from orebed.operators import clustering


def test_the_least_node_at_the_far_end_of_a_long_path(spark):
    path = [*((i, i + 1) for i in range(1, 300)), (300, 0), (1000, 1000)]
    found = {r["node"]: r["component"] for r in clustering.connected(spark.createDataFrame(path, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000}
