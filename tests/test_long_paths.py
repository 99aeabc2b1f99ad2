"""Components of graphs with long paths."""

from lodestream.operators import panels


def test_a_long_path_is_one_component(spark):
    path = [*range(50, 101), 0]
    other = list(range(1000, 1200))
    edges = [*zip(path[:-1], path[1:], strict=True), *zip(other[1:], other[:-1], strict=True), (2000, 2000)]
    got = {r["v"]: r["component"] for r in panels.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {v: 0 for v in path} | {v: 1000 for v in other}
