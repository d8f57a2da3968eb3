import numpy as np
import pytest

from quillmark.llm.graph import components, stars


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graphs():
    rng = np.random.default_rng(5)
    chain = rng.permutation(200).tolist()
    yield list(zip(chain, chain[1:]))  # a path whose names are in no order
    yield [(0, -i - 1) for i in range(150)] + [(1000 + i, 0) for i in range(150)]  # a hub among lesser and greater nodes
    yield [(int(a), int(b)) for a, b in rng.integers(-80, 80, (70, 2)) if a != b] * 2  # many parts, edges twice
    yield [(-(2**63), 2**63 - 1), (2**63 - 1, 7)]


def test_stars_equal_brute_force():
    for edges in graphs():
        a, b = np.array(edges, np.int64).T
        node, root = stars(a, b)
        want = {x: r for x, r in brute(edges).items() if x != r}
        assert dict(zip(node.tolist(), root.tolist())) == want


@pytest.mark.parametrize("block", [2, 1 << 20])
def test_components_equal_brute_force(spark, block):
    edges = [((a << 40) + k, (b << 40) + k) for k, g in enumerate(list(graphs())[:3]) for a, b in g]
    rows = spark.createDataFrame([*edges, (9, 9), (None, 5), (6, None)], "a long, b long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3" if block == 2 else "10000")
    try:
        got = components(rows, block=block).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == brute(edges)


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
