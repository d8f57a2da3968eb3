"""Vector searches in blocks of any size against all products."""

import numpy as np
import pytest

from quillmark.operators import blocking


@pytest.mark.parametrize("rows", [3, 40, 32_768])
def test_blocks_do_not_change_the_best(spark, monkeypatch, rows):
    monkeypatch.setattr(blocking, "TILE_ROWS", 4)
    rng = np.random.default_rng(3)
    a = [(i, int(g), [float(x) for x in v]) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-3, 4, (60, 5))))]
    b = [(1000 + i, int(g), [float(x) for x in v]) for i, (g, v) in enumerate(zip(rng.integers(0, 2, 90), rng.integers(-3, 4, (90, 5))))]
    s1 = spark.createDataFrame(a, "s1 long, grp int, v array<float>")
    t = spark.createDataFrame(b, "t long, grp int, w array<float>")
    got = {}
    for r in blocking.ranked(blocking._blocked_best(s1, t, 4, "s1", rows), 4).collect():
        got.setdefault(r.s1, []).append((r["rank"], r.t, r.score))
    for i, g, v in a:
        line = sorted((-float(np.dot(v, w)), j) for j, h, w in b if h == g)[:4]
        assert sorted(got.get(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(line)]
    back = {r.t: r for r in blocking._blocked_best(s1, t, 1, "t", rows).groupBy("t").agg({"score": "max"}).withColumnRenamed("max(score)", "best").collect()}
    assert all(back[j].best == max(float(np.dot(v, w)) for _, h, v in a if h == g) for j, g, w in b)


def test_copies_follow_the_blocks(spark):
    s1 = spark.range(40).selectExpr("id AS s1", "1 AS grp", "array(1f, 2f) AS v")
    t = spark.range(50).selectExpr("id AS t", "1 AS grp", "array(1f, 2f) AS w")
    assert blocking.vector_topk(s1, t, 3).count() == 120
    assert blocking.reverse_top2(s1, t.limit(0)).count() == 0
