"""What the n-gram join moves and writes: fewer meetings and sets, and no link less."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, docs

from quillmark.llm import jaccard


def linked(a, b, percent):
    common = len(np.intersect1d(a, b))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


@pytest.mark.parametrize("percent", [0, 50, 80, 95])
def test_linked_sets_meet(percent):
    """At the first of their common members, in an order by rank, whatever else is in the lists and however members' halves agree."""
    rng, shape = np.random.default_rng(percent), jaccard.Shape(percent=percent, count_bits=8, slice_bits=8)
    ranks, pairs = rng.integers(0, 4, 256).astype(np.uint8), 0
    for _ in range(40):
        held = []
        for _ in range(4):
            base = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
            for _ in range(rng.integers(1, 7)):
                own = base[rng.random(len(base)) >= rng.choice([0, 0.02, (100 - percent) / 100])]
                held.append(np.unique(np.append(own, rng.integers(0, 1 << 62, rng.integers(0, 1 + len(base) * (100 - percent) // 150)).astype(np.uint64))))
        held = [s for s in held if len(s)]
        columns = [[], [], [], []]
        for k, s in enumerate(held):
            t, _ = jaccard._first(s, ranks, shape)
            most = jaccard.largest(len(s), np.arange(len(t)), percent)
            for c, x in zip(columns, (np.full(len(t), k), (t % np.uint64(1 << 20)).astype(np.uint32), np.full(len(t), jaccard._code(len(s))), jaccard._code(most))):
                c.append(x)
        met = set(zip(*(x.tolist() for x in jaccard._met(*(np.concatenate(c) for c in columns)))))
        at = {k: {p for own, p in met if own == k} for k in range(len(held))}
        for i in range(len(held)):
            for j in range(i):
                if linked(held[i], held[j], percent):
                    pairs += 1
                    assert at[i] & at[j]
    assert pairs > 100


def test_codes_of_sizes_keep_their_order():
    n = np.unique(np.concatenate([np.arange(2000), np.geomspace(1, 1 << 40, 5000).astype(np.int64)]))
    codes = jaccard._code(n).astype(int)
    assert (np.diff(codes) >= 0).all() and codes.max() < 256 and len({*codes[1:9]}) == 8  # sizes from 1 to 8 have their own


def test_sets_that_cannot_be_linked_do_not_meet(spark):
    """Texts of very different lengths, each pair with one n-gram in common."""
    rng = np.random.default_rng(4)
    words = iter(rng.permutation(1 << 20))
    text = lambda n, shared: " ".join([*(f"w{next(words)}" for _ in range(n)), *shared])
    texts = []
    for _ in range(200):
        shared = [f"s{next(words)}" for _ in range(5)]
        texts += [text(10, shared), text(200, shared)]
    shape = jaccard.Shape(count_bits=12, slice_bits=10)
    ranks = spark.sparkContext.broadcast(np.zeros(1 << shape.count_bits, np.uint8))
    assert jaccard._given(docs(spark, texts), ranks, {}, shape, 4).count() == 0
    assert jaccard._given(docs(spark, [texts[0], texts[0] + " x", *texts[2:]]), ranks, {}, shape, 4).count() == 1


def family(rng, copies):
    base = [f"w{x}" for x in rng.integers(0, 1 << 30, 80)]
    return [" ".join([*base[:-1], f"x{i}"]) for i in range(copies)]


@pytest.fixture
def tables(monkeypatch):
    """The tables that the join writes, as they are handed over."""
    seen, materialize = [], jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df: seen.append(df) or materialize(df))
    return seen


def test_only_sets_of_large_galaxies_are_written_out(spark, tables):
    rng = np.random.default_rng(6)
    small, large = [t for _ in range(20) for t in family(rng, 3)], family(rng, 30)
    for texts, most in ((small, 0), (small + large, 30)):
        tables.clear()
        got = jaccard.join(docs(spark, texts), jaccard.Shape(count_bits=12, slice_bits=10, room_sets=8, leaf=4)).where("doc_id is not null").collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == dict(enumerate(brute_components(texts)))
        assert sum(df.count() for df in tables if "s" in df.columns) == most


def test_vectors_are_sifted_before_they_are_dealt_out(spark, tables):
    """The bitmap first: a join that deals all sets out comes after it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jaccard.join(docs(spark, family(np.random.default_rng(7), 3)), jaccard.Shape(count_bits=12, slice_bits=10))
        (vectors,) = (df for df in tables if df.columns == ["k", "n", "v"])
        plan = vectors.select(F.sum("n"))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert ["Broadcast" in line for line in joins] == [False, True]  # from the top: the last join first
