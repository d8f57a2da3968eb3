"""What a task holds of a batch as Python objects is bounded."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.functions import addresses, similarity
from quillmark.functions.batches import PIECE, pieces
from quillmark.operators import blocking, features


def test_pieces():
    texts = pa.array(["a" * (i % 50) for i in range(1000)] + [None, "b" * 5000])
    got = list(pieces([texts, pa.array(range(1002))], 2000))
    assert [x for a, _ in got for x in a.to_pylist()] == texts.to_pylist() and [x for _, b in got for x in b.to_pylist()] == list(range(1002))
    assert len(got) > 10 and all(len(a) == 1 or a.nbytes + b.nbytes <= 2000 for a, b in got)
    assert [len(a) for (a,) in pieces([pa.array([], pa.string())])] == [0]


def test_address_views_leave_in_pieces():
    """A batch went through as a whole: an executor's Python grew with its batches."""
    line = "12 Main St, Near SBI ATM, Pune 411001, "
    batch = pa.array([line * (1 + i % 90) for i in range(2000)])
    out = list(addresses._views.func(iter([batch, pa.array([None], pa.string())])))
    assert len(out) > 2 and max(x.nbytes for x in out) < 3 * PIECE
    rows = [tuple(r.values()) for x in out for r in x.to_pylist()]
    assert rows == [addresses.views(x) for x in [*batch.to_pylist(), None]]


def _udf(monkeypatch, make):
    """The function that make hands to arrow_udf."""
    held = []
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: held.append(f) or (lambda *columns: None))
    monkeypatch.setattr(F, "col", str)
    make()
    return held[0]


def _peak(f) -> tuple:
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most / 1e6


def test_shared_words_of_a_large_batch(monkeypatch):
    """All words and frequencies of a batch stood in a task as Python objects at once."""
    run = _udf(monkeypatch, lambda: features.overlaps("v", "p"))
    text, n = " ".join(f"w{i}" for i in range(500)), 8000
    side = [pa.array([text, "w1 x", None, ""] * (n // 4)), pa.array([list(range(300, 800)), [300, 7], [], []] * (n // 4), pa.list_(pa.int32())), pa.array([1000] * n)]
    out, most = _peak(lambda: run(*side, *side[:1], *side[1:]))
    one = features._weights(text, list(range(300, 800)), 1000)
    assert most < 30 and len(out) == n and tuple(out[0].as_py().values()) == features.shared_words(one, one)
    assert out[1].as_py()["n_shared"] == 2 and out[2].as_py()["n_shared"] == 0


def test_scores_of_a_large_batch(monkeypatch):
    """A batch's texts stood in a task as Python objects at once."""
    run = _udf(monkeypatch, lambda: similarity.several(["name_ratio", "addr_tset"], *"abcd"))
    n = 2000
    name, long_ = pa.array(["blue star", None, "apple"] * n), pa.array([f"{i} " + "x" * 3000 for i in range(3 * n)])
    batch = (name, pa.array(["blue start"] * (3 * n)), long_, long_)
    (sizes, first), most = _peak(lambda: (lambda got: ([len(g) for g in got], got[0][:3].to_pylist()))(list(run(iter([batch])))))
    assert most < 20 and sum(sizes) == 3 * n and len(sizes) > 10
    assert first == [{"name_ratio": similarity._ratio(a, "blue start"), "addr_tset": 100.0} for a in ("blue star", "", "apple")]


def test_blocks_of_targets_are_bounded_by_grams(spark):
    """Blocks were bounded by rows alone: one of long texts had an index of any size."""
    rows = [("x", int(i % 4 == 0), i, [int(h) for h in range(i % 5, 40, 3)], [0.1 + (h * i % 7) / 10 for h in range(i % 5, 40, 3)]) for i in range(80)]
    packed = spark.createDataFrame(rows, "country string, side int, key long, h array<long>, w array<double>")
    best = lambda **how: sorted(map(tuple, blocking.ranked(blocking._best_of_blocks(packed, 5, **how), 5).collect()))
    every = best()
    cut = blocking._best_of_blocks(packed, 5, grams_=60)
    made = cut.groupBy("s1").count().agg(F.max("count")).first()[0]
    assert len(every) == 100 and best(grams_=60) == every and made > 20  # five of each of more than four blocks


def test_pairs_of_frequent_keys_are_dealt_by_their_number(spark, monkeypatch):
    """Cells were put together by their bytes: many millions of pairs were one task's."""
    monkeypatch.setattr(blocking, "TASK_PAIRS", 2_000, raising=False)
    s1, t = spark.range(300).selectExpr("id AS s1", "'k' AS key"), spark.range(300).selectExpr("1000 + id AS t", "'k' AS key")
    out = blocking.key_block_rest(s1, t, 20, 30, lambda d: d.localCheckpoint())
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert out.distinct().count() == sum(sizes) == 90_000 and len(sizes) > 20 and max(sizes) < 10_000
