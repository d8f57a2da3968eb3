"""What only shows on larger tables."""

import math
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from quillmark.operators import blocking, tokens

SF = "/root/testdata/sf0.001"


def test_the_unknown_id_stays_unknown_among_many_parts(spark, tmp_path):
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1, 1_000_001).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.file, r.rule): r.n for r in entry.queries()["d7_validate_files"](spark, str(tmp_path)).collect()}
    assert got["matches", "unknown_id"] == 1 and got["matches", "not_in_candidates"] == 6 and got["broken", "comma_separated"] == 1


def by_hand(rows, kind, max_df, top_m, k):
    """tfidf_topk by definition, of (key, country, is_s1, text)."""
    tf, info = {}, {}
    for key, country, is_s1, text in rows:
        words = (text or "").split()
        padded = [f" {w} " for w in words]
        grams = words if kind == "word" else [(text or "")[i : i + 3] for i in range(len(text or "") - 2)] if kind == "char3" else [w[i : i + n] for w in padded for n in (2, 3, 4) for i in range(len(w) + 1 - n)]
        tf.setdefault(key, Counter()).update(grams)
        info[key] = (country, is_s1)
    n, df = len(rows), Counter(g for c in tf.values() for g in c)
    idf = {g: math.log((1 + n) / (1 + d)) + 1 for g, d in df.items()}
    w = {key: {g: x * idf[g] / math.sqrt(sum((y * idf[h]) ** 2 for h, y in c.items())) for g, x in c.items() if df[g] <= n * max_df} for key, c in tf.items()}
    out = set()
    for s1 in (x for x in w if info[x][1] and info[x][0]):
        q = sorted(w[s1], key=lambda g: (df[g], g.encode()))[:top_m]
        scored = [(-round(sum(w[s1][g] * w[t][g] for g in q if g in w[t]), 6), t) for t in w if not info[t][1] and info[t][0] == info[s1][0]]
        out |= {(s1, t, -x, i + 1) for i, (x, t) in enumerate(sorted(y for y in scored if y[0] < 0)[:k])}
    return out


@pytest.mark.parametrize("kind", ["word", "char3", "char_wb"])
def test_topk_by_hand(spark, kind, monkeypatch):
    draw = random.Random(4)
    name = lambda: " ".join("".join(draw.choice("abcdé𝄞") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 6)))
    rows = [(i, draw.choice(["x", "y", None]), i % 3 == 0, name()) for i in range(300)] + [(300, "x", True, None), (301, "x", False, ""), (302, "y", True, "ab\tcd\nab")]
    rows += [(4, rows[4][1], False, name()), (6, rows[6][1], True, name())]  # rows of one key
    monkeypatch.setattr(tokens.looked_up, "__defaults__", (20,))  # so that most tokens are joined
    blocks = blocking._best_of_blocks
    monkeypatch.setattr(blocking, "_best_of_blocks", lambda packed, k: blocks(packed, k, (5, 9)))
    got = blocking.tfidf_topk(spark.createDataFrame(rows, "key long, country string, is_s1 boolean, name string"), "name", kind, 0.4, 4, 3)
    assert {(r.s1, r.t, round(r.score, 6), r.rank) for r in got.select("s1", "t", "score", "rank").collect()} == by_hand(rows, kind, 0.4, 4, 3)


def test_topk_does_not_write_the_pairs_it_compares(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "x", i % 3 == 0, " ".join(words[(i * j) % 40] for j in range(1, 9))) for i in range(1500)]

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(spark.sparkContext._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    frame, before = spark.createDataFrame(rows, "key long, country string, is_s1 boolean, name string"), written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables have it
    try:
        assert blocking.tfidf_topk(frame, "name", "word", 1.0, 8, 5).count() == 2500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written() - before < 50_000


@pytest.mark.parametrize("name", ["f_pruner_features", "f_stage1_features"])
def test_feature_tables_have_a_small_plan_and_look_rare_words_up(spark, name, monkeypatch):
    rows = lambda df: sorted(map(repr, df.collect()))
    made = entry.queries()[name](spark, SF)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") < 30
    want = rows(made)
    monkeypatch.setattr(tokens.looked_up, "__defaults__", (20,))
    assert rows(entry.queries()[name](spark, SF)) == want and want
