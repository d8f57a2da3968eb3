"""Boosted trees: bounds of monotone columns, the side of missing values, folds, early stopping; folds and row numbers of any group; two best of a target."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.operators import blocking, boosting, lists, ranking, training
from quillmark.operators.boosting import Fold, Params

SMALL = Params(rounds=15, stop=3, rate=0.3, depth=3, leaves=6, bins=24, least_rows=5)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.random((n, 3))
    y = (3 * x[:, 0] - 2 * x[:, 1] + np.sin(9 * x[:, 2]) + rng.normal(0, 0.4, n) > 0.8).astype(float)
    d = pd.DataFrame({"s1": np.arange(n) // 4, "t": np.arange(n), "up_score": x[:, 0], "down_gap": x[:, 1], "free": x[:, 2], "label": y})
    d.loc[::5, "up_score"] = None
    d.loc[d.index % 5 == 0, "label"] = (rng.random(len(d.index[::5])) < 0.9).astype(float)  # missing says yes
    return spark.createDataFrame(d).withColumn("label", F.col("label").cast("int")).withColumn("fold", (F.col("s1") % 3).cast("int")).persist()


NAMES = ["up_score", "down_gap", "free"]


@pytest.fixture(scope="module")
def models(rows):
    return boosting.fit(rows, NAMES, ["s1", "t"], params=SMALL, signs=training.directions(NAMES))


def test_directions():
    assert [training.direction(n) for n in ("name_core_tset", "b4_rank", "emb_cos_gap", "addr_max_unmatched_idf_t", "combo", "emb_cos", "house_eq", "emb_cos_margin")] == [1, -1, -1, -1, 1, 0, 1, 1]


def test_scores_are_monotone_on_a_grid(models):
    m = models[Fold(0)]
    rng = np.random.default_rng(2)
    for column, sign in ((0, 1), (1, -1)):
        g = np.repeat(rng.random((40, 3)), 50, 0)
        g[:, column] = np.tile(np.linspace(-0.1, 1.1, 50), 40)
        steps = np.diff(m.margins(boosting.binned(list(g.T), m.edges)).reshape(40, 50), axis=1) * sign
        assert (steps >= -1e-12).all() and (steps > 1e-6).any()


def test_missing_values_have_a_learned_side(models):
    m = models[Fold(0)]
    x = np.array([[np.nan, 0.9, 0.1], [0.05, 0.9, 0.1]])
    missing, low = m.margins(boosting.binned(list(x.T), m.edges))
    assert missing > 0.5 > 0 > low


def test_models_stop_at_the_best_round(models):
    for m in models.values():
        assert m.best_round == int(np.argmin(m.losses)) == len(m.trees)
        assert m.losses[m.best_round] < m.losses[0] and len(m.losses) <= SMALL.rounds + 1
        assert [n for n, _ in m.importances()][-1] in NAMES and m.importances()[0][1] > 0


def test_trees_do_not_depend_on_how_rows_are_dealt(rows, models):
    other = boosting.fit(rows.repartition(7).orderBy(F.desc("t")), NAMES, ["s1", "t"], params=SMALL, models=[0], signs=training.directions(NAMES))[Fold(0)]
    mine = models[Fold(0)]
    assert other.losses == mine.losses
    assert all((a.value == b.value).all() and (a.feature == b.feature).all() and (a.bin == b.bin).all() for a, b in zip(mine.trees, other.trees, strict=True))


def test_no_key_is_scored_by_a_model_that_saw_it(rows, models):
    """The labels of fold 1 turned round: its own scores stay, as its model hasn't seen them."""
    turned = rows.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    other = boosting.fit(turned, NAMES, ["s1", "t"], params=Params(rounds=5, stop=9, depth=2, bins=24), models=[1])
    plain = boosting.fit(rows, NAMES, ["s1", "t"], params=Params(rounds=5, stop=9, depth=2, bins=24), models=[1])
    assert all((a.feature == b.feature).all() and (a.value == b.value).all() for a, b in zip(other[Fold(1)].trees, plain[Fold(1)].trees))
    out = boosting.score(rows, models, "p", fold="fold").toPandas()
    assert len(out) == 3000 and out.p.between(0, 1).all()
    assert -np.mean(np.where(out.label == 1, np.log(out.p), np.log(1 - out.p))) < 0.45


def test_models_without_a_group(rows):
    x = rows.withColumn("g", (F.col("s1") % 2).cast("int"))
    got = boosting.fit(x, NAMES, ["s1", "t"], params=Params(rounds=3, stop=9, depth=2, bins=24), models=[0], group="g")
    alone = boosting.fit(x.where("g <> 1"), NAMES, ["s1", "t"], params=Params(rounds=3, stop=9, depth=2, bins=24), models=[0])[Fold(0)]
    assert set(got) == {Fold(0, 0), Fold(0, 1)}
    assert got[Fold(0, 1)].base == alone.base


def test_odd_tables(spark, rows):
    one = rows.withColumn("label", F.lit(1))
    m = boosting.fit(one, NAMES, ["s1", "t"], params=SMALL, models=[0])[Fold(0)]
    assert boosting.score(rows, {Fold(0): m}).agg(F.min("p")).first()[0] > 0.9
    empty = boosting.fit(rows.limit(0), NAMES, ["s1", "t"], params=SMALL)
    assert empty == {}
    nothing = boosting.fit(rows.withColumn("free", F.lit(None).cast("double")), ["free"], ["s1", "t"], params=SMALL, models=[0])[Fold(0)]
    assert nothing.trees == []


def test_stage2_rows_are_scored_out_of_fold(spark, rows):
    scored = rows.select("s1", "t", "label", "free", F.col("down_gap").alias("p"))
    targets = scored.selectExpr("t AS key", "concat('n', t % 7) AS name", "'a' AS addr", "1 AS source", "CAST(NULL AS ARRAY<FLOAT>) AS emb")
    out, models = training.stage2(scored, targets, ["free"], folds=3, params=Params(rounds=4, stop=9, depth=2, bins=16))
    assert set(models) == {Fold(0), Fold(1), Fold(2)} and "p1" in models[Fold(0)].names and len(models[Fold(0)].names) > 20
    got = out.toPandas()
    assert len(got) == 3000 and got.groupby("s1").fold.nunique().max() == 1 and got.p.notna().all()


def test_pseudo_rounds_end_when_nothing_is_gained(spark, rows):
    own = rows.select("s1").distinct().selectExpr("s1", "concat('c', s1 % 2) AS country", "CASE WHEN s1 % 4 < 2 THEN 'train' WHEN s1 % 4 = 2 THEN 'held' ELSE 'open' END AS role")
    how = training.Pseudo(hi=0.6, lo=0.6, lo_single=0.6, rule=(0.6, 0.6, 0.0), rounds=2)
    got = training.pseudo_rounds(rows.drop("fold"), NAMES, own, how, Params(rounds=4, stop=9, depth=3, bins=16), folds=3)[0].toPandas()
    assert got["round"].tolist() == list(range(len(got))) and got.kept.iloc[0] and 2 <= len(got) <= 3
    assert (got.n_pairs.iloc[1:] > 0).all() and got.macro_f05.between(0, 1).all()
    best = got[got.kept].macro_f05.tolist()
    assert best == sorted(best) and got.kept.iloc[:-1].all()


def greedy(sizes, folds):
    loads, many = [0] * folds, {}
    for s in sorted(sizes, reverse=True):
        f = loads.index(min(loads))
        loads[f] += s
        many.setdefault(s, [0] * folds)[f] += 1
    return many, loads


def test_quotas_are_those_of_the_lightest_fold():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, rng.integers(2, 40), rng.integers(1, 60)).tolist()
        folds = int(rng.integers(1, 7))
        assert ranking.quotas([(s, sizes.count(s)) for s in {*sizes}], folds) == greedy(sizes, folds)[0]


def test_balanced_folds_and_numbers(spark):
    rows = spark.createDataFrame([(k % 13 if k % 3 else None, k) for k in range(700)], "key long, k long")
    got = ranking.balanced_folds(rows, "key", 4, lambda d: d.persist()).toPandas()
    loads = got.groupby("fold")["size"].sum()
    assert got["size"].sum() == 700 and len(got) == 14 and loads.max() - loads.min() <= got["size"].max()
    n = ranking.numbered(rows, ["key"], ["k"], lambda d: d.persist()).toPandas()
    for _, g in n.groupby("key", dropna=False):
        assert g.sort_values("k").n.tolist() == list(range(1, len(g) + 1))
    assert sorted(ranking.numbered(rows, [], ["k"], lambda d: d.persist()).toPandas().n) == list(range(1, 701))


def test_two_best_needs_no_window(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"s1": np.arange(400), "t": np.where(np.arange(400) < 250, 7, rng.integers(0, 9, 400)), "p": rng.integers(0, 6, 400) / 5})
    df = spark.createDataFrame(d).withColumn("p", F.when(F.col("s1") % 11 != 0, F.col("p")))
    for out in (lists.competition_p(df), lists.assign_targets(df, 0.1), lists.target_competition(df.withColumnRenamed("p", "score"))):
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = lists.competition_p(df).toPandas().set_index("s1")
    for t, g in d[d.s1 % 11 != 0].groupby("t"):
        order = sorted(zip(-g.p, g.s1))
        for s1, p in zip(g.s1, g.p):
            others = [-v for v, s in order if s != s1]
            r = got.loc[s1]
            assert r.tc_other == max(others, default=0) and r.tc_is_best == int(order[0][1] == s1) and r.tc_n == len(others) and r.tc_n_hi == sum(v > 0.5 for v in others)
    assert got.loc[0].isna().sum() == 5


def test_keys_over_the_cap_have_an_exact_way(spark):
    rng = np.random.default_rng(6)
    a = spark.createDataFrame([(i, f"k{rng.integers(0, 4)}" if i % 9 else None) for i in range(120)], "s1 long, key string")
    b = spark.createDataFrame([(1000 + i, f"k{min(rng.integers(0, 12), 5)}" if i % 7 else None) for i in range(300)], "t long, key string")
    whole = sorted(map(tuple, a.join(b, "key").select("s1", "t").collect()))
    for cap in (0, 20, 1000):
        some, rest = blocking.key_block_pairs(a, b, cap).collect(), blocking.key_block_rest(a, b, cap, 16, lambda d: d.persist()).collect()
        assert sorted(map(tuple, some + rest)) == whole
        told = blocking.key_block_left_out(a, b, cap).agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0]
        assert told == len(rest)
