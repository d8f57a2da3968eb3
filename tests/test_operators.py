import pytest

from quillmark.functions import similarity
from quillmark.operators import decide, lists


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_f05_examples(spark):
    s1 = spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string")
    pred = spark.createDataFrame([("a", "S2-00047"), ("a", "S2-00193"), ("a", "S3-00812"), ("c", "x")], "s1 string, t string")
    truth = spark.createDataFrame([("a", "S2-00047"), ("a", "S3-00812")], "s1 string, t string")
    c = decide.counts(s1, pred, truth)
    f = {r.s1: r.f for r in c.select("s1", decide.f05(c.tp, c.n_pred, c.n_true).alias("f")).collect()}
    assert round(f["a"], 3) == 0.714 and f["b"] == 1.0 and f["c"] == 0.0


def test_vote_keeps_two_of_three(spark):
    runs = [spark.createDataFrame([(1, t) for t in x], "s1 int, t string") for x in ("ABC", "AB", "ABD")]
    assert rows(decide.vote(runs, 2).select("t")) == [("A",), ("B",)]


def test_rule_ties_go_to_the_smaller_target(spark):
    p = spark.createDataFrame([(1, 2, 0.9), (1, 1, 0.9), (1, 3, 0.5), (2, 1, 0.3)], "s1 int, t int, p double")
    assert rows(decide.apply_rule(p, 0.55, 0.95, 0.7)) == [(1, 1, 0.9)]
    assert rows(lists.assign_targets(p, 0.0)) == [(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.5), (2, 1, 0.0)]


def test_similarity_definitions():
    assert similarity._ratio("abcd", "bcde") == 75.0
    assert similarity._set_ratio("a b c", "b a") == 100.0
    assert similarity._set_ratio("", "a") == 0.0
    assert similarity._partial("abc", "xxabcxx") == 100.0
    assert round(similarity._jaro_winkler("martha", "marhta"), 4) == 0.9611


def test_registry_covers_its_oracles():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


@pytest.mark.parametrize("name", ["flagship_block_decide_f05", "w13_assign", "d1_rule", "a8_rare_tokens"])
def test_queries_match_sql(spark, name):
    import os

    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()[list(got.columns)]
    key = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.itertuples(index=False))
    assert repr(key(got)).replace("nan", "None") == repr(key(want)).replace("nan", "None")
