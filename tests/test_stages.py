"""The stage operators against their SQL, and small cases by hand."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillmark.functions import addresses, ids
from quillmark.operators import decide, reports
from quillmark.plans import stages  # noqa: F401
from quillmark.sources import store, synthetic

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["f_pruner_features_sql", "w12_block_features", "d5_run_predict", "d7_validate_files", "u5_vote_lists", "a10_recall_by_country", "a28_stress_slices", "s5_load_normalized", "p21_hash_uniform", "p19_normalize_frame"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted(repr([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in rows)
    assert key(got.collect()) == key(want)


def test_address_views_by_hand():
    assert addresses.views("Near SBI ATM, 5 Ninth St, St Nazaire") == ("near sbi atm 5 9th street saint nazaire", "5 9th street saint nazaire", "near sbi atm", "5", "", "5")
    assert addresses.views("12 - 014 rue de l'Église, 75008 Paris")[3:] == ("12-14", "75008", "12 14 75008")
    assert addresses.views(None) == addresses.views(",,") == ("",) * 6


def test_splitmix_vectors(spark):
    """The published finaliser over keys of both signs, in ANSI mode."""

    def want(key, salt):
        z = (key + (salt + 1) * 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return ((z ^ z >> 31) >> 11) / 2**53

    keys = [0, 1, -1, 20166376419, 2**63 - 1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert [r.u for r in df.select(ids.splitmix(df.k, 4).alias("u")).collect()] == [want(k, 4) for k in keys]


def test_vote_keeps_the_first_lists_order(spark):
    runs = [spark.createDataFrame([("a", x), ("b", y)], "s1 string, ids string") for x, y in (("C,A,B", ""), ("A,B", "Z,Y"), ("A,C,D", "Y,Z"))]
    assert dict(map(tuple, decide.vote_lists(runs, 2).collect())) == {"a": "C,A,B", "b": "Z,Y"}


def test_settings_and_stamps(spark, tmp_path):
    own = store.Settings.load({"data": "x"}, {"QUILLMARK_T_EMIT": "0.6"})
    assert (own.data, own.t_emit, own.source("test", 2)) == ("x", 0.6, "x/test/test_source2.tsv")
    with pytest.raises(ValueError):
        store.Settings.load({"nope": 1})
    assert store.stamp({"a": 1}, "k") == store.stamp({"a": 1}, "k") != store.stamp({"a": 2}, "k")
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [store.made(spark, str(tmp_path), "k", make).count() for _ in range(2)] == [3, 3] and calls == [1]


def test_synthetic_sources_do_not_depend_on_partitions(spark):
    a, b, truth = synthetic.sources(spark.range(300), ["US", "India", "France"])
    assert a.count() == 300 and a.select("entity_id").distinct().count() == 300
    listed = sum(len(r.matched_entity_ids.split(",")) if r.matched_entity_ids else 0 for r in truth.collect())
    assert listed == b.count() and {r.entity_id[:3] for r in b.collect()} == {"S2-", "S3-"}
    assert 0 < truth.where("matched_entity_ids = ''").count() < 60


def test_unseen_score():
    unseen, seen = reports.unseen_score(0.9, 0.6, 0.4, 0.05)
    assert round(unseen, 6) == 0.8 and round(seen, 6) == round((0.6 - 0.02) / 0.6, 6)


def test_emission_switch(spark):
    p = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.2)], "s1 int, t int, p double")
    assert sorted(map(tuple, decide.emit(p, "rule").select("s1", "t").collect())) == [(1, 1), (1, 2)]
    assert sorted(map(tuple, decide.emit(p, "expected_f").select("s1", "t").collect())) == [(1, 1), (1, 2)]
    with pytest.raises(ValueError):
        decide.emit(p, "other")
