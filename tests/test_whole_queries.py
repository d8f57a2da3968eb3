import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    docs = [(1, "M/s L'Atelier s.a.s Ltd. 12 rue Victor Hugo, 75008 Paris", "fr"), (2, "M/s Atelier Ltd. 12 rue Victor Hugo, 69001 Lyon", "fr"), (3, "Plain Shop. no number", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_postal_comes_from_the_addresses(spark, folder):
    assert {r.key % 10: r.postal for r in entry.queries()["p13_postal"](spark, folder).collect()} == {1: "75008", 2: "69001", 3: ""}


def test_names_of_every_form(spark, folder):
    got = {r.key % 10: r.name_ascii for r in entry.queries()["p7_name_ascii"](spark, folder).collect()}
    assert got.keys() == {1, 2, 3} and "m/s" not in got[2] and got[3] == "plain shop"


def test_four_block_keys(spark, folder):
    got = {r.key % 10: r for r in entry.queries()["j5_block_keys"](spark, folder).collect()}
    assert all(got[1][k] for k in ("k_name", "k_postal", "k_house", "k_rare2"))
    assert got[1].k_postal.startswith("fr|75008|") and got[1].k_house == got[2].k_house == "fr|12|rue"
    assert got[3].k_postal is None and got[3].k_house is None and got[3].k_name == "fr|plain shop"


def test_the_whole_grid(spark):
    rows = {(r.t_emit, r.t_add, r.rel): r.macro_f05 for r in entry.queries()["d2_grid_search"](spark, SF).collect()}
    assert len(rows) == 14 * 16 * 6
    best = sorted(rows.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r.t_emit, r.t_add, r.rel) for r in entry.queries()["k4_best_thresholds"](spark, SF).collect()] == [k for k, _ in best]
