"""Words in tasks: parts of an address without a listed word are taken whole, words of a text are made where they are counted and looked up."""

from pyspark.sql import functions as F

from quillmark.functions import addresses
from quillmark.operators import features, tokens


def test_plain_parts_are_taken_whole(monkeypatch):
    asked = []
    part = addresses._part
    monkeypatch.setattr(addresses, "_part", lambda words: asked.append(words) or part(words))
    got = addresses.views("abc déf, xyz st, ghi 012, ,jkl near mno")
    assert got == ("abc def xyz street ghi 12 jkl near mno", "abc def xyz street ghi 12 jkl", "near mno", "12", "", "12")
    assert asked == [["xyz", "st"], ["ghi", "012"], ["jkl", "near", "mno"]]


def test_words_of_texts_as_of_arrays(spark):
    rows = spark.createDataFrame([(1, "a b a\tc", "x"), (2, "b\x1cd  b", "y"), (3, "", "x"), (4, None, "x"), (5, "e a", None)], "key long, v string, country string")
    named = {"d": tokens.Words("v"), "d_pc": tokens.Words("v", "country")}
    freq = tokens.counted_words(rows, named).cache()
    one = rows.select(F.explode(tokens.words("v")).alias("token")).groupBy("token").count().collect()
    assert {(r.token, r.df) for r in freq.where("name = 'd'").collect()} == {(r.token, r["count"]) for r in one}
    for most in (0, 1, 100):  # all, some and no words travel
        got = {r.key: (r.d, r.d_pc) for r in tokens.looked_up(rows, freq, named, most).collect()}
        given = {r.key: r.d for r in tokens.looked_up(rows, freq, {"d": tokens.words("v")}, most).collect()}
        assert got == {1: ([2, 2, 1], [1, 1, 1]), 2: ([1, 2], [1, 1]), 3: ([], []), 4: ([], []), 5: ([1, 2], [])}, most
        assert given == {k: v[0] for k, v in got.items()}


def test_frequencies_in_one_aggregation(spark):
    """No table by country where none is asked for."""
    made = []
    rows = spark.createDataFrame([(1, "c", "a b"), (2, None, "b")], "key long, country string, v string")
    out = features.with_frequencies(rows, [("v", "p", False)], lambda d: made.append(d.columns) or d)
    assert {r.key: r._d_p for r in out.collect()} == {1: [1, 2], 2: [2]} and made == [["name", "token", "df"]]
