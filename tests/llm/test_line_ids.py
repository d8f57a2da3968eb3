"""Line dedup under ids of other types, and a user's own columns through the pipeline's stage."""

import corpus_pipeline
from quillmark.llm import linededup

LONG = " ".join(f"w{k}" for k in range(12))


def test_string_ids(spark):
    rows = [("b", f"{LONG}\nshort"), ("a", f"{LONG.replace('w3 ', '')}\nshort"), (None, "short\nown"), ("9", None)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": (rows[1][1], 0), "b": ("", 2), None: ("own", 1), "9": (None, 0)}


def test_a_null_id_comes_after_the_largest(spark):
    top = (1 << 63) - 1
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame([(None, "x\na b"), (top, "a b\nx"), (-top, "y")], "doc_id long, text string")).collect()}
    assert got == {None: "", top: "a b\nx", -top: "y"}


def test_own_columns_stay_through_the_stage(spark):
    rows = spark.createDataFrame([(1, "a b\nc", "en", "s", 5, 77, "mine", 1), (2, "a b\nd", "en", "s", 5, 78, "yours", 2)], "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped string, own int")
    got = sorted(map(tuple, corpus_pipeline.line_stage(spark, rows, "").collect()))
    assert got == [(1, "a b\nc", "en", "s", 5, 77, "mine", 1), (2, "d", "en", "s", 1, 78, "yours", 2)]
