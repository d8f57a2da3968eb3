"""Work is done once, and only where its result is read."""

import re

import pyarrow as pa

import __spark_entry__ as entry
from quillmark.operators import tokens

SF = "/root/testdata/sf0.001"


def test_texts_are_taken_apart_once(spark, monkeypatch):
    rows = spark.createDataFrame([("a b a", "x", 1), ("b", None, 2), (None, "y", 3)], "v string, c string, key long")
    _, used, arrays = tokens._listed(rows, {"d": tokens.Words("v"), "d_pc": tokens.Words("v", "c"), "e": tokens.Words("v", "c")})
    calls, split = [], tokens.split
    monkeypatch.setattr(tokens, "split", lambda t: calls.append(t) or split(t))
    got = arrays(pa.RecordBatch.from_pydict({"v": ["a b a", "b", None], "c": ["x", None, "y"], "key": [1, 2, 3]}))
    assert used == ["v", "c"] and calls == ["a b a", "b"]
    assert [g.to_pylist() for g in got] == [[["a", "b"], ["b"], []], [["x\x01a", "x\x01b"], [], []], [["x\x01a", "x\x01b"], [], []]]


def test_common_subsequences_are_not_made_where_nobody_reads_them(spark):
    passes = lambda name: len({*re.findall(r"\brun\([^)]*\)#\d+", entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString())})
    assert passes("f_stage1_features_sql") == passes("f_stage1_features") - 1


def test_targets_of_stage_2_come_from_records_that_are_written(spark):
    from quillmark.plans import stages

    normal = stages.written_records(spark, SF)
    given, own = stages.target_views(spark, SF, normal), stages.target_views(spark, SF)
    assert "run(" not in given._jdf.queryExecution().optimizedPlan().toString()  # no address is taken apart again
    assert given.dtypes == own.dtypes and sorted(given.collect()) == sorted(own.collect())
