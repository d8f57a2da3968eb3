"""What earlier stages of the pipeline leave in the executors goes before the workers of packing load their tables."""

import corpus_pipeline
from test_driver_memory import collections
from test_llm import docs


def test_packing_starts_with_collected_heaps(spark):
    rows, before = docs(spark, ["one two three"]), collections(spark)
    got = corpus_pipeline.packing_stage(spark, rows, "")
    assert collections(spark) > before  # in local mode the executor's JVM is the driver's
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in rows.collect()}
