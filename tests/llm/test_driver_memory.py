"""What a query of many steps leaves in the driver, and a task in its worker."""

from pyspark.sql import functions as F

from quillmark.llm import common, jaccard


def collections(spark):
    """Whole collections of the driver's JVM so far."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if any(w in b.getName() for w in ("Old", "MarkSweep", "Global", "ZGC", "Shenandoah")))


def test_steps_of_the_join_hand_memory_back(spark, monkeypatch):
    monkeypatch.setattr(common, "TIDY_S", 0.0)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(0, 30), i -> cast(i * (id div 2) as string)))").alias("text"))
    before = collections(spark)
    rows = jaccard.join(docs).collect()
    assert len(rows) == 40 and {r["component_id"] for r in rows} == set(range(0, 40, 2))
    assert collections(spark) - before >= 5


def test_memory_is_handed_back_at_most_once_in_a_while(spark, monkeypatch):
    monkeypatch.setattr(common, "_tidied", float("-inf"))
    assert [common.tidy(spark) for _ in range(3)] == [True, False, False]


def test_a_task_hands_its_memory_back_when_its_own_is_free(monkeypatch):
    told = []
    monkeypatch.setattr(common, "release", lambda: told.append("released"))

    def run(batches):
        try:
            yield from batches
        finally:
            told.append("ended")

    assert list(common.releasing(run)(iter([1, 2]))) == [1, 2]
    assert told == ["ended", "released"]
