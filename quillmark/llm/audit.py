"""How filters interact: a trie of all filter orders, run depth first over survivors, each unordered set of filters once.

Five filters have 120 orders, but what an order has left after some steps depends only on the set of filters applied so far: 32 states, 80
edges. The walk goes depth first from the state without filters; each state holds its survivors as a persisted DataFrame, made from its
parent's by applying one more filter; a state met before isn't walked again. At each edge what the next filter removes is counted by part.
At most one state a level is persisted at a time; if an executor is lost, its rows are filtered again from the table of measures.

The texts are read once, for that table: measures and marks of each document, without its text. DataFrame operations only.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import materialize, scratch

#: The filters by letter: when a row of `measured` fails.
FAILS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 2 * n_points",
    "D": "has_symbol",
    "E": "is_copy",
}

#: Keys with more than this share of all rows are marked by a broadcast: there are at most 1 / HOT of them.
HOT = 0.001

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row of docs: part, the measures of its text, is_copy, good, toxic; as a table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w = F.expr(r"filter(split(_t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("_t"))
    base = base.select(
        "doc_id", "part", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.expr("CAST(octet_length(_t) - octet_length(translate(_t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT)").alias("n_upper"), F.length("_t").cast("long").alias("n_points"),
        F.expr("_t rlike '[#$%&*|]'").alias("has_symbol"), F.xxhash64("_t").alias("_h"), F.xxhash64(F.lit(1), "_t").alias("_g"),
    )
    base = materialize(base)
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("doc_id is not null and (good = 1 or toxic = 1)")
    same = materialize(base.groupBy("_h", "_g").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    bar = F.lit(max(1.0, HOT * base.count()))
    same = same.where("_first is not null")
    hot, rest = same.where(F.col("_n") > bar), same.where(F.col("_n") <= bar)
    first = base.join(F.broadcast(hot.select("_h", "_g", F.col("_first").alias("_hot"))), ["_h", "_g"], "left")
    cold = first.where("_hot is null").drop("_hot").join(rest.select("_h", "_g", "_first"), ["_h", "_g"], "left")
    own = cold.unionByName(first.where("_hot is not null").withColumnRenamed("_hot", "_first"))
    own = own.withColumn("is_copy", F.expr("_first is not null and (doc_id is null or doc_id > _first)"))
    own = own.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    return materialize(own.select("doc_id", "part", "n_words", "n_distinct", "n_upper", "n_points", "has_symbol", "is_copy", "good", "toxic"))


def edges(rows: DataFrame, fails: dict[str, str], by: str = "part") -> DataFrame:
    """(part, state: the letters applied, sorted; filter; kept, removed, good_lost, toxic_lost) of every edge of the trie at which the part
    still has rows; as a table."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    seen: set[frozenset[str]] = set()

    def visit(state: frozenset[str], left: DataFrame) -> None:
        seen.add(state)
        if len(state) == len(fails):
            return
        left = left.persist(StorageLevel.MEMORY_AND_DISK)
        todo = [f for f in fails if f not in state]
        gone = {f: F.expr(fails[f]) for f in todo}
        counts = [c for f in todo for c in (F.count_if(gone[f]).alias(f"removed_{f}"), F.sum(F.when(gone[f], F.col("good")).otherwise(0)).alias(f"good_{f}"), F.sum(F.when(gone[f], F.col("toxic")).otherwise(0)).alias(f"toxic_{f}"))]
        each = left.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *counts)
        line = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), (F.col("n") - F.col(f"removed_{f}")).alias("kept"), F.col(f"removed_{f}").alias("removed"), F.col(f"good_{f}").alias("good_lost"), F.col(f"toxic_{f}").alias("toxic_lost")) for f in todo)))
        each.select(by, F.lit("".join(sorted(state))).alias("state"), line.alias("e")).select(by, "state", "e.*").write.mode("append").parquet(path)
        for f in todo:
            if state | {f} not in seen:
                visit(state | {f}, left.where(~gone[f]))
        left.unpersist()

    visit(frozenset(), rows)
    return spark.read.parquet(path)


def interactions(docs: DataFrame, labels: DataFrame, fails: dict[str, str] = FAILS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for each source value, each order of the
    filters and each step of it.

    A null source is the part '', together with an empty one; a null text is empty, and has no words. A text is a copy if a smaller doc_id has the
    same; a null doc_id is larger than all others, and rows that tie are no copies of each other. Repeated rows count each; repeated labels of a
    document count once, if any says 1, and labels of a null doc_id belong to none. An empty table gives no rows. Other columns aren't read.
    """
    rows = measured(docs, labels)
    found = edges(rows, fails)
    letters = sorted(fails)
    every = "".join(letters)
    parts = found.where("state = ''").select("part").distinct()
    states = [(s, f) for s in sorted({"".join(sorted(o[:k])) for o in permutations(letters) for k in range(len(letters))}) for f in letters if f not in s]
    whole = parts.select("part", F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(factorial(len(s)) * factorial(len(letters) - 1 - len(s))).cast("long").alias("orders")) for s, f in states))).alias("e")).select("part", "e.*")
    whole = whole.join(found, ["part", "state", "filter"], "left").na.fill(0, ["kept", "removed", "good_lost", "toxic_lost"])
    of_filter = whole.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == "", F.col("removed"))).alias("fails"),
        F.sum(F.when(F.length("state") == len(letters) - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    told = materialize(whole.join(of_filter, ["part", "filter"]).withColumn("redundant", F.col("fails") - F.col("removed")))
    spark = docs.sparkSession
    steps = spark.createDataFrame([("".join(o), k + 1, "".join(sorted(o[:k])), o[k]) for o in permutations(every) for k in range(len(every))], "filter_order string, step int, state string, filter string")
    out = told.join(F.broadcast(steps), ["state", "filter"])  # 600 rows for five filters
    return out.select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in COUNTS))
