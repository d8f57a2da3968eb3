"""Row numbers in groups of any size, and folds of equal size: no task holds a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]


def numbered(rows: DataFrame, by: list[str], order: list[str], keep: Keep, name: str = "n") -> DataFrame:
    """rows with a number from 1 in each group of `by`, in the order of the columns `order`, nulls first. Rows are dealt by ranges of both, so a
    group of any size lies in as many partitions as it fills; each partition's counts give the numbers that the next begins with. Rows that tie are
    numbered in any order. keep writes a table, as the cuts between partitions are sampled once."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    dealt = keep(rows.repartitionByRange(n, *line).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_c"))
    # a row for each partition and group: a group's own rows here are at most as many as partitions
    before = sums.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    before = before.select(F.col("_part").alias("_at"), *(F.col(c).alias(f"_by_{c}") for c in by), "_before").where("_before > 0")  # few: groups that go on from one partition to the next
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*line)))
    out = inside.join(F.broadcast(before), (F.col("_part") == F.col("_at")) & same, "left")  # a row for each partition at most
    return out.select(*rows.columns, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def quotas(sizes: list[tuple[int, int]], folds: int) -> dict[int, list[int]]:
    """For each (size, number of groups of that size), largest size first, how many of these groups go to each fold, as if one after the other went to the
    lightest one, the first of equals."""
    loads, out = [0] * folds, {}
    for size, many in sorted(sizes, reverse=True):
        taken = lambda level: [max(0, -(-(level - x) // size)) for x in loads]  # noqa: B023, E731  for all to reach the level
        low, high = 0, max(loads) + size * (many + 1) + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(taken(middle)) <= many else (low, middle)
        own = taken(low)
        for f in sorted(range(folds), key=lambda f: (loads[f] + own[f] * size, f))[: many - sum(own)]:  # noqa: B023
            own[f] += 1
        loads = [x + k * size for x, k in zip(loads, own)]
        out[size] = own
    return out


def balanced_folds(rows: DataFrame, key: str, folds: int, keep: Keep) -> DataFrame:
    """(key, size, fold): whole groups of equal key in folds of nearly equal rows: none is heavier than another by more than the largest group. Groups of
    one size are dealt to the folds in the order of their keys. Only the number of groups of each size meets in the driver. Null is a key like others."""
    sizes = keep(rows.groupBy(key).agg(F.count(F.lit(1)).alias("size")))
    classes = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("m")).collect()  # distinct sizes: under the root of twice all rows
    upto = []
    for size, own in quotas([(r["size"], r["m"]) for r in classes], folds).items():
        at = 0
        for f, k in enumerate(own):
            if k:
                upto.append((size, at, at + k, f))
                at += k
    table = rows.sparkSession.createDataFrame(upto, "_size long, _from long, _to long, fold int")
    n = numbered(sizes, ["size"], [key], keep)
    return n.join(F.broadcast(table), (F.col("size") == F.col("_size")) & (F.col("n") > F.col("_from")) & (F.col("n") <= F.col("_to"))).select(key, "size", "fold")
