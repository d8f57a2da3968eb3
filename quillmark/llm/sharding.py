"""Balanced contiguous shards by global byte-size prefix sums.

Rows are put in one global order by a range partitioning; each partition's total gives the sum before it, a running sum
inside the partition gives the sum before each row, and the line of bytes is cut at equal targets. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import materialize


def shard(rows: DataFrame, size_column: str, order: list[str], shards: int, partitions: int | None = None) -> DataFrame:
    """rows with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard).

    Shards are contiguous in the order of the columns `order`, nulls first; a row belongs to the shard in which the middle
    of its bytes falls, so shard sizes differ from the mean by less than the largest row. Rows that tie in all of `order`
    take adjoining places in any order. Sizes must not be null or negative. An empty table gives no rows. Other columns, whatever
    their names, are kept as they are; columns named shard or slot are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.col(f"own.`{size_column}`")
    by = [F.col(f"own.`{c}`").asc_nulls_first() for c in order]
    own = rows.select(F.struct("*").alias("own"))  # so that columns of any name stay apart from those made here
    placed = own.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id())
    placed = materialize(placed)  # the cuts between partitions are sampled: once and for all
    totals = placed.groupBy("part").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(line), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumns({"to": F.sum(size).over(inside), "nth": F.row_number().over(inside)})
    run = run.join(F.broadcast(starts), "part")  # a row for each partition
    cut = run.withColumn("middle", (F.col("bytes_before") + F.col("to")) * 2 - size).withColumn("shard", F.expr(f"CAST(least(CAST(middle AS DECIMAL(28,0)) * {shards} DIV greatest(2 * `all`, 1), {shards - 1}) AS INT)"))
    cut = cut.withColumn("at", F.col("rows_before") + F.col("nth") - 1)
    first = cut.groupBy("shard").agg(F.min("at").alias("first"))  # a row for each shard
    out = cut.join(F.broadcast(first), "shard").withColumn("slot", (F.col("at") - F.col("first")).cast("long"))
    return out.select("own.*", "shard", "slot")
