"""An extension: target competition kept up to date over a stream of scored pairs, one partial result for each micro-batch.

The best two S1 of a target can be merged in any order, so each batch needs only its own two best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.lists import best_first


def two_best(scored: DataFrame) -> DataFrame:
    return scored.withColumn("_r", F.row_number().over(best_first("t", "score", "s1"))).where("_r <= 2").drop("_r")


def start(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends each micro-batch's two best S1 of every target to `path`."""
    def write(batch: DataFrame, epoch: int) -> None:
        two_best(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
