"""Shared helpers: the shared folder, materialised tables, and deterministic row samples."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one serves if all run in one
    process on one machine (tests); on a cluster that is an error, as executors can't see each other's disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quillmark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quillmark/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Seconds between two collections of the driver's garbage.
TIDY_S = 10.0
_tidied = 0.0


def tidy(spark: SparkSession) -> bool:
    """Whether the garbage of the driver's Python and JVM was collected, which is done at most once in TIDY_S. A query of many small steps leaves plans,
    statuses and broadcasts behind, for which the JVM's heap else grows and stays large, and shuffle files stay on the executors until the driver happens
    to collect what refers to them. Without a JVM at hand (Spark Connect) nothing is done."""
    global _tidied
    jvm = getattr(spark, "_jvm", None)
    if jvm is None or time.monotonic() - _tidied < TIDY_S:
        return False
    gc.collect()
    jvm.java.lang.System.gc()
    _tidied = time.monotonic()
    return True


def tidy_executors(spark: SparkSession) -> int:
    """Collect the garbage of the executors' JVMs, for a step whose workers need the memory beside them: a heap that earlier steps have grown stays large
    else. As many tasks as there are cores, so that idle executors all have some; how many ended is returned."""
    n = max(1, spark.sparkContext.defaultParallelism)
    return len(spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect())


def release() -> None:
    """Hand memory that is free back to the system, where it keeps it: a worker lives for many tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def releasing(run: Run) -> Run:
    """A function for mapInArrow that hands free memory back at the end of each task: else idle workers hold what their last task took, beside the JVM."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(column: str, n: int):
    """crc32 of a column's decimal text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def uniform(column: str, seed: int):
    """A value in [0, 1) fixed by the column's value and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(column)), 11) / F.lit(float(1 << 53))


def sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` rows of (doc_id, ...), with distinct doc_ids, those first by a hash of doc_id. A bar for the hash goes first, so that tasks
    send about 1.5 * most rows together to the one that takes the first of them."""
    n = rows.count()
    bar = F.lit(1.5 * most / n if n > most + 1000 else 1.0)
    return rows.where(uniform("doc_id", seed) < bar).orderBy(uniform("doc_id", seed), "doc_id").limit(most)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: Least and most bits of a bitmap that keeps most rows without partners out of a shuffle; a join follows, so it only saves work.
FILTER_BITS = (1 << 22, 1 << 26)


def maybe_among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of which the long column `key` may be among those of ids (a table that can be read twice): all that are, and few others while
    ids are fewer than FILTER_BITS[1]; beyond that, more others. Keys are hashes. The bitmap has 32 bits for each id, and
    at most FILTER_BITS[1] / 8 bytes are broadcast."""
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (32 * ids.count()).bit_length()))
    at = F.pmod(key, F.lit(size)) + 1
    bits = ids.select(at.alias("_p")).groupBy(F.expr("bitmap_bucket_number(_p)").alias("_b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_p))").alias("_bits"))
    own = rows.withColumn("_p", at).withColumns({"_b": F.expr("bitmap_bucket_number(_p)"), "_at": F.expr("bitmap_bit_position(_p)")})
    byte = F.expr("CAST(conv(hex(substring(_bits, CAST(_at div 8 AS INT) + 1, 1)), 16, 10) AS BIGINT)")
    hit = own.join(F.broadcast(bits), "_b")
    return hit.where(byte.bitwiseAND(F.expr("CAST(pow(2, _at % 8) AS BIGINT)")) != 0).drop("_p", "_b", "_at", "_bits")
