"""Importance resampling toward a target corpus, by inverted postings that are dealt by hashed feature bucket.

Each feature (a run of words) falls into a bucket by its CRC-32. Both corpora become postings (bucket, document, count), and the postings of
the documents are shuffled by bucket to where the bucket's counts in both corpora come together; there its gain is computed, and each
posting becomes a contribution (document, gain * count). Contributions are summed by document; a draw of one exponential race (Gumbel)
per document makes the weights a sample without replacement.

Postings travel in packed arrays: a row holds one part of the buckets and one run of documents. A part's rows are dealt over slices, each
of which gets the part's counts, so that a bucket that all documents share is no one task's.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import words
from quillmark.llm.common import materialize, releasing


@dataclass(frozen=True)
class Shape:
    """Buckets; the words of the longest feature; the parts that buckets are dealt into; runs of documents that meet in a slice of a part."""

    buckets: int = 10_000
    longest: int = 1
    parts: int = 16
    runs: int = 32


def crc(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each stretch of bytes, carried on from `state` (that of the bytes before)."""
    table = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32) if state is None else state ^ np.uint32(0xFFFFFFFF)
    size, at, live = ends - starts, 0, np.arange(len(starts))
    while len(live := live[size[live] > at]):
        old = out[live]
        out[live] = table[(old ^ flat[starts[live] + at]) & 0xFF] ^ (old >> np.uint32(8))
        at += 1
    return out ^ np.uint32(0xFFFFFFFF)


def features(flat: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature, and the number of words of each row."""
    flat = words.LOWER[flat]
    starts, ends, bounds = words.split(flat, offsets, words.NO_LETTER)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    rows, buckets, state = [], [], None
    begin = np.arange(len(starts))
    for k in range(shape.longest):
        if k:  # the runs that have one word more in their row, after a space
            on = begin + k < bounds[1:][row[begin]]
            begin, state = begin[on], state[on]
            zero = np.zeros(len(begin), np.int64)
            state = crc(np.array([0x20], np.uint8), zero, zero + 1, state)
        state = crc(flat, starts[begin + k], ends[begin + k], state)
        rows.append(row[begin])
        buckets.append(state % np.uint32(shape.buckets))
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64), np.diff(bounds)


_POSTINGS = "run long, part int, at binary, bucket binary, count binary, row int, n_features long, n_words long"


def postings(docs: DataFrame, keep: list[str], shape: Shape) -> DataFrame:
    """A table of two kinds of rows. With part: a run of documents' postings in that part of the buckets, sorted (at, bucket, count: arrays of 32
    bits). Without: a document of a run, its `row` there, its numbers of features and words, and own, a struct of the columns to keep."""
    own = docs.select(*(F.col(f"`{c}`") for c in keep)).schema
    schema = T.StructType([*T._parse_datatype_string(_POSTINGS).fields, T.StructField("own", own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, flat, offsets in words.blocks(batch.column("text")):
                row, bucket, n_words = features(flat, offsets, shape)
                n = j - i
                key = (bucket % shape.parts * n + row) * shape.buckets + bucket
                key, count = np.unique(key, return_counts=True)
                part, at, bucket = key // (n * shape.buckets), key // shape.buckets % n, key % shape.buckets
                cuts = np.searchsorted(part, np.arange(shape.parts + 1))
                full = np.flatnonzero(np.diff(cuts))
                packed = [pa.array([x[cuts[k] : cuts[k + 1]].astype("<u4").tobytes() for k in full], pa.binary()) for x in (at, bucket, count)]
                none = lambda m, t: pa.nulls(m, t)
                own_rows = batch.column("own").slice(i, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number), pa.int64()), none(n, pa.int32()), *(none(n, pa.binary()) for _ in range(3)), pa.array(np.arange(n), pa.int32()), pa.array(np.bincount(row, minlength=n), pa.int64()), pa.array(n_words, pa.int64()), own_rows],
                    names=schema.names,
                )
                if len(full):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(full), number), pa.int64()), pa.array(full, pa.int32()), *packed, none(len(full), pa.int32()), *(none(len(full), pa.int64()) for _ in range(2)), none(len(full), own_rows.type)],
                        names=schema.names,
                    )
                number += 1

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("own"), "text")
    return materialize(rows.mapInArrow(releasing(run), schema))  # written, as a run's number is that of a task's attempt


def _uint(x) -> np.ndarray:
    return np.frombuffer(x, "<u4").astype(np.int64)


def counts(lists: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name): how often each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b, c in zip(batch.column("bucket"), batch.column("count")):
                total += np.bincount(_uint(b.as_py()), _uint(c.as_py()), buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    each = lists.where("part is not null").select("bucket", "count").mapInArrow(run, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias(name))


def contributions(lists: DataFrame, target: DataFrame, shape: Shape) -> DataFrame:
    """(run, row, value): what each part of the buckets adds to the weight of a document. Documents whose postings all have a gain of 0 may be absent."""
    own = lists.where("part is not null")
    total = counts(lists, shape.buckets, "s").join(counts(target, shape.buckets, "t"), "bucket", "full").na.fill(0)
    total = materialize(total)  # at most a row for each bucket
    sizes = total.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))  # one row
    runs = own.where("part = 0").count()
    slices = max(1, -(-runs // shape.runs))
    both = total.groupBy((F.col("bucket") % shape.parts).cast("int").alias("part")).agg(F.collect_list(F.struct("bucket", "s", "t")).alias("held"))  # buckets / parts
    both = both.join(F.broadcast(sizes)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("slice", F.col("slice").cast("long"))
    met = own.withColumn("slice", F.pmod(F.xxhash64("run"), F.lit(slices))).join(both.hint("shuffle_hash"), ["part", "slice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for k, part in enumerate(batch.column("part").to_pylist()):
                if part not in known:  # the gains of the part's buckets
                    gain = known[part] = np.zeros(shape.buckets)
                    all_s, all_t = (float(batch.column(c)[k].as_py() + shape.buckets) for c in ("all_s", "all_t"))
                    for x in batch.column("held")[k].as_py():
                        gain[x["bucket"]] = math.floor(1000 * math.log((x["t"] + 1) * all_s / ((x["s"] + 1) * all_t)))
                at, value = _uint(batch.column("at")[k].as_py()), known[part][_uint(batch.column("bucket")[k].as_py())] * _uint(batch.column("count")[k].as_py())
                held = np.bincount(at, value)
                some = np.flatnonzero(held)
                for o, x in zip(out, (np.full(len(some), batch.column("run")[k].as_py()), some, held[some].astype(np.int64))):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64()))], names=["run", "row", "value"])

    return met.select("run", "part", "at", "bucket", "count", "held", "all_s", "all_t").mapInArrow(run, "run long, row int, value long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, keep: list[str] | None = None, shape: Shape = Shape()) -> DataFrame:
    """The columns `keep` of docs (all but text if not given) and n_features, weight, score, rank: for all documents.

    A document's weight is the sum of the gains of its features, repeats counted; its score adds the draw of its doc_id. Of the N documents with
    `least_words` words or more those with the floor(percent * N / 100) highest scores are drawn, ties to the smaller doc_id; rank numbers them from 1, and
    is null for all others. Null and empty texts have no features and weight 0. A null doc_id is drawn as an empty one and comes last among ties; repeated rows
    count each, and rows that tie in all take adjoining ranks in any order. Of empty documents there are no rows; an empty target has no counts. Columns
    of docs named like the new ones are replaced.
    """
    new = ["n_features", "weight", "score", "rank"]
    keep = [c for c in (keep if keep is not None else [c for c in docs.columns if c.lower() != "text"]) if c.lower() not in new]
    lists = postings(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", "text", *keep]))), list(dict.fromkeys(["doc_id", *keep])), shape)
    weights = contributions(lists, postings(target.select("text", F.lit(0).alias("none")), ["none"], shape), shape).groupBy("run", "row").agg(F.sum("value").alias("weight"))
    rows = lists.where("part is null").select("run", "row", "own", "n_features", "n_words").join(weights, ["run", "row"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    h = F.expr(f"CAST(conv(substring(sha2(concat('{seed}:', coalesce(CAST(own.doc_id AS STRING), '')), 256), 1, 8), 16, 10) AS BIGINT)")
    rows = rows.withColumn("score", (F.col("weight") + F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))).cast("long"))
    rows = rows.withColumn("able", F.col("n_words") >= least_words)
    ranked = _ranked(rows, percent)
    return ranked.select(*(F.col(f"own.`{c}`") for c in keep), *new)


def _ranked(rows: DataFrame, percent: int) -> DataFrame:
    """rows with rank: one order over all partitions by ranges, each partition's count, and a running number inside."""
    order = [F.col("able").desc(), F.col("score").desc(), F.col("own.doc_id").asc_nulls_last(), F.col("run"), F.col("row")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))  # the cuts are sampled: once and for all
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = placed.groupBy("_part").agg(F.count_if("able").alias("n"))
    starts = sums.select("_part", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("_before"), F.expr(f"sum(n) over () * {percent} div 100").alias("_drawn"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rank = placed.join(F.broadcast(starts), "_part").withColumn("rank", nth.cast("long"))
    return rank.withColumn("rank", F.when(F.col("able") & (F.col("rank") <= F.col("_drawn")), F.col("rank")))
