"""Exact top-k search by an impact-ordered index, score at a time.

Vectors become whole numbers. Candidates are dealt into blocks, and each block has one index, for all queries: the components of
every dimension, less the dimension's centre in the block, in sorted order, cut into posting segments of equal quantised impact
on both sides of 0. A query walks the segments of all dimensions by descending impact (the query's component times
the segment's bound) and adds what they hold, positive or negative, to the candidates' scores. What a candidate's postings that
weren't walked can add or take is bounded twice: by the impacts left, and by its norm that is left (Cauchy-Schwarz). The walk stops only
when these bounds prove that all members of the top k lie in a set that is cheaper to score exactly than the walk is to go on; that
set is then scored exactly. The best of each block meet again in a window by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import materialize

#: Sums of products below this are exact in a double.
EXACT = float(1 << 53)


class Index:
    """Posting segments of a matrix of whole numbers (candidates x dimensions), held as doubles."""

    def __init__(self, x: np.ndarray, levels: int = 16):
        n, dims = x.shape
        self.x, self.touched, self.rescored = x, 0, 0
        self.largest = float(np.abs(x).max(initial=0.0))
        self.centre = np.rint(x.mean(0)) if n and self.exact(self.largest) else np.zeros(dims)
        y = x - self.centre
        self.norm = np.einsum("ij,ij->i", y, y)
        order = np.argsort(y, axis=0, kind="stable").T
        values = np.take_along_axis(y.T, order, 1)
        step = float(np.abs(y).max(initial=0.0)) / levels or 1.0
        edges = np.append(np.arange(-levels, levels) * step, np.inf)  # the last segment ends at the largest
        start, end, dim, top = [], [], [], []
        for d in range(dims):
            cuts = np.searchsorted(values[d], edges)
            cuts[0] = 0
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
                a, b = int(cuts[k]), int(cuts[k + 1])
                bound = max(abs(values[d, a]), abs(values[d, b - 1]))
                if bound:
                    start.append(d * n + a), end.append(d * n + b), dim.append(d), top.append(bound)
        self.start, self.size = np.array(start, np.int64), np.array(end, np.int64) - np.array(start, np.int64)
        self.dim, self.top = np.array(dim, np.int64), np.array(top)
        self.of, self.value = order.reshape(-1), values.reshape(-1)

    def exact(self, largest: float) -> bool:
        """Whether products with components up to `largest` are exact in doubles."""
        return 4 * self.x.shape[1] * max(self.largest, largest) * max(self.largest, largest) < EXACT

    def search(self, q: np.ndarray, k: int, chunks: int = 12) -> np.ndarray:
        """Positions that hold all candidates among the k best of q, ties included."""
        n, dims = self.x.shape
        impact = np.abs(q)[self.dim] * self.top
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        if n <= k or not len(order):
            self.rescored += n
            return np.arange(n)
        walked = np.cumsum(self.size[order])
        chunk = -(-int(walked[-1]) // chunks)
        score, seen, length = np.zeros(n), np.zeros(n), float(np.sqrt(q @ q))
        at = 0
        while True:
            to = int(np.searchsorted(walked, (walked[at - 1] if at else 0) + chunk)) + 1
            part, at = order[at:to], min(to, len(order))
            size = self.size[part]
            take = np.repeat(self.start[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            of, value = self.of[take], self.value[take]
            score += np.bincount(of, value * np.repeat(q[self.dim[part]], size), n)
            seen += np.bincount(of, value * value, n)
            self.touched += len(take)
            left = np.zeros(dims)
            np.maximum.at(left, self.dim[order[at:]], impact[order[at:]])
            open_ = np.minimum(left.sum(), length * np.sqrt(np.maximum(self.norm - seen, 0))) * (1 + 1e-9)
            kth = np.partition(score - open_, n - k)[n - k]
            maybe = np.flatnonzero(score + open_ >= kth)
            if at >= len(order) or len(maybe) * dims <= 4 * chunk:
                self.rescored += len(maybe)
                return maybe

    def best(self, q: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best candidates with ids other than `own`, ties to the smaller id. Sums that doubles can't hold are
        made of whole numbers of any size, for all candidates."""
        if not self.exact(float(np.abs(q).max(initial=0.0))):
            at = np.flatnonzero(ids != own)
            weights = [int(c) for c in q]
            scores = [sum(int(c) * w for c, w in zip(self.x[i], weights)) for i in at]
            return [(int(ids[i]), s) for s, i in sorted(((s, i) for s, i in zip(scores, at)), key=lambda r: (-r[0], ids[r[1]]))[:k]]
        at = self.search(q, k + int((ids == own).sum()))
        at = at[ids[at] != own]
        s = self.x[at] @ q
        return [(int(ids[at[j]]), int(s[j])) for j in np.lexsort((ids[at], -s))[:k]]


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): vectors as arrays of floor(scale * x), x as double, kept as doubles; rows with a null id, a null vector, or a null or
    non-finite component are left out."""
    ok = F.expr("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    big = f"{scale} * cast(x as double)"  # past 2 ** 52 a double has no fraction, and floor would not fit a bigint
    return vectors.where(ok).select("vec_id", F.expr(f"transform(embedding, x -> CASE WHEN abs({big}) < 4503599627370496D THEN cast(floor({big}) as double) ELSE {big} END)").alias("v"))


def _rows(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _stack(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out


LONG = (1 << 63) - 1


def search(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, scale: int = 1024, block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product for each query, all if fewer.

    Queries are the rows that satisfy `queries`; candidates are all rows with another vec_id. Ties go to the smaller vec_id. Vectors that are
    null or hold a null or non-finite component take no part. Vectors of different lengths meet over the shorter length.
    Repeated rows: each is a candidate of its own; a query that occurs twice is answered once if the rows are equal, and different
    vectors of one vec_id are queries of their own, each with its ranks. Scores are exact and ranked as such, whatever their size; where
    one doesn't fit a long, the nearest long stands for it. Other columns are not read. An empty table gives no rows.

    Candidates are dealt evenly into blocks of about `block`; every block meets all queries, which are few, one batch of them at a time.
    """
    rows = materialize(whole(vectors, scale))
    blocks = max(1, -(-rows.count() // block))
    key = [F.xxhash64("v").alias("_a"), F.xxhash64(F.lit(1), "v").alias("_b")]
    asked = materialize(rows.where(queries).distinct().select("vec_id", *key, "v"))
    held = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("_c"), F.lit(0).alias("_kind"), "vec_id", F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"), "v")
    met = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_c"), F.lit(1).alias("_kind"), "vec_id", "_a", "_b", "v")
    dealt = held.unionByName(met).repartition("_c").sortWithinPartitions("_c", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vs, index, out = None, [], [], None, []
        for b in batches:
            for c, kind, i, one, two, v in zip(*(b.column(j).to_pylist() for j in range(5)), _rows(b.column(5))):
                if c != now:
                    now, ids, vs, index = c, [], [], None
                if kind == 0:
                    ids.append(i)
                    vs.append(v.copy())
                    continue
                if index is None:
                    if not vs:
                        continue
                    width = max(len(x) for x in vs)
                    index, ids, vs = Index(_stack(vs, width)), np.array(ids, np.int64), [*vs[:1]]
                q = _stack([v], index.x.shape[1])[0]
                out += [(i, one, two, j, max(-LONG - 1, min(LONG, s)), str(s)) for j, s in index.best(q, ids, i, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 5 + [pa.string()])], ["query_id", "a", "b", "vec_id", "score", "exact"])
                out = []

    found = dealt.mapInArrow(run, "query_id long, a long, b long, vec_id long, score long, exact string")
    sign = F.col("exact").startswith("-")  # whole numbers of any size, as text: by sign, length, digits
    size = F.when(sign, -F.length("exact")).otherwise(F.length("exact"))
    line = Window.partitionBy("query_id", "a", "b").orderBy(F.desc("score"), size.desc(), F.when(~sign, F.col("exact")).desc(), F.when(sign, F.col("exact")).asc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
