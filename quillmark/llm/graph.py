"""Connected components of a link table.

Each task contracts its own edges to stars first, in blocks of bounded size. If the stars of all tasks together fit into one such
block, one more contraction joins them; else alternating star steps do, until the table is a forest of stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star algorithm on (a, b) edges, a > b. Neighbours' minima come from an aggregation that is
    written out, so that a hub's edges can be split over tasks in the join."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")))
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return materialize(out.where("a > b").distinct())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of these edges that aren't the least of their component: root is the least."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))  # roots hook onto lesser roots
        while (root[root] != root).any():
            root = root[root]
    low = root != np.arange(len(names))
    return names[low], names[root[low]]


def _contracted(edges: DataFrame, block: int) -> DataFrame:
    """Stars (a, b), a > b, of the edges of each task, over blocks of about `block` edges: the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nodes, roots = stars(*np.concatenate(held, axis=1))
            held.clear()
            for i in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(roots[i : i + (1 << 16)])], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            size += batch.num_rows
            if size >= block:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are a forest of stars: every node stands on one side only, and has one b where it is an a. One aggregation, combined in each task."""
    sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("b")))
    seen = sides.groupBy("a").agg(F.min("b").alias("_least"), F.max("b").alias("_most"), F.max(F.col("b").isNull()).alias("_root"))
    return seen.where("_least <> _most or (_least is not null and _root)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60, block: int = 1 << 20) -> DataFrame:
    """(node, root) for every node of (a, b) edges of longs: root is the least node of its component. Self-links and repeated edges count for
    nothing, edges with a null neither; an empty table gives no rows. `block`: most edges that a task contracts at once, and one batch more."""
    now = materialize(_contracted(edges.where("a <> b"), block))
    if now.count() <= block:  # a bounded table: one block, one task
        now = materialize(_contracted(now.coalesce(1), block))
    else:
        now = materialize(now.distinct())
        for _ in range(most_rounds):
            if _settled(now):
                break
            now = _star(_star(now, True), False)
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
