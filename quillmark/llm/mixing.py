"""Mixing sources to target weights, by hierarchical budgeting.

Leaves are the paths domain / language / source that occur. A budget of tokens flows down the tree: at each node it is
shared among the children in proportion to their weights, no child gets more than its capacity (the tokens below it, times
the epochs allowed), and what a child can't use goes to its siblings first; only what a whole node can't use reaches the
node's own siblings. Each leaf then takes a prefix of its documents in a seeded order: whole epochs, and of the last epoch
as much as the budget needs.

DataFrame operations only: windows over the table of leaves, and over documents in hash buckets that split hot leaves.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import materialize

LEVELS = ["domain", "language", "origin"]


def weight_of(column: str, weights: Mapping[str, int], other: int) -> Column:
    """The weight of a node by its name: a whole number over 0; `other` for names not listed and for null."""
    out = F.lit(float(other))
    for name in sorted(weights, reverse=True):
        out = F.when(F.col(column) == name, F.lit(float(weights[name]))).otherwise(out)
    return out


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide each parent's `budget` among its rows of `nodes` (weight, capacity): columns `budget` becomes the row's own.

    Sorted by capacity / weight, the first children take all they hold; from the first that doesn't fill up on, each gets
    its weight's part of what is left."""
    ratio = F.col("capacity") / F.col("weight")
    line = Window.partitionBy(*parent).orderBy(ratio.asc(), F.col(name).asc_nulls_first())
    before = F.coalesce(F.sum("capacity").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    step = nodes.withColumns({"_left": F.col("budget") - before, "_rest": rest}).withColumn("_level", F.col("_left") / F.col("_rest"))
    step = step.withColumn("_fills", F.col("capacity") <= F.col("_level") * F.col("weight"))
    level = F.first(F.when(~F.col("_fills"), F.col("_level")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return step.withColumn("_common", level).withColumn("budget", F.when(F.col("_fills"), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.greatest(F.lit(0.0), F.col("_common") * F.col("weight"))))).drop("_left", "_rest", "_level", "_fills", "_common")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], fraction: float, epochs: int, other: int = 1) -> DataFrame:
    """(domain, language, origin, tokens, budget) from (domain, language, origin, tokens): the tokens wanted are `fraction` of
    all. Budgets are whole tokens, rounded down."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * float(epochs))
    top = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("_tokens")).withColumn("_root", F.lit(0))
    every = Window.partitionBy("_root")  # a row for each domain
    top = top.withColumn("budget", F.least(F.floor(F.sum("_tokens").over(every) * F.lit(fraction)).cast("double"), F.sum("capacity").over(every))).drop("_tokens")
    top = share(top.withColumn("weight", weight_of("domain", weights.get("domain", {}), other)), ["_root"], "domain")
    mid = leaves.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"))
    mid = mid.join(top.select(F.col("domain").alias("_d"), "budget"), F.col("domain").eqNullSafe(F.col("_d"))).drop("_d")
    mid = share(mid.withColumn("weight", weight_of("language", weights.get("language", {}), other)), ["domain"], "language")
    low = leaves.join(mid.select(F.col("domain").alias("_d"), F.col("language").alias("_l"), "budget"), F.col("domain").eqNullSafe(F.col("_d")) & F.col("language").eqNullSafe(F.col("_l"))).drop("_d", "_l")
    low = share(low.withColumn("weight", weight_of("origin", weights.get("origin", {}), other)), ["domain", "language"], "origin")
    return low.select(*LEVELS, "tokens", F.floor(F.col("budget") + F.lit(1e-6)).cast("long").alias("budget"))


def draw(key: Column, seed: int, epoch: Column) -> Column:
    """A 32-bit place in the order of an epoch, fixed by seed, epoch and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def row_key() -> list[Column]:
    """Two hashes that name a row's content."""
    own = ["doc_id", "text", "lang", "source"]
    return [F.xxhash64(*own).alias("_row"), F.xxhash64(F.lit(1), *own).alias("_twin")]


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], domain: Column, tokens: Column, fraction: float = 0.5, epochs: int = 2, seed: int = 13, bucket_bits: int = 12, other: int = 1) -> DataFrame:
    """For each document that is taken: doc_id, _row and _twin (hashes of the row), domain, language, origin, tokens, copies (how many
    times), leaf_budget. The tokens wanted are `fraction` of all tokens.

    A leaf's documents stand in an order drawn anew for each epoch; each is taken while the tokens before it in the epoch
    are fewer than what the budget leaves for that epoch, so a leaf passes its budget by less than one document. A document of
    no tokens is taken by the same rule. Null lang or source is a leaf of its own, with the weight `other`. Rows equal in
    doc_id, text, lang and source are one item of as many tokens as they have together. Null texts must have 0 tokens. An
    empty table gives no rows; other columns are not returned.
    """
    base = docs.select("doc_id", *row_key(), domain.alias("domain"), F.col("lang").alias("language"), F.col("source").alias("origin"), tokens.cast("long").alias("tokens"))
    base = base.groupBy("doc_id", "_row", "_twin", *LEVELS).agg(F.sum("tokens").alias("tokens"))
    base = materialize(base)  # small rows: the texts are read once
    leaves = base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = materialize(budgets(leaves, weights, fraction, epochs, other))  # a row for each leaf
    plan = plan.withColumns({"_full": F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")}).withColumn("_part", F.col("budget") - F.col("_full") * F.col("tokens"))
    named = plan.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), F.col("budget").alias("leaf_budget"), "_full", "_part")
    same = F.lit(True)
    for c in LEVELS:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = base.join(named, same).drop(*(f"_{c}" for c in LEVELS))
    rows = rows.withColumn("_draw", draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed, F.col("_full"))).withColumn("_bucket", F.shiftright("_draw", 32 - bucket_bits))
    rows = materialize(rows)
    buckets = rows.where("_part > 0").groupBy(*LEVELS, "_bucket").agg(F.sum("tokens").alias("_in"), F.min("_part").alias("_part"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("_before", before).where("_before < _part").withColumn("_whole", F.col("_before") + F.col("_in") <= F.col("_part"))
    named = buckets.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), F.col("_bucket").alias("_b"), "_before", "_whole")
    hit = rows.join(named, same & (F.col("_bucket") == F.col("_b")) & (F.col("_part") > 0), "left").drop(*(f"_{c}" for c in LEVELS), "_b")
    certain = hit.where("_before is null or _whole").withColumn("_more", F.when(F.col("_before").isNull(), 0).otherwise(1))
    edge = hit.where("_before is not null and not _whole")  # one bucket of a leaf
    inside = Window.partitionBy(*LEVELS).orderBy("_draw", F.col("doc_id").asc_nulls_first(), "_row", "_twin").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_more", F.when(F.col("_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)) < F.col("_part"), 1).otherwise(0))
    out = certain.unionByName(edge).withColumn("copies", F.col("_full") + F.col("_more")).where("copies > 0")
    return out.select("doc_id", "_row", "_twin", *LEVELS, "tokens", "copies", "leaf_budget")
