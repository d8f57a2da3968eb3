"""Features in an S1's candidate list and across the S1 that claim a target; pruning, selection, assignment.

Every in-group order ends with the other key, so results don't depend on how rows are dealt. Windows over s1 share one
exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction as SF

from quillmark.operators.ranking import Keep, numbered


def by_s1() -> Window:
    return Window.partitionBy("s1")


WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def best_first(key: str, value: str, tie: str) -> Window:
    return Window.partitionBy(key).orderBy(F.desc_nulls_last(value), tie)


def group_features(pairs: DataFrame, value: str) -> DataFrame:
    """n_cands, and of the value: _grank (null if missing), _gap to the group's best, _margin to the best other one (-1 if none)."""
    line = best_first("s1", value, "t")
    out = pairs.withColumns({"n_cands": F.count(F.lit(1)).over(by_s1()), "_rn": F.row_number().over(line), "_best": F.max(value).over(by_s1()), "_second": F.nth_value(value, 2).over(line.rowsBetween(*WHOLE))})
    v = F.col(value)
    return out.select(
        *pairs.columns, "n_cands",
        F.when(v.isNotNull(), F.col("_rn")).alias(f"{value}_grank"), (F.col("_best") - v).alias(f"{value}_gap"),
        (v - F.when(F.col("_rn") == 1, F.coalesce("_second", F.lit(-1.0))).otherwise(F.col("_best"))).alias(f"{value}_margin"),
    )


def prune_keep(pairs: DataFrame, k: int = 14, k_min: int = 10, min_p: float = 0.001, always: int = 5, rank: str = "b4_rank") -> DataFrame:
    """The k best by p that reach min_p or stand among the k_min best; and those within `always` of one blocker."""
    r = pairs.withColumn("_r", F.row_number().over(best_first("s1", "p", "t")))
    return r.where(((F.col("_r") <= k) & ((F.col("p") >= min_p) | (F.col("_r") <= k_min))) | F.col(rank).between(1, always)).drop("_r")


def rerank_select(pairs: DataFrame, score_low: float, top: int, top_emb: int) -> DataFrame:
    """Pairs worth a second look: p >= score_low, or among the best by p, or among the best by emb."""
    r = pairs.withColumns({"_a": F.row_number().over(best_first("s1", "p", "t")), "_b": F.row_number().over(best_first("s1", "emb", "t"))})
    return r.where((F.col("p") >= score_low) | (F.col("_a") <= top) | (F.col("_b") <= top_emb)).drop("_a", "_b")


def list_features(pairs: DataFrame) -> DataFrame:
    """best_p, second_p, third_p (0 if absent), p_rank, p_rel_best, p_gap_best, sum_p, n_hi, sib1 and sib2 (the two best other targets)."""
    line = best_first("s1", "p", "t")
    top = {f"_p{i}": F.nth_value("p", i).over(line.rowsBetween(*WHOLE)) for i in (1, 2, 3)} | {f"_t{i}": F.nth_value("t", i).over(line.rowsBetween(*WHOLE)) for i in (1, 2, 3)}
    x = pairs.withColumns(top | {"p_rank": F.row_number().over(line), "sum_p": F.sum("p").over(by_s1()), "n_hi": F.sum((F.col("p") > 0.5).cast("int")).over(by_s1())})
    zero = F.lit(0.0)
    return x.select(
        *pairs.columns, F.coalesce("_p1", zero).alias("best_p"), F.coalesce("_p2", zero).alias("second_p"), F.coalesce("_p3", zero).alias("third_p"), "p_rank",
        F.round(F.col("p") / F.greatest("_p1", F.lit(1e-6)), 6).alias("p_rel_best"), F.round(F.col("_p1") - F.col("p"), 6).alias("p_gap_best"), F.round("sum_p", 6).alias("sum_p"), F.col("n_hi").cast("int").alias("n_hi"),
        F.when(F.col("p_rank") == 1, F.col("_t2")).otherwise(F.col("_t1")).alias("sib1"), F.when(F.col("p_rank") <= 2, F.col("_t3")).otherwise(F.col("_t2")).alias("sib2"),
    )


def two_best(scored: DataFrame, value: str) -> DataFrame:
    """(t, best, best_s1, second, n, n_hi): of the rows (s1, t, value) with a value, each target's two largest, ties to the smaller s1; how many S1, and how many
    over 0.5. One aggregation that keeps two rows a target from the map side on: however many S1 claim a target, each task sends two."""
    top = SF.collect_top_k(F.struct(F.col(value).alias("v"), (-F.col("s1")).alias("s")), 2, False)
    x = scored.where(F.col(value).isNotNull()).groupBy("t").agg(top.alias("_top"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) > 0.5).alias("n_hi"))
    return x.select("t", F.expr("_top[0].v").alias("best"), F.expr("-_top[0].s").alias("best_s1"), F.expr("get(_top, 1).v").alias("second"), "n", "n_hi")


def target_competition(scored: DataFrame) -> DataFrame:
    """(t, best, second, best_s1, n_s1) over all S1 that retrieved a target; second -1 if there is one S1 only. A missing score counts as -1."""
    x = two_best(scored.withColumn("score", F.coalesce("score", F.lit(-1.0))), "score")
    return x.select("t", "best", F.coalesce("second", F.lit(-1.0)).alias("second"), "best_s1", F.col("n").alias("n_s1"))


def _claims(pairs: DataFrame, value: str) -> DataFrame:
    """pairs with _c, their target's row of two_best (null without the value)."""
    best = two_best(pairs.select("s1", "t", value), value)
    return pairs.join(best.select("t", F.struct("best", "best_s1", "second", "n", "n_hi").alias("_c")), "t", "left")


def competition_p(pairs: DataFrame, value: str = "p", prefix: str = "tc") -> DataFrame:
    """For each pair, of the other S1 that claim its target: the best value (0 if none), how many, how many over 0.5; and whether this one is the best.
    Rows without the value take no part and get nulls."""
    v, mine = F.col(value), F.col("_c.best_s1") == F.col("s1")
    on = lambda c: F.when(v.isNotNull(), c)
    return _claims(pairs, value).select(
        *pairs.columns,
        on(F.when(mine, F.coalesce("_c.second", F.lit(0.0))).otherwise(F.col("_c.best"))).alias(f"{prefix}_other"),
        on(mine.cast("int")).alias(f"{prefix}_is_best"), on(F.col("_c.n") - 1).alias(f"{prefix}_n"), on(F.col("_c.n_hi") - (v > 0.5).cast("int")).alias(f"{prefix}_n_hi"),
    )


def assign_targets(pairs: DataFrame, margin: float) -> DataFrame:
    """p stays only for the S1 with a target's largest p, and only if it beats the next by the margin; else p is 0."""
    x, p = _claims(pairs, "p"), F.col("p")
    wins = (F.col("_c.best_s1") == F.col("s1")) & (p == F.col("_c.best")) & (F.round(p - F.coalesce("_c.second", F.lit(0.0)), 9) >= margin)
    return x.select(*(F.when(wins, p).otherwise(0.0).alias("p") if c == "p" else F.col(c) for c in pairs.columns))


def expected_f_select(pairs: DataFrame, miss: float) -> DataFrame:
    """(s1, k, f): how many of the best to emit for the largest expected F0.5, 0 if emitting none is as good."""
    line = best_first("s1", "p", "t")
    run = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = pairs.withColumns({"_k": F.row_number().over(line), "_c": F.sum("p").over(run), "_sum": F.sum("p").over(by_s1()), "_none": F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))).over(by_s1())})
    x = x.withColumns({"_f": F.round(1.25 * F.col("_c") / (F.col("_k") + 0.25 * (F.col("_sum") + miss)), 9), "_f0": F.round((1 - miss) * F.exp("_none"), 9)})
    best = x.groupBy("s1").agg(F.max(F.struct("_f", (-F.col("_k")).alias("k"))).alias("b"), F.max("_f0").alias("f0"))
    return best.select("s1", F.when(F.col("b._f") > F.col("f0"), -F.col("b.k")).otherwise(0).alias("k"), F.round(F.greatest("b._f", "f0"), 6).alias("f"))


def expected_f_pairs(pairs: DataFrame, miss: float) -> DataFrame:
    """The pairs that expected_f_select chooses."""
    x = pairs.withColumn("_k", F.row_number().over(best_first("s1", "p", "t"))).join(expected_f_select(pairs, miss).select("s1", F.col("k").alias("_most")), "s1")
    return x.where("_k <= _most").select(pairs.columns)


def pseudo_clean(pairs: DataFrame, emitted: str, hi: float, lo: float, lo_single: float) -> DataFrame:
    """S1 whose lists are clear enough to train on: n_emit, min_emit, max_rest, best."""
    e = F.col(emitted)
    g = pairs.groupBy("s1").agg(F.sum(e.cast("int")).alias("n_emit"), F.min(F.when(e, F.col("p"))).alias("min_emit"), F.max(F.when(~e, F.col("p"))).alias("max_rest"), F.max("p").alias("best"))
    clear = (F.col("n_emit") > 0) & (F.col("min_emit") >= hi) & (F.coalesce("max_rest", F.lit(0.0)) <= lo)
    return g.where(clear | ((F.col("n_emit") == 0) & (F.col("best") <= lo_single)))


def sample_negatives(pairs: DataFrame, per_positive: float, hard_share: float, order) -> DataFrame:
    """Per S1, max(positives, 1) * per_positive negatives: the hardest by p, the rest in the given pseudo-random order."""
    n_pos = F.sum("label").over(by_s1())
    x = pairs.withColumn("_quota", F.floor(F.greatest(n_pos, F.lit(1)) * per_positive)).where("label = 0").withColumn("_hard", F.ceil(F.col("_quota") * hard_share))
    x = x.withColumn("_r", F.row_number().over(best_first("s1", "p", "t")))
    x = x.withColumn("_easy", F.row_number().over(Window.partitionBy("s1", F.col("_r") <= F.col("_hard")).orderBy(order, "t")))
    return x.where((F.col("_r") <= F.col("_hard")) | (F.col("_easy") <= F.col("_quota") - F.col("_hard"))).drop("_quota", "_hard", "_r", "_easy")


def contested(selected: DataFrame, needed: DataFrame) -> DataFrame:
    """Selected pairs of other S1 whose target a needed S1 selected too."""
    wanted = selected.join(needed, "s1", "left_semi").select("t").distinct()
    return selected.join(needed, "s1", "left_anti").join(wanted, "t", "left_semi").select(selected.columns)


def stratified_cap(rows: DataFrame, by: str, cap: int, order: Column, tie: str, keep: Keep) -> DataFrame:
    """At most cap rows of each group, the first by order; a group's rows are numbered over as many tasks as they fill."""
    x = numbered(rows.withColumn("_o", order), [by], ["_o", tie], keep, "_r")
    return x.where(F.col("_r") <= cap).drop("_r", "_o")
