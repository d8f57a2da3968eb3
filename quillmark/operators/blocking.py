"""Candidate generation: top-k similarity joins, key blocks, and the pool."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillmark.functions.batches import PIECE, pieces
from quillmark.operators import tokens


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best t of each s1, rank from 1; ties to the smaller t."""
    line = Window.partitionBy("s1").orderBy(F.desc("score"), "t")
    return scored.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def grams(text: str, kind: str) -> list[str]:
    """Words, or character n-grams: char3 over the whole text, char_wb within blank-padded words (2 to 4)."""
    if kind == "char3":
        return [text[i : i + 3] for i in range(len(text) - 2)]
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    if kind == "word":
        return words
    # n-grams of n >= length of a padded word give the word once, for the first such n
    return [w[i : i + n] for w in (f" {w} " for w in words) for n in (2, 3, 4) for i in range(len(w) + 1 - n)]


def counted(records: DataFrame, text: str, kind: str) -> DataFrame:
    """(key, country, is_s1, gram, tf): arrays of the distinct grams of each record with any, and how often they occur. Rows of one key are one record."""
    rows = records.select("key", "country", "is_s1", F.array(text).alias("_t"))
    again = records.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    if not again.isEmpty():
        merged = rows.join(again, "key", "left_semi").groupBy("key", "country", "is_s1").agg(F.flatten(F.collect_list("_t")).alias("_t"))
        rows = rows.join(again, "key", "left_anti").unionByName(merged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b.columns, PIECE >> 2)):
            found = [Counter(g for t in texts for g in grams(t or "", kind)) for texts in part[3].to_pylist()]
            some = pa.array([bool(c) for c in found], pa.bool_())
            found = [c for c in found if c]
            columns = [*(part[i].filter(some) for i in range(3)), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "country", "is_s1", "gram", "tf"])

    kind_of = dict(rows.dtypes)
    return rows.mapInArrow(run, f"key {kind_of['key']}, country {kind_of['country']}, is_s1 {kind_of['is_s1']}, gram array<string>, tf array<int>")


def tfidf_topk(records: DataFrame, text: str, kind: str, max_df: float, top_m: int, k: int, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(s1, t, score, rank): within a country, each S1's k targets of the largest partial cosine.

    records: (key, country, is_s1, text), rows of one key in one country. Weights tf * (ln((1+n)/(1+df)) + 1), scaled to length 1 over all grams
    of a record; then only grams in at most max_df * n records count, and of an S1 the top_m rarest of them. Targets are dealt into blocks, each
    in one task, which all S1 of the country meet: only the best of a block leave it, as pairs with a gram in common are too many to be
    written. There grams are named by 64 bits. keep: writes a table that is read several times."""
    rows = keep(counted(records, text, kind))
    n = float(records.count())
    freq = keep(rows.select(F.explode("gram").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).select(F.lit("df").alias("name"), "token", "df"))
    w = tokens.looked_up(rows, freq, {"df": F.col("gram")})
    idf = lambda df: F.log((1 + F.lit(n)) / (1 + df)) + 1
    w = w.withColumn("_w", F.transform(F.arrays_zip("df", "gram", "tf"), lambda c: F.struct(c["df"].alias("df"), c["gram"].alias("gram"), (c["tf"] * idf(c["df"])).alias("w"))))
    w = w.withColumn("_l", F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    w = w.select("key", "country", "is_s1", "_l", F.filter("_w", lambda x: x["df"] <= n * max_df).alias("_w")).where("size(_w) > 0 and country is not null")
    best = F.when(F.col("is_s1"), F.slice(F.array_sort("_w"), 1, top_m)).otherwise(F.col("_w"))  # the rarest first, ties by the gram
    packed = w.withColumn("_w", best).select("country", F.when(F.col("is_s1"), 1).otherwise(0).alias("side"), "key", F.transform("_w", lambda x: F.xxhash64(x["gram"])).alias("h"), F.transform("_w", lambda x: x["w"] / F.col("_l")).alias("w"))
    return ranked(_best_of_blocks(keep(packed), k), k)


#: Grams of a block of targets, about: an index of some 84 MB, and up to three times that while it is made.
BLOCK_GRAMS = 1 << 22


def _best_of_blocks(packed: DataFrame, k: int, rows: tuple[int, int] = (1 << 14, 1 << 16), grams_: int = BLOCK_GRAMS) -> DataFrame:
    """(s1, t, score): each S1's k best targets of each block of its country, of (country, side, key, h, w): side 0 targets, 1 S1. A block has
    about rows[1] targets and grams_ grams at most, and fewer, down to rows[0], where there are more cores than blocks."""
    sizes = packed.where("side = 0").groupBy("country").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("h")).alias("_g"))
    every = sizes.agg(F.sum("_n")).first()[0] or 0
    most = min(max(every // (2 * packed.sparkSession.sparkContext.defaultParallelism), rows[0]), rows[1])
    blocks = sizes.select("country", F.greatest(F.ceil(F.col("_n") / most), F.ceil(F.col("_g") / grams_)).cast("long").alias("_b"))
    placed = packed.join(F.broadcast(blocks), "country")  # one row for each country
    own = F.array(F.expr("pmod(xxhash64(key), _b)"))
    dealt = placed.withColumn("block", F.explode(F.when(F.col("side") == 0, own).otherwise(F.expr("sequence(0L, _b - 1)"))))
    dealt = dealt.repartition("country", "block").sortWithinPartitions("country", "block", "side", "key").select("country", "block", "side", "key", "h", "w")
    kind = dict(packed.dtypes)["key"]

    def index(held: list[tuple]) -> tuple:
        keys, sizes, h, w = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)[order]
        return keys, h[order], owner, w[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, made = None, [], None
        for b in batches:
            country, block, side = (b.column(i).to_pylist() for i in range(3))
            keys = b.column(3).to_numpy()
            at = b.column(4).offsets.to_numpy()
            h, w = b.column(4).values.to_numpy(), b.column(5).values.to_numpy()
            cuts = [i for i in range(1, len(keys)) if (country[i], block[i], side[i]) != (country[i - 1], block[i - 1], side[i - 1])]
            for i, j in zip([0, *cuts], [*cuts, len(keys)]):
                if (country[i], block[i]) != now:
                    now, held, made = (country[i], block[i]), [], None
                if side[i] == 0:
                    held.append((keys[i:j].copy(), np.diff(at[i : j + 1]), h[at[i] : at[j]].copy(), w[at[i] : at[j]].copy()))
                    continue
                if not held and made is None:
                    continue
                made = made or index(held)
                held = []
                out = ([], [], [])
                for q in range(i, j):
                    t, score = _best_targets(h[at[q] : at[q + 1]], w[at[q] : at[q + 1]], *made, k)
                    out[0].append(np.full(len(t), keys[q]))
                    out[1].append(t)
                    out[2].append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["s1", "t", "score"])

    return dealt.mapInArrow(run, f"s1 {kind}, t {kind}, score double")


def _best_targets(h: np.ndarray, w: np.ndarray, keys: np.ndarray, grams_: np.ndarray, owner: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the sorted keys by the sum of products; ties to the smaller key."""
    starts, ends = np.searchsorted(grams_, h, "left"), np.searchsorted(grams_, h, "right")
    rows = np.concatenate([owner[a:b] for a, b in zip(starts, ends)])
    if not len(rows):
        return keys[:0], np.zeros(0)
    score = np.round(np.bincount(rows, np.concatenate([weights[a:b] * x for a, b, x in zip(starts, ends, w)])), 6)
    near = np.flatnonzero(score > 0)
    if len(near) > k:
        own = score[near]
        near = near[own >= np.partition(own, -k)[-k]]
        near = near[np.lexsort((near, -score[near]))[:k]]
    return keys[near], score[near]


#: Rows of the side that a task holds (at 256 dimensions 67 MB), and of the other side that meet them at once.
HELD_ROWS, TILE_ROWS = 32_768, 64


def _blocked_best(s1: DataFrame, t: DataFrame, k: int, by: str, rows: int = HELD_ROWS) -> DataFrame:
    """(s1, t, score): for each row of the side `by` ("s1" or "t") its k best partners of each block of the other side, by inner product
    within a group; s1 (s1, grp, v), t (t, grp, w). Groups are cut into blocks of about `rows` on either side; a block of one side meets
    each of the other in one task, and only the best leave it. A task holds one block of the partners; the other block passes by in tiles, each a
    product of matrices. So blocks are as large as memory lets them be: a row is copied once for each block of the other side."""
    own, other = ((s1, "s1", "v"), (t, "t", "w")) if by == "s1" else ((t, "t", "w"), (s1, "s1", "v"))
    left = own[0].select("grp", F.col(own[1]).alias("id"), F.col(own[2]).alias("x"))
    right = other[0].select("grp", F.col(other[1]).alias("id"), F.col(other[2]).alias("x"))
    number = lambda d, n: d.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / rows).cast("long").alias(n))
    sizes = number(left, "a").join(number(right, "b"), "grp")
    cell = lambda d, side, mine, copies, key: d.join(sizes, "grp").withColumn("_m", F.expr(f"pmod(xxhash64(id), {mine})")).withColumn("_c", F.explode(F.expr(f"sequence(0L, {copies} - 1)"))).select("grp", F.expr(key).alias("cell"), F.lit(side).alias("side"), "id", "x")
    both = cell(right, 0, "b", "a", "_c * b + _m").unionByName(cell(left, 1, "a", "b", "_m * b + _c"))
    dealt = both.repartition("grp", "cell").sortWithinPartitions("grp", "cell", "side").select("grp", "cell", "side", "id", "x")
    made = T.StructType([*(T.StructField(n, d.schema["id"].dataType) for n, d in (("own", left), ("other", right))), T.StructField("score", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in made]

    def best(names: np.ndarray, ys: np.ndarray, mine: list, xs: list) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        for i, line in zip(mine, np.round(np.stack(xs) @ ys.T, 6)):
            near = np.arange(len(line)) if len(line) <= k else np.flatnonzero(line >= np.partition(line, -k)[-k])
            near = near[np.lexsort((names[near], -line[near]))[:k]]
            for o, v in zip(out, ([i] * len(near), names[near].tolist(), line[near].tolist())):
                o += v
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, ys, held, mine, xs = None, [], [], None, [], []
        for b in batches:
            values, offsets = b.column(4).values.to_numpy(zero_copy_only=False).astype(float), b.column(4).offsets.to_numpy()
            found: tuple[list, list, list] = ([], [], [])

            def meet(found=found) -> None:
                nonlocal mine, xs
                if mine:
                    for o, v in zip(found, best(*held, mine, xs)):
                        o += v
                mine, xs = [], []

            for n, (g, c, side, i) in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)))):
                if (g, c) != now:
                    meet()
                    now, names, ys, held = (g, c), [], [], None
                v = values[offsets[n] : offsets[n + 1]]
                if side == 0:
                    names.append(i)
                    ys.append(v.copy())
                    continue
                if held is None:
                    if not names:
                        continue
                    held, ys = (np.array(names), np.stack(ys)), []
                mine.append(i)
                xs.append(v.copy())
                if len(mine) == TILE_ROWS:
                    meet()
            meet()
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, kinds)], names=made.names)

    found = dealt.mapInArrow(run, made)
    return found.selectExpr(*(("own AS s1", "other AS t") if by == "s1" else ("other AS s1", "own AS t")), "score")


def vector_topk(s1: DataFrame, t: DataFrame, k: int) -> DataFrame:
    """(s1, t, score, rank) by inner product within a group: s1 (s1, grp, v), t (t, grp, w), vectors of one length without nulls."""
    return ranked(_blocked_best(s1, t, k, "s1"), k)


def reverse_top2(s1: DataFrame, t: DataFrame) -> DataFrame:
    """(t, best, best_s1, second): each target's two best S1 of its group; best -1 and best_s1 null where it has none."""
    line = Window.partitionBy("t").orderBy(F.desc("score"), "s1")
    two = _blocked_best(s1, t, 2, "t").withColumn("_r", F.row_number().over(line)).where("_r <= 2").groupBy("t").agg(F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("_r") == 1, F.col("s1"))).alias("best_s1"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("second"))
    return t.select("t").join(two, "t", "left").select("t", F.coalesce("best", F.lit(-1.0)).alias("best"), "best_s1", F.coalesce("second", F.lit(-1.0)).alias("second"))


def block_keys() -> dict[str, Column]:
    """Keys of normalized records with r1 and r2; null if a part is missing."""
    c = F.col
    some = lambda x: F.when(c(x) != "", c(x))
    key = lambda *parts: F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("|", c("country"), *parts))
    two = F.when(c("r1").isNotNull() & c("r2").isNotNull(), F.concat_ws("|", F.least("r1", "r2"), F.greatest("r1", "r2")))
    return {"k_name": key(some("name_core")), "k_postal": key(some("postal"), c("r1")), "k_house": key(some("house_no"), some("street_word")), "k_rare2": key(two)}


def key_block_pairs(s1: DataFrame, t: DataFrame, cap: int) -> DataFrame:
    """(s1, t) with equal key; keys of more than cap targets are left out whole, null keys never match. key_block_left_out tells which,
    key_block_rest has their pairs."""
    fine = t.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= cap).select("key")
    return s1.where("key is not null").join(t.join(fine, "key", "left_semi"), "key").select("s1", "t")


def key_block_left_out(s1: DataFrame, t: DataFrame, cap: int) -> DataFrame:
    """(key, n_s1, n_t, n_pairs) of the keys that key_block_pairs leaves out: those of more than cap targets that some S1 has."""
    both = s1.select("key", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(t.select("key", F.lit(0).alias("a"), F.lit(1).alias("b"))).where("key is not null")
    n = both.groupBy("key").agg(F.sum("a").cast("long").alias("n_s1"), F.sum("b").cast("long").alias("n_t")).where((F.col("n_t") > cap) & (F.col("n_s1") > 0))
    return n.withColumn("n_pairs", F.col("n_s1") * F.col("n_t"))


#: Pairs that a task of key_block_rest makes, about, and the most tasks.
TASK_PAIRS, MOST_TASKS = 1 << 24, 1 << 14


def key_block_rest(s1: DataFrame, t: DataFrame, cap: int, side: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(s1, t) of the keys that key_block_pairs leaves out: with its pairs, those of the join without a cap. Both sides of a key are cut into runs of about
    `side` rows; a cell of two runs is joined by itself, so that a key is split over as many tasks as its pairs fill. A row is copied once for each run of
    the other side: side times fewer copies than pairs."""
    left = keep(key_block_left_out(s1, t, cap))
    tasks = min(1 + int(left.agg(F.sum("n_pairs")).first()[0] or 0) // TASK_PAIRS, MOST_TASKS)  # set, as else cells are put together by their bytes, which are few
    tasks = max(tasks, s1.sparkSession.sparkContext.defaultParallelism)
    hot = left.select("key", F.ceil(F.col("n_s1") / side).alias("_rows"), F.ceil(F.col("n_t") / side).alias("_cols"))
    dealt = lambda df, c, n: F.pmod(F.xxhash64(F.col(c)), F.col(n))
    a, b = s1.where("key is not null").join(hot, "key"), t.where("key is not null").join(hot, "key")
    a = a.withColumn("_i", dealt(a, "s1", "_rows")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)))
    b = b.withColumn("_j", dealt(b, "t", "_cols")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    cell = ["key", "_i", "_j"]
    return a.select(*cell, "s1").repartition(tasks, *cell).join(b.select(*cell, "t").repartition(tasks, *cell), cell).select("s1", "t")


def union_pool(blockers: dict[str, DataFrame], keyed: dict[str, DataFrame]) -> DataFrame:
    """One row for each distinct (s1, t): {b}_score (null if not retrieved), {b}_rank (0 if not), and the key flags. One shuffle."""
    def row(name: str, df: DataFrame, flag: bool) -> DataFrame:
        cols = [F.lit(None).cast("double").alias(f"{b}_score") if b != name else F.col("score").alias(f"{b}_score") for b in blockers]
        cols += [F.lit(0).alias(f"{b}_rank") if b != name else F.col("rank").alias(f"{b}_rank") for b in blockers]
        return df.select("s1", "t", *cols, *(F.lit(int(flag and k == name)).alias(k) for k in keyed))

    rows = [row(b, df, False) for b, df in blockers.items()] + [row(k, df, True) for k, df in keyed.items()]
    names = [c for c in rows[0].columns if c not in ("s1", "t")]
    return reduce(DataFrame.unionByName, rows).groupBy("s1", "t").agg(*(F.max(c).alias(c) for c in names))


def in_candidate_set(ranks: dict[str, int], flags: list[str]) -> Column:
    """Within the cut-off of any blocker, or under any of the used keys."""
    return reduce(lambda a, b: a | b, [F.col(f"{b}_rank").between(1, k) for b, k in ranks.items()] + [F.col(f) == 1 for f in flags])


def outer_ranks(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Ranks of two blockers side by side, 0 where absent, up to rank `most`."""
    x = a.where(F.col("rank") <= most).select("s1", "t", F.col("rank").alias("a_rank"))
    y = b.where(F.col("rank") <= most).select("s1", "t", F.col("rank").alias("b_rank"))
    return x.join(y, ["s1", "t"], "full").select("s1", "t", F.coalesce("a_rank", F.lit(0)).alias("a_rank"), F.coalesce("b_rank", F.lit(0)).alias("b_rank"))


def hard_negatives(ranks: DataFrame, truth: DataFrame) -> DataFrame:
    """Each S1's hardest non-match: least a_rank * 1000 + b_rank (absent: 999); ties to the smaller t; S1 without one are left out."""
    far = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(999)
    cost = ranks.join(truth, ["s1", "t"], "left_anti").withColumn("cost", far("a_rank") * 1000 + far("b_rank"))
    return cost.withColumn("_r", F.row_number().over(Window.partitionBy("s1").orderBy("cost", "t"))).where("_r = 1").select("s1", "t", "cost")


def coverage(cands: DataFrame, truth: DataFrame, s1: DataFrame, n_targets: int) -> DataFrame:
    """Recall of a candidate set over all S1: pair_recall, entity_recall, f05_ceiling, mean_cands, p99_cands, max_cands, no_cands_pct, reduction_ratio."""
    c = cands.groupBy("s1").agg(F.count(F.lit(1)).alias("n_c"))
    n = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    h = truth.join(cands, ["s1", "t"], "left_semi").groupBy("s1").agg(F.count(F.lit(1)).alias("n_hit"))
    per = s1.select("s1").join(c, "s1", "left").join(n, "s1", "left").join(h, "s1", "left").na.fill(0)
    r = F.col("n_hit") / F.col("n_true")
    per = per.withColumn("f", F.when(F.col("n_true") == 0, 1.0).when(F.col("n_hit") == 0, 0.0).otherwise(1.25 * r / (0.25 + r)))
    return per.agg(
        F.round(F.sum("n_hit") / F.greatest(F.sum("n_true"), F.lit(1)), 6).alias("pair_recall"),
        F.round(F.avg(F.when(F.col("n_true") > 0, (F.col("n_hit") == F.col("n_true")).cast("double"))), 6).alias("entity_recall"),
        F.round(F.avg("f"), 6).alias("f05_ceiling"), F.round(F.avg("n_c"), 6).alias("mean_cands"), F.round(F.percentile("n_c", F.lit(0.99)), 6).alias("p99_cands"),
        F.max("n_c").alias("max_cands"), F.round(100 * F.avg((F.col("n_c") == 0).cast("double")), 6).alias("no_cands_pct"),
        F.round(1 - F.sum("n_c") / (F.count(F.lit(1)) * float(n_targets)), 6).alias("reduction_ratio"),
    )
