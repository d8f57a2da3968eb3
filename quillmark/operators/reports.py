"""Recall reports, stress slices, examples, diagnostics of unseen countries, latest runs, choice of a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.blocking import in_candidate_set


def recall(cands: DataFrame, truth: DataFrame, s1: DataFrame, *by: str) -> DataFrame:
    """Pair and entity recall, ceiling of F0.5 and mean candidates, of candidates (s1, t, *by) and all S1 (s1, country); by country too, if named. All
    variants are counted in one aggregation over the pairs."""
    variants = [c for c in by if c != "country"]
    each = cands.select(*variants).distinct() if variants else None  # a row for each variant
    y = truth.select("s1", "t", F.lit(1).alias("y"))
    hit = cands.join(y, ["s1", "t"], "left").groupBy("s1", *variants).agg(F.count(F.lit(1)).alias("n_c"), F.count("y").alias("n_hit"))
    per = s1.join(truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true")), "s1", "left")
    per = (per.crossJoin(F.broadcast(each)) if each is not None else per).join(hit, ["s1", *variants], "left").na.fill(0, ["n_true", "n_c", "n_hit"])
    r = F.col("n_hit") / F.col("n_true")
    per = per.withColumn("f", F.when(F.col("n_true") == 0, 1.0).when(F.col("n_hit") == 0, 0.0).otherwise(1.25 * r / (0.25 + r)))
    return per.groupBy(*by).agg(
        F.round(F.sum("n_hit") / F.greatest(F.sum("n_true"), F.lit(1)), 6).alias("pair_recall"), F.round(F.avg(F.when(F.col("n_true") > 0, (F.col("n_hit") == F.col("n_true")).cast("double"))), 6).alias("entity_recall"),
        F.round(F.avg("f"), 6).alias("f05_ceiling"), F.round(F.avg("n_c"), 6).alias("mean_cands"), F.max("n_c").alias("max_cands"),
    )


def variants_of(pool: DataFrame, ks: list[int], blockers: list[str], keys: list[str]) -> DataFrame:
    """(s1, t, variant): the pool's pairs once for each candidate set that holds them: union@k, {blocker}@k, {key}."""
    sets = {f"union@{k}": in_candidate_set({b: k for b in blockers}, keys) for k in ks} | {f"{b}@{k}": F.col(f"{b}_rank").between(1, k) for b in blockers for k in ks} | {k: F.col(k) > 0 for k in keys}
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in sets.items())), lambda n: n.isNotNull())
    return pool.select("s1", "t", F.explode(names).alias("variant"))


def slices(s1: DataFrame, truth: DataFrame, alike: DataFrame) -> DataFrame:
    """(key, slice): membership of S1 in the eight stress slices. s1: normalized records of S1 with the raw business_name; truth: (s1, t); alike: (s1, jw) for
    true pairs."""
    words = F.size(F.filter(F.split("address_norm", " "), lambda t: t != ""))
    x = s1.join(truth.groupBy(F.col("s1").alias("key")).agg(F.count(F.lit(1)).alias("n_true")), "key", "left").na.fill(0, ["n_true"])
    x = x.join(s1.groupBy("name_core").agg(F.count(F.lit(1)).alias("_same")), "name_core", "left").join(alike.groupBy(F.col("s1").alias("key")).agg(F.min("jw").alias("_jw")), "key", "left")
    member = {
        "singleton": F.col("n_true") == 0, "multi_match": F.col("n_true") >= 3, "short_or_empty_address": words <= 3, "landmark_only_address": (F.col("address_core") == "") & (F.col("landmark") != ""),
        "chain_name": F.col("_same") >= 5, "name_has_digits": F.col("business_name").rlike("[0-9]"), "short_name": F.length("name_core") <= 6, "hard_transliteration": F.col("_jw") < 0.85,
    }
    return x.select("key", F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in member.items())), lambda n: n.isNotNull())).alias("slice"))


def examples(emitted: DataFrame, truth: DataFrame, n: int, order: Column) -> DataFrame:
    """(s1, t, status): the TP, FP and missed targets of n S1 with any FP or missed one, the first in the given order. n is the report's size."""
    tag = lambda d, a, b: d.select("s1", "t", F.lit(a).alias("e"), F.lit(b).alias("y"))
    both = tag(emitted, 1, 0).unionByName(tag(truth, 0, 1)).groupBy("s1", "t").agg(F.max("e").alias("e"), F.max("y").alias("y"))
    both = both.withColumn("status", F.when(F.col("e") * F.col("y") == 1, "TP").when(F.col("e") == 1, "FP").otherwise("missed"))
    bad = both.where("status <> 'TP'").select("s1").distinct().orderBy(order, "s1").limit(n)
    return both.join(F.broadcast(bad), "s1").select("s1", "t", "status")  # n rows


def emptied(lists: DataFrame, country: DataFrame, seen: DataFrame) -> DataFrame:
    """Output lists (s1, ids) with those of countries that training lacks made empty; seen: (country)."""
    known = seen.select("country").distinct().withColumn("_seen", F.lit(True))
    x = lists.join(country.select("s1", "country"), "s1", "left").join(known, "country", "left")
    return x.select("s1", F.when(F.col("_seen"), F.col("ids")).otherwise("").alias("ids"), F.col("_seen").isNull().alias("unseen"))


def unseen_score(full: float, diagnostic: float, share: float, singletons: float) -> tuple[float, float]:
    """F of unseen and of seen countries, from the scores of the whole output and of the one with their lists emptied, where only singletons score."""
    return (full - diagnostic) / share + singletons, (diagnostic - share * singletons) / (1 - share)


def latest(runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    line = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return runs.withColumn("_r", F.row_number().over(line)).where("_r = 1").drop("_r")


def better_everywhere(base: DataFrame, tuned: DataFrame, by: str = "country", value: str = "recall") -> DataFrame:
    """(keep): whether the tuned model gains in every country."""
    x = base.select(by, F.col(value).alias("_a")).join(tuned.select(by, F.col(value).alias("_b")), by)
    return x.agg(F.coalesce(F.bool_and(F.col("_b") > F.col("_a")), F.lit(False)).alias("keep"))


def coded(frames: dict[str, DataFrame], column: str) -> DataFrame:
    """(value, code): codes from 0, shared by all frames, in the order of the values."""
    every = reduce(DataFrame.unionByName, [f.select(column) for f in frames.values()]).distinct()
    return every.select(F.col(column).alias("value"), (F.dense_rank().over(Window.orderBy(column)) - 1).alias("code"))  # a row for each value of an open but small set
