"""Data checks: field statistics, truth statistics, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import has_indic


def field_stats(records: DataFrame) -> DataFrame:
    """Per country: records, % with empty name and address, % in an Indic script, repeated ids."""
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    return records.groupBy("country").agg(F.count(F.lit(1)).alias("n"), pct(F.col("business_name") == "").alias("pct_empty_name"), pct(F.col("business_address") == "").alias("pct_empty_address"), pct(has_indic(F.col("business_name"))).alias("pct_indic"), (F.count(F.lit(1)) - F.countDistinct("entity_id")).alias("n_dup_ids"))


def match_histogram(n_matches: DataFrame) -> DataFrame:
    """S1 by number of matches: 0 to 10, and 11 for more."""
    return n_matches.groupBy(F.least("n", F.lit(11)).alias("matches")).agg(F.count(F.lit(1)).alias("n_s1"))


def truth_stats(n_matches: DataFrame, *by: str) -> DataFrame:
    """Of (s1, n, n2, n3): share without a match, mean, median, p90, p99, max; S1 with S2 only, S3 only, both."""
    q = lambda x: F.round(F.percentile("n", F.lit(x)), 6)
    some = lambda c: F.sum(c.cast("int"))
    a, b = F.col("n2") > 0, F.col("n3") > 0
    return n_matches.groupBy(*by).agg(F.count(F.lit(1)).alias("n_s1"), F.round(100 * F.avg((F.col("n") == 0).cast("double")), 6).alias("singleton_pct"), F.round(F.avg("n"), 6).alias("mean"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("n").alias("max"), some(a & ~b).alias("s2_only"), some(~a & b).alias("s3_only"), some(a & b).alias("both"))


def exclusivity(truth: DataFrame) -> DataFrame:
    """Targets in more than one list, with the number of lists."""
    return truth.groupBy("t").agg(F.countDistinct("s1").alias("n_lists")).where("n_lists > 1")


def cross_country(truth: DataFrame, country: DataFrame, n: int = 10) -> DataFrame:
    """Pairs whose countries differ, by (a, b): the n most frequent."""
    a = country.select(F.col("key").alias("s1"), F.col("country").alias("a"))
    b = country.select(F.col("key").alias("t"), F.col("country").alias("b"))
    return truth.join(a, "s1").join(b, "t").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a", "b").limit(n)


def unlabeled(targets: DataFrame, truth: DataFrame) -> DataFrame:
    """Per source and country, the share of targets without a truth."""
    x = targets.join(truth.select(F.col("t").alias("key"), F.lit(1).alias("y")).distinct(), "key", "left")
    return x.groupBy("src", "country").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(F.col("y").isNull().cast("double")), 6).alias("pct_unlabeled"))


def integrity(records: DataFrame, lists: DataFrame) -> DataFrame:
    """(counter, n): repeated ids, malformed ids, list ids unknown, list owners unknown, S1 without a list, stray tokens, ids twice in a list."""
    from functools import reduce

    from quillmark.functions.ids import ID

    ids = lists.where("ids <> ''").select("s1", F.explode(F.split("ids", ",")).alias("t"))
    s1 = records.where("entity_id like 'S1-%'").select(F.col("entity_id").alias("s1"))
    known = records.select(F.col("entity_id").alias("t"))
    some = {
        "repeated_id": records.groupBy("entity_id").count().where("count > 1"), "malformed_id": records.where(~F.col("entity_id").rlike(ID)),
        "unknown_id": ids.where("t <> ''").join(known, "t", "left_anti"), "unknown_owner": lists.join(s1, "s1", "left_anti"), "missing_list": s1.join(lists, "s1", "left_anti"),
        "stray_token": ids.where("t = ''"), "twice_in_list": ids.where("t <> ''").groupBy("s1", "t").count().where("count > 1"),
    }
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("counter"), "n") for k, d in some.items()])
