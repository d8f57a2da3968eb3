"""Views of the test tables as entity-resolution inputs, as DataFrames and as SQL of the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans.normal_sql import NORMAL


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for heavy work on each row: a small file of one row group is one task's. Inputs of
    more partitions than cores, as any large one, aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def records(spark: SparkSession, d: str) -> DataFrame:
    """documents as records: name is the text before the first full stop, address all that follows. same and same2 name
    the trimmed text without case by 128 bits: records meet by them, not by their texts."""
    return table(spark, d, "documents").selectExpr(
        "CAST(1 + doc_id % 3 AS INT) AS src", "(1 + doc_id % 3) * 10000000000 + doc_id AS key", "concat('S', 1 + doc_id % 3, '-', doc_id) AS entity_id",
        "substring_index(text, '.', 1) AS business_name", "substring(text, length(substring_index(text, '.', 1)) + 2) AS business_address", "lang AS country",
        "xxhash64(lower(trim(text))) AS same", "xxhash64(1, lower(trim(text))) AS same2", "doc_id",
    )


def truth(spark: SparkSession, d: str) -> DataFrame:
    """(s1, t): records with equal text; S1 is the first of them."""
    r = records(spark, d)
    first = r.groupBy("same", "same2").agg(F.min("doc_id").alias("_m"))
    x = r.select("key", "doc_id", "same", "same2").join(first, ["same", "same2"])
    return x.where("doc_id <> _m").join(r.select(F.col("doc_id").alias("_m"), F.col("key").alias("s1")), "_m").select("s1", F.col("key").alias("t"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as scored pairs (s1, t, p, label, emb, b4_rank, rr)."""
    x = table(spark, d, "lineitem").selectExpr("l_orderkey AS s1", "l_partkey % 500 AS t", "(l_quantity * 2 - 1) / 100 AS p", "CAST(l_returnflag = 'R' AS INT) AS label", "l_discount AS emb", "CAST(l_linenumber AS INT) AS b4_rank", "CASE WHEN l_linestatus = 'O' THEN l_quantity / 64 END AS rr")
    return x.groupBy("s1", "t").agg(*(F.max(c).alias(c) for c in ("p", "label", "emb", "b4_rank", "rr")))


def owners(spark: SparkSession, d: str) -> DataFrame:
    """orders as S1 (s1, country)."""
    return table(spark, d, "orders").selectExpr("o_orderkey AS s1", "concat('c', o_custkey % 3) AS country")


SQL = {
    "rec": "SELECT (1 + doc_id % 3)::INT AS src, (1 + doc_id % 3) * 10000000000 + doc_id AS key, 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, split_part(text, '.', 1) AS business_name, substr(text, length(split_part(text, '.', 1)) + 2) AS business_address, lang AS country, lower(trim(text)) AS same, doc_id FROM documents",
    "tru": "SELECT f.key AS s1, r.key AS t FROM rec r JOIN (SELECT same, min(doc_id) AS m FROM rec GROUP BY same) g ON r.same = g.same AND r.doc_id <> g.m JOIN rec f ON f.doc_id = g.m",
    "prs": "SELECT s1, t, max(p) AS p, max(label) AS label, max(emb) AS emb, max(b4_rank) AS b4_rank, max(rr) AS rr FROM (SELECT l_orderkey AS s1, l_partkey % 500 AS t, (l_quantity * 2 - 1) / 100 AS p, (l_returnflag = 'R')::INT AS label, l_discount AS emb, l_linenumber::INT AS b4_rank, CASE WHEN l_linestatus = 'O' THEN l_quantity / 64 END AS rr FROM lineitem) GROUP BY s1, t",
    "own": "SELECT o_orderkey AS s1, 'c' || (o_custkey % 3) AS country FROM orders",
    "nrm": NORMAL,
    "tok": "SELECT DISTINCT key, country, unnest(regexp_split_to_array(lower(business_name), '\\s+')) AS token FROM rec",
}


def sql(body: str, *views: str) -> str:
    """body with the views it names in front; the views come in an order that suits them all."""
    need = [v for v in SQL if v in views]
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in need) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")
