"""Tab-separated sources and sinks: no quoting, everything a string, empty for missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ["entity_id", "business_name", "business_address", "country"]
TRUTH = ["source1_entity_id", "matched_entity_ids"]


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A file with a header line; quotes and backslashes are ordinary characters."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.csv(path, schema=schema, sep="\t", quote="", escape="\x00", header=True, enforceSchema=True)
    return raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def count_data_lines(spark: SparkSession, path: str) -> int:
    """Lines without the header; the last line may lack its end."""
    return max(spark.read.text(path).count() - 1, 0)


def write_tsv(df: DataFrame, path: str) -> None:
    """Fields must not hold tabs or line ends: such a field raises."""
    checked = df.select(*(F.when(F.col(c).rlike("[\t\n\r]"), F.raise_error(F.lit(f"{c}: tab or line end in a field"))).otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in df.columns))
    checked.write.csv(path, sep="\t", quote="", escape="\x00", header=True, emptyValue="", nullValue="")


def id_lists(s1: DataFrame, pairs: DataFrame, list_name: str = "matched_entity_ids") -> DataFrame:
    """One row for each s1 id, with its targets sorted and joined by commas; empty without any. pairs: (s1, t) ids."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias(list_name))
    return s1.select("s1").join(lists, "s1", "left").select("s1", F.coalesce(list_name, F.lit("")).alias(list_name))


def explode_lists(df: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, t) for each id of the comma lists."""
    return df.select(key, F.explode(F.split(ids, ",")).alias("t")).where("t <> ''")


def stray_tokens(ids: Column) -> Column:
    """Empty tokens in a list that isn't empty."""
    return F.when(ids == "", 0).otherwise(F.size(F.filter(F.split(ids, ","), lambda t: t == "")))


def cache(df: DataFrame, path: str) -> DataFrame:
    """Written as zstd Parquet and read again: columns that later steps don't select are not read."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
