"""Tables that are made once: normalized records, embeddings, steps keyed by their settings; side data, settings, names of paths."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import ids, text
from quillmark.sources import tsv


@dataclasses.dataclass(frozen=True)
class Settings:
    """Where things lie, and the thresholds of the decision. Environment variables QUILLMARK_{FIELD} go before what is given."""

    data: str = "data"
    work: str = "work"
    output: str = "output"
    t_emit: float = 0.55
    t_add: float = 0.75
    rel: float = 0.7

    @classmethod
    def load(cls, given: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None) -> Settings:
        env, fields = os.environ if env is None else env, {f.name: f for f in dataclasses.fields(cls)}
        if unknown := set(given or {}) - set(fields):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        over = {n: type(f.default)(env[k]) for n, f in fields.items() if (k := f"QUILLMARK_{n.upper()}") in env}
        return cls(**{**(given or {}), **over})

    def source(self, split: str, n: int) -> str:
        return f"{self.data}/{split}/{split}_source{n}.tsv"

    def truth(self) -> str:
        return f"{self.data}/train/train_ground_truth.tsv"

    def step(self, name: str) -> str:
        return f"{self.work}/{name}"


def stamp(settings: object, *inputs: str) -> str:
    """A name for what a step is made from: its settings and the stamps of what it reads."""
    return hashlib.sha256(json.dumps([settings, *inputs], sort_keys=True, default=str).encode()).hexdigest()[:16]


def made(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """The table at `path` for the stamp `key`: read if it was written whole, else made and written, in folders by the columns `by`. Spark's commit leaves
    a marker only when all parts are there, so a broken run is made anew."""
    at = f"{path}/{key}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    mark = files.Path(f"{at}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").partitionBy(*by).parquet(at)
    return spark.read.parquet(at)


def normalized(spark: SparkSession, settings: Settings, split: str, side: str, columns: list[str] | None = None) -> DataFrame:
    """Normalized records of a split, S1 or targets (S2, then S3): made on first use, then only the asked columns are read."""
    sources = [1] if side == "s1" else [2, 3]
    paths = [settings.source(split, n) for n in sources]

    def make() -> DataFrame:
        raw = reduce(DataFrame.unionByName, [tsv.read_tsv(spark, p, tsv.RECORD) for p in paths])
        return text.normalize(raw).withColumn("key", ids.key_of(F.col("entity_id"))).drop("business_name", "business_address", "entity_id")

    out = made(spark, settings.step(f"normalized/{split}_{side}"), stamp({"views": 1}, *paths), make)
    return out.select(columns) if columns else out


def unit_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """Vectors scaled to length 1 and kept as single precision; a vector of length 0 stays."""
    size = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("_n", size).withColumn(column, F.transform(column, lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x).cast("float"))).drop("_n")


def write_json(spark: SparkSession, path: str, data: object) -> None:
    """One small document, in the store that Spark writes to."""
    spark.createDataFrame([(json.dumps(data, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))  # one small document
