"""A corpus pipeline of five stages over `documents`: language ID, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import jaccard, language, linededup, mixing, packing
from quillmark.llm.common import materialize, tidy_executors
from quillmark.llm.queries import MIX, TOKENIZER, WEIGHTS, domain_of, tokens_of


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go; a null lang becomes the predicted one.

    Null texts and texts without a letter are rejected. Each repeated row is judged by itself; without any lang or in an empty table nothing stays."""
    out = language.identify(docs.select("doc_id", "text", "lang", F.struct("*").alias("own")), language.fit(docs)).where("NOT lang_rejected")
    lang = F.coalesce("lang", "lang_pred")
    return out.select(*(lang.alias(c) if c == "lang" else F.col(f"own.`{c}`") for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for their first place in the order (doc_id, line number); documents of which nothing is left go too.

    Null and empty texts lose nothing and stay; rows equal in doc_id and text keep the same lines; of lines at the same place of two texts
    with one doc_id both stay."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("own")
    out = linededup.dedup(docs.select("doc_id", "text", others)).where(F.expr(r"n_dropped = 0 OR text rlike '[^\\x20\\x09-\\x0D]'"))
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("own.n_chars"))
    return out.select(*(F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"own.`{c}`") for c in docs.columns))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays, null last; of ties, any one.

    Documents without words are linked to nothing and stay, except that of rows equal in doc_id and text one stays."""
    groups = jaccard.join(docs)
    alone = F.when(F.col("n_shingles") == 0, F.struct("_r", "_q"))  # linked to nothing
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_r").alias("r"), F.col("_q").alias("q")))
    stay = groups.groupBy("root", alone.alias("_alone")).agg(first.alias("_f")).select(F.col("_f.r").alias("_r"), F.col("_f.q").alias("_q"))
    stay = materialize(stay)
    many = materialize(groups.groupBy("_r", "_q").count().where("count > 1").select("_r", "_q"))  # rows equal in doc_id and text
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "text").alias("_r"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_q"))
    kept = rows.join(stay, ["_r", "_q"], "left_semi")
    if many.isEmpty():
        return kept.select("_row.*")
    one = kept.join(many, ["_r", "_q"], "left_anti").unionByName(kept.join(many, ["_r", "_q"], "left_semi").dropDuplicates(["_r", "_q"]))
    return one.select("_row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document stays once for each epoch that takes it.

    A null text has no tokens and is taken by the same rule as others; a null lang or source is a leaf of its own; rows equal in doc_id,
    text, lang and source are taken together, each as often; ties in the drawn order fall by doc_id."""
    taken = mixing.mix(docs, WEIGHTS, domain_of("source"), tokens_of("text"), **MIX).select("_row", "_twin", "copies")
    rows = docs.select(F.struct("*").alias("own"), *mixing.row_key()).join(taken, ["_row", "_twin"])
    return rows.select("own", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("own.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 ids. Null and empty texts have just the end id; repeated rows are packed each by itself; other columns aren't read."""
    tidy_executors(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, edit distances and tokenizers are beyond SQL: tests/llm/test_pipeline_stages.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
