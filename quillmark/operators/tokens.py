"""Token statistics: document frequencies, IDF, masses, overlaps, rarest tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quillmark.functions.batches import pieces

#: So many of the most frequent tokens are broadcast at most, for look-ups in place; the others are joined.
COMMON = 1 << 19
_BLANKS = re.compile("[ \t\n\x0b\f\r]+")


def words(text: str) -> Column:
    """The distinct words of a text, in their order; none if it is null."""
    return F.coalesce(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != "")), F.array().cast("array<string>"))


def split(text: str) -> list[str]:
    """The words of a text, as `words` has them, in Python, with repeats."""
    return text.split() if text.isascii() and text.isprintable() else [w for w in _BLANKS.split(text) if w]


def _distinct(texts: pa.Array) -> pa.Array:
    """The distinct words of each text."""
    return pa.concat_arrays([pa.array([list(dict.fromkeys(split(t))) if t else [] for t in part.to_pylist()], pa.list_(pa.string())) for (part,) in pieces([texts])])


def _within(lists: pa.Array, first: pa.Array) -> pa.Array:
    """The words of each row behind its value and a mark; none where that is null."""
    sizes = np.diff(lists.offsets.to_numpy())
    marked = pc.binary_join_element_wise(first.cast(pa.string()).take(pa.array(np.repeat(np.arange(len(first)), sizes))), lists.flatten(), "\x01")
    ends = np.cumsum(np.where(first.is_valid().to_numpy(zero_copy_only=False), sizes, 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), marked.drop_null())


class Words(NamedTuple):
    """The distinct words of a text column; with `within`, apart for each value of that column."""

    text: str
    within: str | None = None


def _listed(rows: DataFrame, named: Mapping[str, Column | Words]) -> tuple[DataFrame, list[str], Callable]:
    """rows with the given arrays, the columns that all arrays are made from, and how those of a batch are made: each text is taken apart once."""
    from_ = {n: (f"_w_{n}", None) if isinstance(c, Column) else tuple(c) for n, c in named.items()}
    given = {f"_w_{n}": c for n, c in named.items() if isinstance(c, Column)}
    lists = set(given)

    def arrays(batch: pa.RecordBatch) -> list[pa.Array]:
        own = {text: batch.column(text) if text in lists else _distinct(batch.column(text)) for text in dict.fromkeys(text for text, _ in from_.values())}
        return [own[text] if within is None else _within(own[text], batch.column(within)) for text, within in from_.values()]

    return rows.select(*rows.columns, *(c.alias(n) for n, c in given.items())), list(dict.fromkeys(x for pair in from_.values() for x in pair if x)), arrays


def counted_words(rows: DataFrame, named: Mapping[str, Words]) -> DataFrame:
    """(name, token, df): in how many rows each word occurs, as looked_up takes it. Those of a batch are counted before they leave a task."""
    wide, used, arrays = _listed(rows, named)
    wide, names = wide.select(*used), list(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, array in zip(names, arrays(b)):
                found = array.flatten().value_counts()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), found.field("values"), found.field("counts")], ["name", "token", "df"])

    return wide.mapInArrow(run, "name string, token string, df long").groupBy("name", "token").agg(F.sum("df").alias("df"))


def looked_up(rows: DataFrame, freq: DataFrame, named: Mapping[str, Column | Words], most: int = COMMON) -> DataFrame:
    """rows (key, ...) with, for each name, the df of every token of an array column, or of a text's words, in its order, as integers. freq: (name, token,
    df), a table that can be read many times, with all tokens; named: name -> the array's expression, or Words.

    Frequent tokens, `most` at most, are looked up in each row, as most words of a text are frequent; only the others travel, by token and by
    key. Keys are distinct."""
    steps = freq.groupBy(F.floor(F.log2("df")).cast("int").alias("b")).count().collect()  # a few dozen rows
    bar, held = 64, 0
    for b, n in sorted(steps, reverse=True):
        held += n
        if held > most:
            break
        bar = b
    common = freq.where(F.floor(F.log2("df")) >= bar).select("name", "token", "df").toArrow()
    rest = freq.where(F.floor(F.log2("df")) < bar)
    values = {}
    for name in named:
        own = common.filter(pc.equal(common["name"], name))
        values[name] = (own["token"].combine_chunks(), own["df"].combine_chunks().cast(pa.int32()))
    shared = rows.sparkSession.sparkContext.broadcast(values)
    asked, more = list(named), held > most

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, array in zip(asked, arrays(b)):
                flat = array.flatten()
                at = np.flatnonzero(pc.is_null(pc.index_in(flat, value_set=shared.value[name][0])).to_numpy(zero_copy_only=False))
                starts = array.offsets.to_numpy() - array.offsets[0].as_py()
                row = np.searchsorted(starts, at, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row)), pa.array([name] * len(at), pa.string()), pa.array((at - starts[row]).astype(np.int32)), flat.take(pa.array(at))], ["key", "name", "i", "token"])

    wide, used, arrays = _listed(rows.select("key", *(c for c in rows.columns if c != "key")), named)
    found = [f"_m_{n}" for n in asked] if more else []
    if more:
        own = wide.select(*dict.fromkeys(["key", *used]))
        others = own.mapInArrow(lost, f"key {dict(rows.dtypes)['key']}, name string, i int, token string")
        met = others.join(rest, ["name", "token"]).groupBy("key").agg(*(F.collect_list(F.when(F.col("name") == n, F.struct("i", F.col("df").cast("int").alias("df")))).alias(f"_m_{n}") for n in asked))
        wide = wide.join(met, "key", "left").select("key", *found, *wide.columns[1:])
    carried = [c for c in rows.columns if c != "key"]
    names = ["key", *carried, *asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # whole: each look-up makes a table of the frequent tokens
            columns = [b.column(c) for c in ("key", *carried)]
            for name, array in zip(asked, arrays(b)):
                values, counts = shared.value[name]
                starts = pc.subtract(array.offsets, array.offsets[0])
                df = counts.take(pc.index_in(array.flatten(), value_set=values))
                if more:
                    met = b.column(f"_m_{name}")
                    at = np.repeat(starts.to_numpy()[:-1], np.diff(met.offsets.to_numpy())) + met.flatten().field("i").to_numpy()
                    full = df.fill_null(-1).to_numpy().copy()
                    full[at] = met.flatten().field("df").to_numpy()
                    df = pa.array(full, pa.int32(), mask=full < 0)
                columns.append(pa.ListArray.from_arrays(starts, df))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = {f.name: f for f in rows.schema.fields}
    fields = [kind["key"], *(kind[c] for c in carried), *(StructField(n, ArrayType(IntegerType())) for n in asked)]
    return wide.mapInArrow(run, StructType(fields))


def token_table(records: DataFrame, key: str, text: str, *carry: str) -> DataFrame:
    """(key, carried columns, token): each record's distinct words."""
    return records.select(key, *carry, F.explode(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != ""))).alias("token"))


def doc_freq(tokens: DataFrame, *by: str) -> DataFrame:
    return tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))


def idf(tokens: DataFrame, n: DataFrame, *by: str) -> DataFrame:
    """ln(n / max(df, 1)) for each token, n from a table of (by, n): one row for each group."""
    df = doc_freq(tokens, *by)
    met = df.join(F.broadcast(n), list(by)) if by else df.join(F.broadcast(n))  # one row, or one for each group
    return met.select(*by, "token", "df", F.log(F.col("n") / F.greatest("df", F.lit(1))).alias("idf"))


def mass(tokens: DataFrame, weights: DataFrame, key: str, *by: str) -> DataFrame:
    """Sum of the idf of each record's tokens."""
    return tokens.join(weights, [*by, "token"]).groupBy(key).agg(F.sum("idf").alias("mass"))


def overlap(pairs: DataFrame, weighted: DataFrame, rare: float = 8.0) -> DataFrame:
    """Token statistics of (s1, t) pairs from (key, token, idf): n_shared, idf_jacc, idf_cover_s1, idf_cover_t, max_shared_idf, n_shared_rare,
    max_unmatched_idf_s1, max_unmatched_idf_t, token_diff. Each record's tokens travel once, as one array; a pair needs no shuffle of its own."""
    arrays = weighted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("token", "idf"))).alias("toks"), F.sum("idf").alias("mass"))
    a = arrays.select(F.col("key").alias("s1"), F.col("toks").alias("ta"), F.col("mass").alias("ma"))
    b = arrays.select(F.col("key").alias("t"), F.col("toks").alias("tb"), F.col("mass").alias("mb"))
    x = pairs.join(a, "s1", "left").join(b, "t", "left")
    none = F.array().cast("array<struct<token:string,idf:double>>")
    x = x.withColumns({"ta": F.coalesce("ta", none), "tb": F.coalesce("tb", none), "ma": F.coalesce("ma", F.lit(0.0)), "mb": F.coalesce("mb", F.lit(0.0))})
    x = x.withColumns({"both": F.array_intersect("ta", "tb"), "left": F.array_except("ta", "tb"), "right": F.array_except("tb", "ta")})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, e: s + e["idf"])
    most = lambda c: F.coalesce(F.array_max(F.transform(c, lambda e: e["idf"])), F.lit(0.0))
    x = x.withColumn("shared", total("both"))
    return x.select(
        *pairs.columns,
        F.size("both").alias("n_shared"),
        F.abs(F.size("ta") - F.size("tb")).alias("token_diff"),
        (F.col("shared") / F.greatest(F.col("ma") + F.col("mb") - F.col("shared"), F.lit(1e-6))).alias("idf_jacc"),
        (F.col("shared") / F.greatest("ma", F.lit(1e-6))).alias("idf_cover_s1"),
        (F.col("shared") / F.greatest("mb", F.lit(1e-6))).alias("idf_cover_t"),
        most("both").alias("max_shared_idf"),
        F.size(F.filter("both", lambda e: e["idf"] > rare)).alias("n_shared_rare"),
        most("left").alias("max_unmatched_idf_s1"),
        most("right").alias("max_unmatched_idf_t"),
    )


def rare_tokens(tokens: DataFrame, key: str) -> DataFrame:
    """(key, r1, r2): each record's rarest and second-rarest token; ties by the token."""
    line = Window.partitionBy(key).orderBy("df", "token")
    ranked = tokens.join(doc_freq(tokens), "token").withColumn("_r", F.row_number().over(line)).where("_r <= 2")
    return ranked.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col("token"))).alias("r1"), F.max(F.when(F.col("_r") == 2, F.col("token"))).alias("r2"))


def name_frequency(records: DataFrame, group: str, value: str, side: str) -> DataFrame:
    """records with n_s1 and n_t: how many records of either side share the group and value. side: a boolean column, true for S1."""
    same = records.groupBy(group, value).agg(F.count(F.when(F.col(side), 1)).alias("n_s1"), F.count(F.when(~F.col(side), 1)).alias("n_t"))
    return records.join(same, [group, value])
