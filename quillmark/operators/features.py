"""The pair feature tables: of pool pairs for the pruner, of candidates for stage 1. Missing is NULL.

A table is made by two joins (the record views of either side, with the frequencies of their words), one pass of string scorers over both sides'
views, the token statistics, and windows over s1 that share one exchange. Tables hold s1, t and the features; what the pool brings is carried."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quillmark.functions import similarity as S
from quillmark.functions import text
from quillmark.functions.batches import pieces
from quillmark.operators import tokens
from quillmark.operators.lists import best_first, by_s1

BLOCKERS = ["b4", "b2w", "b1"]
VIEWS = ["name_ascii", "name_core", "legal_form", "address_core", "landmark", "house_no", "postal", "country"]
IN_POOL = ["emb_cos", "emb_margin_other", "name_tset", "name_ratio", "addr_tset", "name_jacc", "addr_jacc", "b2w_score", "b1_score"]
IN_LIST = ["name_core_tset", "name_core_jw", "addr_tset", "name_idf_jacc", "addr_idf_jacc", "combo"]


def gathered(pairs: DataFrame, records: DataFrame, views: list[str]) -> DataFrame:
    """pairs with a struct of views of either record: a (of s1) and b (of t)."""
    side = lambda key, name: records.select(F.col("key").alias(key), F.struct(*views).alias(name))
    return pairs.join(side("s1", "a"), "s1").join(side("t", "b"), "t")


def ranks_or_null(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c)).alias(c)


def in_group(pairs: DataFrame, values: list[str], rank: str, gap: str, margin: list[str] | None = None) -> DataFrame:
    """For each value its rank in the S1's list and the gap to the best; for those of `margin` also how far above the best other one (-1 if none)."""
    out = {}
    for v in values:
        line, have = best_first("s1", v, "t"), F.col(v).isNotNull()
        place, best = F.row_number().over(line), F.max(v).over(by_s1())
        out |= {f"{v}_{rank}": F.when(have, place), f"{v}_{gap}": F.when(have, best - F.col(v))}
        if v in (margin or []):
            second = F.coalesce(F.nth_value(v, 2).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(-1.0))
            out[f"{v}_margin"] = F.when(have, F.col(v) - F.when(place == 1, second).otherwise(best))
    return pairs.withColumns(out)


def with_frequencies(records: DataFrame, views: list[tuple[str, str, bool]], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """records with, for each (view, prefix, by_country), the df of the view's words as _d_{prefix}, in their order; by country also _d_{prefix}_pc
    under its own country, empty without a country. _n and _n_pc: the records of all, and of the country."""
    named = {f"_d_{p}": tokens.Words(v) for v, p, _ in views} | {f"_d_{p}_pc": tokens.Words(v, "country") for v, p, by_country in views if by_country}
    n = records.groupBy("country").agg(F.count(F.lit(1)).alias("_n_pc"))
    out = tokens.looked_up(records, keep(tokens.counted_words(records, named)), named)
    return out.withColumn("_n", F.lit(records.count())).join(F.broadcast(n), "country", "left")  # one row for each country


STATS = ["n_shared", "token_diff", "idf_jacc", "idf_cover_s1", "idf_cover_t", "max_shared_idf", "n_shared_rare", "max_unmatched_idf_s1", "max_unmatched_idf_t"]
#: Those that differ by country.
COUNTRY_STATS = [c for c in STATS if c not in ("n_shared", "token_diff")]


def _words(text: str | None) -> dict[str, None]:
    return dict.fromkeys(tokens.split(text)) if text else {}


def _idf(words: dict[str, None], df: np.ndarray | None, n: int | None) -> dict[str, float]:
    """The idf of each word; none without frequencies."""
    return dict(zip(words, np.log(n / np.asarray(df, float)).tolist())) if df is not None and len(df) else {}


def _weights(text: str | None, df: np.ndarray | None, n: int | None) -> dict[str, float]:
    return _idf(_words(text), df, n)


def shared_words(a: dict[str, float], b: dict[str, float], rare: float = 8.0) -> tuple:
    """The statistics of tokens.overlap, in the order of STATS, from the words of either side with their idf."""
    met = {t for t in a.keys() & b.keys() if a[t] == b[t]}
    both = [x for t, x in a.items() if t in met] if met else []
    left, right = ([x for t, x in s.items() if t not in met] if met else s.values() for s in (a, b))
    shared, of_a, of_b = sum(both), sum(a.values()), sum(b.values())
    return (len(both), abs(len(a) - len(b)), shared / max(of_a + of_b - shared, 1e-6), shared / max(of_a, 1e-6), shared / max(of_b, 1e-6), max(both, default=0.0), sum(x > rare for x in both), max(left, default=0.0), max(right, default=0.0))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of whole numbers, as arrays; empty for null."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(at[:-1], at[1:])]


def overlaps(view: str, prefix: str, by_country: bool = False) -> Column:
    """The statistics of shared words as a struct, from the views and frequencies of both sides, a and b; by country also pc_{statistic}, with the words' frequencies
    under their own countries. Texts are taken apart once for both. Not by tokens.overlap: Spark compares arrays of structs each with each."""
    freq = [(f"_d_{prefix}", "_n"), *([(f"_d_{prefix}_pc", "_n_pc")] if by_country else [])]
    names = [*STATS, *(f"pc_{c}" for c in STATS if by_country)]
    kinds = [IntegerType() if c.removeprefix("pc_") in ("n_shared", "token_diff", "n_shared_rare") else DoubleType() for c in names]

    @F.arrow_udf(StructType([StructField(*x) for x in zip(names, kinds)]))
    def run(*columns: pa.Array) -> pa.Array:
        done, own = [], len(columns) // 2
        for part in pieces(columns):
            out = []
            for r in zip(*(_lists(c) if i % own % 2 == 1 else c.to_pylist() for i, c in enumerate(part))):
                a, b = _words(r[0]), _words(r[own])
                out.append([v for i in range(1, own, 2) for v in shared_words(_idf(a, *r[i : i + 2]), _idf(b, *r[own + i : own + i + 2]))])
            done.append(pa.StructArray.from_arrays([pa.array(c, pa.int32() if k == IntegerType() else pa.float64()) for c, k in zip(list(zip(*out)) or [()] * len(names), kinds)], names))
        return pa.concat_arrays(done)

    return run(*(F.col(f"{side}.{c}") for side in ("a", "b") for c in (view, *(x for f in freq for x in f))))


def with_competition(pairs: DataFrame, other: DataFrame, value: str, best_other: str, margin: str, is_best: str | None = None, n: str | None = None) -> DataFrame:
    """The best value that another S1 has for the target, from a table (t, best, second, best_s1[, n_s1]) of the two best."""
    x = pairs.join(other.withColumnsRenamed({c: f"_{c}" for c in other.columns if c != "t"}), "t", "left")
    mine = F.coalesce(F.col("_best_s1") == F.col("s1"), F.lit(False))
    rival = F.coalesce(F.when(mine, F.col("_second")).otherwise(F.col("_best")), F.lit(-1.0))
    out = {best_other: rival, margin: F.coalesce(value, F.lit(-1.0)) - rival} | ({is_best: mine.cast("int")} if is_best else {}) | ({n: F.col("_n_s1")} if n else {})
    return x.withColumns(out).drop(*(f"_{c}" for c in other.columns))


def pruner_features(pool: DataFrame, records: DataFrame, reverse: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """35 features of each pool pair. pool: s1, t, {b4,b2w,b1}_{score,rank} with rank 0 where not retrieved, emb_cos; records: normalized, with
    key and country, a table that can be read many times; reverse: (t, best, second, best_s1) of the embeddings' reverse search. keep: writes a
    table that is read several times."""
    x = with_competition(pool, reverse, "emb_cos", "_rival", "emb_margin_other").drop("_rival")
    views = [("name_core", "name", False), ("address_core", "addr", False)]
    own = with_frequencies(records.select("key", "country", "name_ascii", "name_core", "address_core", "house_no"), views, keep)
    x = gathered(x, own, [c for c in own.columns if c not in ("key", "country", "_n_pc")])
    x = x.withColumn("_s", S.several(["core_tset", "ascii_ratio", "addr_tset"], F.col("a.name_core"), F.col("b.name_core"), F.col("a.name_ascii"), F.col("b.name_ascii"), F.col("a.address_core"), F.col("b.address_core")))
    empty = (F.col("a.address_core") == "") | (F.col("b.address_core") == "")
    x = x.withColumns({"_name": overlaps("name_core", "name"), "_addr": overlaps("address_core", "addr")})
    x = x.select(
        "s1", "t", *(f"{b}_score" for b in BLOCKERS), *(ranks_or_null(f"{b}_rank") for b in BLOCKERS), "emb_cos", "emb_margin_other",
        F.col("_s.core_tset").alias("name_tset"), F.col("_s.ascii_ratio").alias("name_ratio"), F.when(~empty, F.col("_s.addr_tset")).alias("addr_tset"), (F.col("b.address_core") == "").cast("int").alias("t_addr_empty"),
        S.same_state(F.col("a.house_no"), F.col("b.house_no")).alias("house_eq"), F.col("_name.idf_jacc").alias("name_jacc"), F.when(~empty, F.col("_addr.idf_jacc")).alias("addr_jacc"), (F.floor(F.col("t") / 10_000_000_000) == 2).cast("int").alias("t_is_s2"),
    ).withColumn("n_pool", F.count(F.lit(1)).over(by_s1()))
    return in_group(x, IN_POOL, "prank", "pgap")


def stage1_features(pool: DataFrame, records: DataFrame, competition: DataFrame, reverse: DataFrame, blockers: tuple[str, ...] = ("b1", "b2w", "b4"), keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """The features of each candidate: pool as for the pruner, with prune_p and the four key flags; competition: (t, best, second, best_s1,
    n_s1) of b2w_score over all S1; records and keep as for the pruner."""
    x = with_competition(pool, competition, "b2w_score", "b2w_t_best_other_s1", "b2w_margin_vs_other_s1", "b2w_is_t_argmax", "t_n_s1_cands")
    x = with_competition(x, reverse, "emb_cos", "emb_t_best_other_s1_cos", "emb_margin_vs_other_s1", "emb_is_t_argmax")
    same = records.groupBy("country", "name_core").agg(F.count(F.when(F.floor(F.col("key") / 10_000_000_000) == 1, 1)).alias("_f1"), F.count(F.when(F.floor(F.col("key") / 10_000_000_000) > 1, 1)).alias("_ft"))
    same = records.select("key", "country", "name_core").join(same, ["country", "name_core"], "left").select("key", "_f1", "_ft")
    views = [("name_core", "name", True), ("address_core", "addr", True), ("numbers", "num", False)]
    own = with_frequencies(records.select("key", *VIEWS, "numbers"), views, keep).join(same, "key")
    own = own.withColumns({"acr": text.acronym(F.col("name_core")), "compact": F.replace("name_core", F.lit(" "), F.lit(""))})
    x = gathered(x, own, [c for c in own.columns if c not in ("key", "country")])
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    names = ["ratio", "tset", "tsort", "partial", "jw"]
    wanted = [f"{v}_{n}" for v in ("name_core", "name_ascii") for n in names] + ["addr_tset", "addr_tsort", "addr_ratio", "addr_jw", "landmark_tset"]
    sides = [v for c in ("name_core", "name_ascii", "address_core", "landmark") for v in (a(c), b(c))]
    jw = [n for n in wanted if n.endswith("_jw")]  # in a pass of its own: who doesn't read the others' columns doesn't pay for them
    x = x.withColumns({"_s": S.several([n for n in wanted if n not in jw], *sides), "_j": S.several(jw, *sides[:6])})
    score = lambda n: F.col(f"_j.{n}" if n in jw else f"_s.{n}")
    empty = (a("address_core") == "") | (b("address_core") == "")
    unless = lambda none, c: F.when(~none, c)
    out = {n: score(n) for n in wanted if n.startswith("name_")}
    out |= {f"{v}_lev": S.levenshtein_similarity(a(v), b(v)) for v in ("name_core", "name_ascii")}
    out |= {n: unless(empty, score(n)) for n in wanted if n.startswith("addr_")} | {"landmark_tset": unless((a("landmark") == "") | (b("landmark") == ""), F.col("_s.landmark_tset"))}
    out |= {"acronym_match": S.acronym_match(a("acr"), a("compact"), b("acr"), b("compact")).cast("int")}
    out |= {n: S.same_state(a(v), b(v)) for n, v in (("postal_eq", "postal"), ("house_eq", "house_no"), ("legal_eq", "legal_form"))}
    out |= {"name_len_ratio": S.length_ratio(a("name_core"), b("name_core")), "addr_len_ratio": unless(empty, S.length_ratio(a("address_core"), b("address_core")))}
    out |= {"t_addr_empty": (b("address_core") == "").cast("int"), "t_landmark": (b("landmark") != "").cast("int"), "s1_landmark": (a("landmark") != "").cast("int"), "t_is_s2": (F.floor(F.col("t") / 10_000_000_000) == 2).cast("int")}
    out |= {"name_freq_s1_in_s1": F.log1p(a("_f1")), "name_freq_s1_in_t": F.log1p(a("_ft")), "name_freq_t_in_s1": F.log1p(b("_f1")), "name_freq_t_in_t": F.log1p(b("_ft"))}
    x = x.withColumns(out).withColumn("combo", (F.col("name_core_tset") + F.coalesce("addr_tset", F.lit(0.0))) / 2)
    x = x.select(*(ranks_or_null(c) if c in [f"{k}_rank" for k in blockers] else F.col(c) for c in x.columns if c not in ("_s", "_j")))
    x = x.withColumns({f"_o_{p}": overlaps(v, p, by_country) for v, p, by_country in views})
    x = x.select(*(c for c in x.columns if c not in ("a", "b") and not c.startswith("_o_")), *(F.col(f"_o_{p}.{c}").alias(f"{p}_{c}") for _, p, by_country in views for c in [*STATS, *(f"pc_{c}" for c in COUNTRY_STATS if by_country)]))
    x = x.withColumns({"n_cands": F.count(F.lit(1)).over(by_s1()), "n_cands_s2": F.sum("t_is_s2").over(by_s1())})
    return in_group(x, [*IN_LIST, *(f"{b}_score" for b in blockers), "emb_cos", "prune_p"], "grank", "gap", IN_LIST)
