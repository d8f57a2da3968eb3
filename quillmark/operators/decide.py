"""Decision rule, its tuning, set metrics, votes and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators.lists import assign_targets, best_first, expected_f_pairs
from quillmark.sources.tsv import id_lists


def apply_rule(pairs: DataFrame, t_emit: float, t_add: float, rel: float) -> DataFrame:
    """Emitted pairs: of S1 whose best p reaches t_emit, the best and all with p >= t_add and p >= rel * best."""
    x = pairs.withColumns({"_r": F.row_number().over(best_first("s1", "p", "t")), "_b": F.max("p").over(Window.partitionBy("s1"))})
    return x.where((F.col("_b") >= t_emit) & ((F.col("_r") == 1) | ((F.col("p") >= t_add) & (F.col("p") >= F.col("_b") * rel)))).drop("_r", "_b")


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    p, r = tp / n_pred, tp / n_true
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def counts(s1: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, n_pred, n_true, tp) for all S1. Predictions and truth meet in one aggregation; nothing is joined pair by pair."""
    both = pred.select("s1", "t", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(truth.select("s1", "t", F.lit(0).alias("a"), F.lit(1).alias("b")))
    pair = both.groupBy("s1", "t").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    per = pair.groupBy("s1").agg(F.sum("a").alias("n_pred"), F.sum("b").alias("n_true"), F.sum(F.col("a") * F.col("b")).alias("tp"))
    return s1.join(per, "s1", "left").na.fill(0, ["n_pred", "n_true", "tp"])


def metrics(c: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5, accuracy on S1 without truth, micro precision and recall."""
    f = f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    one = lambda x: F.greatest(x, F.lit(1))
    return c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_s1"), F.round(F.avg(f), 6).alias("macro_f05"), F.round(F.avg(F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double"))), 6).alias("singleton_acc"),
        F.round(F.sum("tp") / one(F.sum("n_pred")), 6).alias("pair_precision"), F.round(F.sum("tp") / one(F.sum("n_true")), 6).alias("pair_recall"),
    )


def grid_sums(pairs: DataFrame, truth: DataFrame, s1: DataFrame, emit: list[float], add: list[float], rel: list[float], *by: str) -> DataFrame:
    """(by, t_emit, t_add, rel, f, n): the sum of the F0.5 of all S1, and how many there are, for each point of a grid; of few groups of S1 each, if asked for.

    Of an S1 with the best p b, a pair stays if p reaches both t_add and rel * b: the lesser of two counts, of which there are as many as
    thresholds, not combinations. t_emit only decides between that and an empty list: S1 are summed by the last t_emit that b reaches,
    and those sums added up. So an S1 makes add x rel rows inside an aggregation, whatever the number of t_emit."""
    spark = pairs.sparkSession
    emit, add, rel = sorted(emit), sorted(add), sorted(rel)
    marked = pairs.select("s1", "t", "p").join(truth.select("s1", "t", F.lit(1).alias("y")), ["s1", "t"], "left").na.fill(0, ["y"])
    lists = marked.groupBy("s1").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("n"), "t", "y"))).alias("l"))
    n_true = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    per = s1.select("s1", *by).join(lists, "s1", "left").join(n_true, "s1", "left").na.fill(0, ["n_true"])
    numbers = lambda x: "array(" + ", ".join(f"{float(v)!r}D" for v in x) + ")"
    per = per.withColumn("b", F.expr("-l[0].n")).withColumns({
        "e": F.expr(f"coalesce(size(filter({numbers(emit)}, x -> x <= b)), 0)"),
        "a": F.expr(f"transform({numbers(add)}, x -> size(filter(l, z -> -z.n >= x)))"),
        "r": F.expr(f"transform({numbers(rel)}, x -> size(filter(l, z -> -z.n >= b * x)))"),
        "hit": F.expr("transform(sequence(1, size(l)), k -> aggregate(slice(l, 1, k), 0, (s, z) -> s + z.y))"),
    }).select(*by, "e", "n_true", "a", "r", "hit")
    nothing = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    empty = per.groupBy(*by, "e").agg(F.sum(nothing).alias("f0"), F.count(F.lit(1)).alias("n"))  # a row for each t_emit, and one
    some = per.where("e > 0").select(*by, "e", "n_true", "r", "hit", F.posexplode("a").alias("i", "_a")).select(*by, "e", "n_true", "hit", "i", "_a", F.posexplode("r").alias("j", "_r"))
    some = some.withColumn("k", F.greatest(F.lit(1), F.least("_a", "_r"))).withColumn("tp", F.expr("hit[k - 1]"))
    sums = some.groupBy(*by, "e", "i", "j").agg(F.sum(f05(F.col("tp"), F.col("k"), F.col("n_true"))).alias("f"))
    grid = grid_table(spark, emit, add, rel).withColumns({n: F.expr(f"array_position({numbers(x)}, {c}) - 1") for n, c, x in (("h", "t_emit", emit), ("i", "t_add", add), ("j", "rel", rel))})
    at = grid.crossJoin(F.broadcast(empty)).groupBy(*by, "t_emit", "t_add", "rel", "h", "i", "j").agg(F.sum(F.when(F.col("e") <= F.col("h"), F.col("f0")).otherwise(0.0)).alias("f0"), F.sum("n").alias("n"))  # all of the grid's size
    same = F.expr("i = _i AND j = _j")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    kept = at.join(F.broadcast(sums.withColumnsRenamed({"e": "_e", "i": "_i", "j": "_j"} | {c: f"_{c}" for c in by})), same, "left").groupBy(*by, "t_emit", "t_add", "rel", "f0", "n").agg(F.sum(F.when(F.col("_e") > F.col("h"), F.col("f"))).alias("f"))
    return kept.select(*by, "t_emit", "t_add", "rel", (F.col("f0") + F.coalesce("f", F.lit(0.0))).alias("f"), "n")


def grid_search(pairs: DataFrame, truth: DataFrame, s1: DataFrame, emit: list[float], add: list[float], rel: list[float]) -> DataFrame:
    """Macro F0.5 of each (t_emit, t_add, rel) of a grid."""
    return grid_sums(pairs, truth, s1, emit, add, rel).select("t_emit", "t_add", "rel", F.round(F.col("f") / F.col("n"), 6).alias("macro_f05"))


def grid_table(spark: SparkSession, emit, add, rel) -> DataFrame:
    return spark.createDataFrame([(float(a), float(b), float(c)) for a in emit for b in add for c in rel], "t_emit double, t_add double, rel double")


def best_thresholds(scores: DataFrame, n: int = 1) -> DataFrame:
    return scores.orderBy(F.desc("macro_f05"), "t_emit", "t_add", "rel").limit(n)


def emission_profile(pairs: DataFrame, emitted: DataFrame, s1: DataFrame) -> DataFrame:
    """Per country: S1, share with nothing emitted, pairs per S1 with any, mean best p, mean emitted p."""
    best = pairs.groupBy("s1").agg(F.max("p").alias("best"))
    e = emitted.groupBy("s1").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"))
    x = s1.join(best, "s1", "left").join(e, "s1", "left").na.fill(0, ["n", "sum_p"])
    return x.groupBy("country").agg(F.count(F.lit(1)).alias("n_s1"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("empty_share"), F.round(F.sum("n") / F.greatest(F.sum((F.col("n") > 0).cast("int")), F.lit(1)), 6).alias("pairs_per_matched"), F.round(F.avg("best"), 6).alias("mean_best_p"), F.round(F.sum("sum_p") / F.greatest(F.sum("n"), F.lit(1)), 6).alias("mean_emitted_p"))


def vote_lists(runs: list[DataFrame], least: int) -> DataFrame:
    """(s1, ids): the ids that `least` of the runs (s1, ids) hold or more: those of the first run with a list in its order, then others in
    the order of the runs."""
    rows = [r.select("s1", F.lit(n).alias("run"), F.posexplode(F.split("ids", ",")).alias("at", "t")).where("t <> ''") for n, r in enumerate(runs)]
    votes = reduce(DataFrame.unionByName, rows).groupBy("s1", "t").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("run", "at")).alias("place"))
    kept = votes.where(F.col("votes") >= least).groupBy("s1").agg(F.sort_array(F.collect_list(F.struct("place", "t"))).alias("l"))
    return runs[0].select("s1").join(kept, "s1", "left").select("s1", F.coalesce(F.array_join("l.t", ","), F.lit("")).alias("ids"))


def vote(runs: list[DataFrame], least: int) -> DataFrame:
    """(s1, t) emitted by `least` runs or more."""
    return reduce(DataFrame.unionByName, [r.select("s1", "t").distinct() for r in runs]).groupBy("s1", "t").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least)


def logit_adjust(q: Column, a: float, b: float, eps: float = 1e-6) -> Column:
    x = F.greatest(F.least(q, F.lit(1 - eps)), F.lit(eps))
    return 1 / (1 + F.exp(-(a * F.log(x / (1 - x)) + b)))


def unseen_thresholds(best: DataFrame, seen: list[str], share: float, t_emit: float) -> DataFrame:
    """(country, t_emit): for countries not seen in training the quantile of the best p at the wanted empty share, never below t_emit."""
    q = best.groupBy("country").agg(F.round(F.percentile("best", F.lit(share)), 6).alias("q"))
    return q.select("country", F.when(F.col("country").isin(seen), F.lit(t_emit)).otherwise(F.greatest("q", F.lit(t_emit))).alias("t_emit"))


def validate(out: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(rule, n): how many rows or ids of an output (s1, ids) break each rule; rules that hold have no row. s1 (s1), targets (t): known ids."""
    ids = out.where("ids <> ''").select("s1", F.explode(F.split("ids", ",")).alias("t"))
    rules = {
        "duplicate_row": out.groupBy("s1").count().where("count > 1").select("s1"),
        "duplicate_id": ids.where("t <> ''").groupBy("s1", "t").count().where("count > 1").select("s1"),
        "bad_prefix": ids.where("t <> '' AND NOT t rlike '^S[23]-'").select("s1"),
        "stray_token": ids.where("t = ''").select("s1"),
        "unknown_id": ids.where("t <> ''").join(targets, "t", "left_anti").select("s1"),
        "unknown_s1": out.join(s1, "s1", "left_anti").select("s1"),
        "missing_s1": s1.join(out, "s1", "left_anti").select("s1"),
    }
    rows = [d.select(F.lit(name).alias("rule")) for name, d in rules.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def emit(pairs: DataFrame, how: str, rule: tuple[float, float, float] = (0.55, 0.75, 0.7), miss: float = 0.05) -> DataFrame:
    """Emitted pairs, by the rule or by the largest expected F0.5."""
    if how not in ("rule", "expected_f"):
        raise ValueError(f"unknown way to emit: {how}")
    return apply_rule(pairs, *rule) if how == "rule" else expected_f_pairs(pairs, miss)


def tune(pairs: DataFrame, truth: DataFrame, s1: DataFrame, emit: list[float], add: list[float], rel: list[float]) -> DataFrame:
    """The best thresholds of the grid and the metrics they give: a row for each country, and one with the country null for all.

    The grid's macro F0.5 must equal that of the emitted sets, else an error is raised."""
    best = best_thresholds(grid_search(pairs, truth, s1, emit, add, rel)).first()  # one row
    rule = (best["t_emit"], best["t_add"], best["rel"])
    per = counts(s1, apply_rule(pairs.select("s1", "t", "p"), *rule), truth)
    all_ = metrics(per).withColumn("country", F.lit(None).cast("string"))
    if abs(all_.first()["macro_f05"] - best["macro_f05"]) > 2e-6:
        raise AssertionError("the grid search and the emitted sets disagree")
    return metrics(per, "country").unionByName(all_).withColumns({"t_emit": F.lit(rule[0]), "t_add": F.lit(rule[1]), "rel": F.lit(rule[2])})


def predict(pairs: DataFrame, s1: DataFrame, how: str = "rule", rule: tuple[float, float, float] = (0.55, 0.75, 0.7), margin: float | None = None, adjust: tuple[float, float] | None = None, s1_id=None, t_id=None) -> DataFrame:
    """(s1, ids): one list for each S1, from scored pairs: logit adjustment and assignment of targets, if asked for, then emission, then lists.
    s1_id and t_id name the keys. Lists that break a rule of the validator raise an error where they are used."""
    x = pairs.select("s1", "t", "p")
    x = x.withColumn("p", logit_adjust(F.col("p"), *adjust)) if adjust else x
    x = assign_targets(x, margin) if margin is not None else x
    name = (lambda c: c.cast("string")) if s1_id is None else s1_id
    out = emit(x.where("p > 0"), how, rule).select(name(F.col("s1")).alias("s1"), (t_id or name)(F.col("t")).alias("t"))
    lists = id_lists(s1.select(name(F.col("s1")).alias("s1")), out, "ids")
    bad = F.col("ids").rlike("(^|,)(?!S[23]-)") & (F.col("ids") != "")
    return lists.withColumn("ids", F.when(bad, F.raise_error(F.concat(F.lit("not a target's id in the list of "), F.col("s1")))).otherwise(F.col("ids")))


def validate_files(spark: SparkSession, files: dict[str, tuple[str, list[str]]], s1: DataFrame, targets: DataFrame | None = None, subset: tuple[str, str] | None = None) -> DataFrame:
    """(file, rule, n): how often each rule is broken. files: name -> (path, header); targets (t): known ids, if they are to be checked; subset:
    names of two files of which the first's ids must be among the second's. A file with a wrong header is not read further.

    Rules: header, comma_separated, no_tab, duplicate_row, duplicate_id, self_match, bad_prefix, unknown_id, missing_s1, unknown_s1, not_in_candidates.
    The files are read line by line as tables: one pass for the lines' form, none on the driver but of the header."""
    out, lists = [], {}
    for name, (path, header) in files.items():
        lines = spark.read.text(path)
        first = lines.limit(1).collect()  # one line
        got = first[0]["value"] if first else ""
        rule = None if [c.strip().lower() for c in got.split("\t")] == header else "comma_separated" if "\t" not in got and "," in got else "header"
        if rule:
            out.append(spark.createDataFrame([(name, rule, 1)], "file string, rule string, n long"))
            continue
        body = lines.where(F.col("value") != got)
        rows = body.where("instr(value, '\t') > 0").selectExpr("split_part(value, '\t', 1) AS s1", "substring(value, instr(value, '\t') + 1) AS ids")
        ids = rows.where("trim(ids) <> ''").select("s1", F.explode(F.split("ids", ",")).alias("t"))
        lists[name] = ids
        broken = {
            "no_tab": body.where("instr(value, '\t') = 0 AND trim(value) <> ''").select("value"), "duplicate_row": rows.groupBy("s1").count().where("count > 1").select("s1"),
            "duplicate_id": ids.groupBy("s1", "t").count().where("count > 1").select("s1").distinct(), "self_match": ids.where("t LIKE 'S1-%'").select("t").distinct(),
            "bad_prefix": ids.where("NOT t rlike '^S[123]-'").select("t").distinct(), "missing_s1": s1.join(rows, "s1", "left_anti").select("s1"), "unknown_s1": rows.join(s1, "s1", "left_anti").select("s1").distinct(),
        }
        if targets is not None:
            broken["unknown_id"] = ids.where("t rlike '^S[23]-'").join(targets, "t", "left_anti").select("t").distinct()
        out += [d.select(F.lit(name).alias("file"), F.lit(r).alias("rule")).groupBy("file", "rule").agg(F.count(F.lit(1)).alias("n")) for r, d in broken.items()]
    if subset and set(subset) <= set(lists):
        over = subset_violations(lists[subset[0]], lists[subset[1]])
        out.append(over.select(F.lit(subset[0]).alias("file"), F.lit("not_in_candidates").alias("rule")).groupBy("file", "rule").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, out)


def subset_violations(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    return matches.join(candidates, ["s1", "t"], "left_anti").select("s1", "t")


def error_buckets(truth: DataFrame, pred: DataFrame, cands: DataFrame) -> DataFrame:
    """(bucket, n): found, missed though a candidate, missed by blocking, false."""
    tag = lambda d, n: d.select("s1", "t", *(F.lit(int(k == n)).alias(k) for k in ("y", "e", "c")))
    x = tag(truth, "y").unionByName(tag(pred, "e")).unionByName(tag(cands, "c")).groupBy("s1", "t").agg(*(F.max(k).alias(k) for k in ("y", "e", "c")))
    b = F.when((F.col("y") == 1) & (F.col("e") == 1), "found").when((F.col("y") == 1) & (F.col("c") == 1), "missed_candidate").when(F.col("y") == 1, "missed_blocking").when(F.col("e") == 1, "false")
    return x.select(b.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
