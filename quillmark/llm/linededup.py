"""Line deduplication by a deletion-neighbourhood join.

Two lines are the same if their word sequences are equal, and near if one word inserted, removed or replaced turns one into
the other (lines of `min_words` words or more). Every line emits the hashes of its variants with one word deleted; lines near
each other share one. Groups of equal variants are reduced to their earliest line, never to pairs; the edit distance to
that line is then verified on the words. Each occurrence of a line stays only if no earlier line is equal or near.

Only lines that share a half with another line emit variants: one edit leaves the first or the second half of a line as
it is, so no pair is lost. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import materialize, maybe_among


def _key() -> list[Column]:
    """(_k, _j): two hashes that name a row's content, so that rows equal in doc_id and text are one document."""
    return [F.xxhash64("doc_id", "text").alias("_k"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_j")]


def _lines(docs: DataFrame) -> DataFrame:
    """(_k, _j, _pos, _place, _l): the lines with a word, their place in the order (doc_id, line number), and their words, each but
    the first after one space. No word is split off: these strings are hashed and cut as they are."""
    text = F.expr(r"replace(replace(replace(replace(text, '\t', ' '), '\r', ' '), '\u000b', ' '), '\u000c', ' ')")
    single = docs.select("_k", "_j", "doc_id", text.alias("_t")).select("_k", "_j", "doc_id", F.expr("CASE WHEN contains(_t, '  ') THEN regexp_replace(_t, ' +', ' ') ELSE _t END").alias("_t"))
    out = single.select("_k", "_j", "doc_id", F.posexplode(F.split("_t", "\n")).alias("_pos", "_t")).select("_k", "_j", "doc_id", "_pos", F.trim("_t").alias("_l")).where("_l <> ''")
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):  # a third of the bytes of a struct
        place = F.expr("coalesce(CAST(doc_id AS DECIMAL(20,0)), 9223372036854775808BD) * 10000000000BD + _pos").cast("decimal(38,0)")
    else:
        place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_pos").alias("line"))
    return out.select("_k", "_j", "_pos", place.alias("_place"), "_l")


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"_h": F.xxhash64("_l"), "_g": F.xxhash64(F.lit(1), "_l")})


#: The number of words of a line.
_N = "(octet_length(_l) - octet_length(replace(_l, ' ', '')) + 1)"


def _halved(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines with _k0 to _k3, keys of their halves: half the words from the front and from the back; odd lines also with one
    word more. Null for lines too short, and _k2 and _k3 for even ones."""
    front, back = "xxhash64('p', substring_index(_l, ' ', {}))", "xxhash64('s', substring_index(_l, ' ', -({})))"
    low, high, odd = "CAST(_n div 2 AS INT)", "CAST(_n div 2 + 1 AS INT)", f"_n >= {min_words} AND _n % 2 = 1"
    keys = [(front, low, f"_n >= {min_words}"), (back, low, f"_n >= {min_words}"), (front, high, odd), (back, high, odd)]
    return lines.withColumn("_n", F.expr(_N)).withColumns({f"_k{i}": F.expr(f"CASE WHEN {when} THEN {key.format(size)} END") for i, (key, size, when) in enumerate(keys)}).drop("_n")


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(_h, _g, _near): for lines with an earlier near line, the earliest one's place."""
    each = distinct.where("_k0 is not null").select("_h", F.posexplode(F.array("_k0", "_k1", "_k2", "_k3")).alias("_side", "_key"))
    keys = each.where("_key is not null").withColumn("_side", F.expr("_side % 2"))
    shared = keys.groupBy("_key").agg(F.min("_h").alias("_a"), F.max("_h").alias("_z")).where("_a <> _z").select("_key")
    some = materialize(keys.join(shared, "_key").groupBy("_h").agg(F.max(F.expr("_side = 0")).alias("_front"), F.max(F.expr("_side = 1")).alias("_back")))
    once = maybe_among(_hashed(_lines(docs)), "_h", some).groupBy("_h", "_g").agg(F.min("_place").alias("_place"), F.any_value("_l").alias("_l"))  # first: a line may stand in a third of all rows
    held = materialize(once.join(some, "_h"))
    # One row for each deletion, and one for the line itself with position -1. Equal contents meet by v. An edit lies behind a
    # front half that is shared, or before a back half: deletions on the other side can't lead to a near line.
    cuts = held.withColumn("_n", F.expr(f"CAST({_N} AS INT)")).select("_h", "_g", "_place", "_l", "_n", F.explode(F.expr("concat(array(0), CASE WHEN _back AND _front THEN sequence(1, _n) WHEN _back THEN sequence(1, CAST(_n div 2 AS INT)) ELSE sequence(CAST(_n div 2 + 1 AS INT), _n) END)")).alias("_i"))
    cut = "xxhash64(trim(concat(substring_index(_l, ' ', _i - 1), ' ', substring_index(_l, ' ', _i - _n))))"
    variants = cuts.select("_h", "_g", "_place", F.expr("CASE WHEN _i = 0 THEN -1 ELSE _i END").alias("i"), F.expr(f"CASE WHEN _i = 0 THEN xxhash64(_l) ELSE {cut} END").alias("v"), F.expr("CASE WHEN _i = 0 THEN _n ELSE _n - 1 END").alias("n"))
    variants = materialize(variants)
    inner = variants.groupBy("v", "n", "i").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_c"))
    # replaced: the earliest line with the same deletion at the same position; inserted or removed: a whole line against deletions
    replaced = inner.where("i > 0 and _c > 1").select("v", "n", "i", "_first")
    whole = inner.groupBy("v", "n").agg(F.min(F.when(F.col("i") < 0, F.col("_first"))).alias("_full"), F.min(F.when(F.col("i") > 0, F.col("_first"))).alias("_cut")).where("_full is not null and _cut is not null")
    near = variants.where("i > 0").join(replaced, ["v", "n", "i"]).where("_first < _place").select("_h", "_g", "_place", "_first")
    longer = variants.where("i > 0").join(whole, ["v", "n"]).where("_full < _place").select("_h", "_g", "_place", F.col("_full").alias("_first"))
    shorter = variants.where("i < 0").join(whole, ["v", "n"]).where("_cut < _place").select("_h", "_g", "_place", F.col("_cut").alias("_first"))
    best = near.unionByName(longer).unionByName(shorter).distinct()
    own = held.select("_h", "_g", F.split("_l", " ").alias("_w"))
    other = held.select(F.col("_place").alias("_first"), F.split("_l", " ").alias("_x"))
    pairs = best.join(own, ["_h", "_g"]).join(other, "_first")
    return pairs.where(within_one("_w", "_x")).groupBy("_h", "_g").agg(F.min("_first").alias("_near"))


def within_one(a: str, b: str) -> Column:
    """Whether at most one word inserted, removed or replaced turns array a into array b."""
    front = f"(array_position(transform(arrays_zip({a}, {b}), z -> coalesce(z.`{a}` = z.`{b}`, false)), false) - 1)"
    back = f"(array_position(transform(arrays_zip(reverse({a}) , reverse({b})), z -> coalesce(z.`0` = z.`1`, false)), false) - 1)"
    return F.expr(f"abs(size({a}) - size({b})) <= 1 AND ({a} = {b} OR ({front}) + {back} >= greatest(size({a}), size({b})) - 1)")


def dropped_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """(_k, _j, _drop): for rows that lose lines, the numbers of those lines from 0."""
    docs = docs.select("doc_id", "text", *_key()).where("text is not null")
    lines = _hashed(_lines(docs))
    distinct = materialize(_halved(lines, min_words).groupBy("_h", "_g").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"), *(F.min(f"_k{i}").alias(f"_k{i}") for i in range(4))))
    near = materialize(_near(docs, distinct))
    marked = distinct.select("_h", "_g", "_first", "_n").join(near, ["_h", "_g"], "left").where("_n > 1 or _near is not null").select("_h", "_g", F.least("_first", F.coalesce("_near", "_first")).alias("_first"))
    late = lines.select("_k", "_j", "_pos", "_place", "_h", "_g").join(materialize(marked), ["_h", "_g"]).where("_place > _first")
    return late.groupBy("_k", "_j").agg(F.collect_set("_pos").alias("_drop"))  # a document's own lines


def dedup(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """docs with `text` without its repeated lines, n_lines (\\n-split lines, 0 for null) and n_dropped.

    A line is dropped if an equal or near line stands earlier in the order (doc_id, line number); null doc_id comes last, ids may be of any type that has an order. Lines
    without a word always stay. Rows equal in doc_id and text are one document and keep the same lines; lines at the
    same place of two texts with one doc_id tie, and both stay. Null texts stay null, empty ones empty; a text that loses all its lines
    becomes empty. An empty table gives no rows. Other columns, whatever their names, are kept; columns named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    drop = dropped_lines(docs, min_words)
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "text")).alias("own"), F.col("text").alias("all"), *_key()).join(drop, ["_k", "_j"], "left")  # columns of any name stay apart
    left = F.expr("CASE WHEN _drop IS NULL THEN `all` ELSE array_join(transform(filter(transform(split(`all`, '\\n'), (l, i) -> named_struct('l', l, 'i', i)), z -> NOT array_contains(_drop, z.i)), z -> z.l), '\\n') END")
    lines = F.expr(r"CAST(coalesce(octet_length(`all`) - octet_length(replace(`all`, '\n', '')) + 1, 0) AS INT)")
    return out.select(*(left.alias(c) if c.lower() == "text" else F.col(f"own.`{c}`") for c in docs.columns), lines.alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).alias("n_dropped"))
