"""Queries of the stages: pair features, stage 2, the decision from end to end, reports, sources. The SQL holds what SQL can express of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import ids, similarity, text
from quillmark.operators import blocking, decide, features, lists, reports, stack, tokens
from quillmark.plans.registry import _FOUR, _GRID, _METRICS, ORACLES, QUERIES, _four_keys, _kept, _named_rows, _normal, _scratch, _topk_sql, _vectors, query
from quillmark.plans.views import owners, pairs, records, spread, sql, table, truth
from quillmark.sources import store, stress, synthetic, tsv
from quillmark.streaming import competition

# ---- the pool: near records with made-up scores -----------------------------------------------------------------------

_KEYS = ["k_name", "k_postal", "k_house", "k_rare2"]
_POOL = """+near AS (SELECT a.key AS s1, b.key AS t FROM rec a JOIN rec b ON a.country = b.country AND a.src = 1 AND b.src > 1 AND a.doc_id // 10 = b.doc_id // 10),
ranked AS (SELECT s1, t, ((s1 + 7 * t) % 40)::INT AS b4_rank, ((3 * s1 + t) % 25)::INT AS b2w_rank, ((s1 + t) % 11)::INT AS b1_rank, ((s1 + 3 * t) % 101) / 100.0::DOUBLE AS emb_cos, ((s1 + 5 * t) % 97) / 97.0::DOUBLE AS prune_p, ((s1 + t) % 5 = 0)::INT AS k_name, 0 AS k_postal, ((s1 + t) % 7 = 0)::INT AS k_house, 0 AS k_rare2 FROM near),
pool AS (SELECT *, CASE WHEN b4_rank > 0 THEN 1.0::DOUBLE / b4_rank END AS b4_score, CASE WHEN b2w_rank > 0 THEN 1.0::DOUBLE / b2w_rank END AS b2w_score, CASE WHEN b1_rank > 0 THEN 1.0::DOUBLE / b1_rank END AS b1_score FROM ranked) """


def near_pairs(s, d) -> DataFrame:
    r = records(s, d)
    a, b = r.where("src = 1").selectExpr("key AS s1", "country", "doc_id div 10 AS g"), r.where("src > 1").selectExpr("key AS t", "country", "doc_id div 10 AS g")
    return a.join(b, ["country", "g"]).select("s1", "t")


def _pool(s, d) -> DataFrame:
    return with_scores(near_pairs(s, d))


def with_scores(near: DataFrame) -> DataFrame:
    x = near.selectExpr("s1", "t", "CAST((s1 + 7 * t) % 40 AS INT) AS b4_rank", "CAST((3 * s1 + t) % 25 AS INT) AS b2w_rank", "CAST((s1 + t) % 11 AS INT) AS b1_rank", "((s1 + 3 * t) % 101) / 100D AS emb_cos", "((s1 + 5 * t) % 97) / 97D AS prune_p", "CAST((s1 + t) % 5 = 0 AS INT) AS k_name", "0 AS k_postal", "CAST((s1 + t) % 7 = 0 AS INT) AS k_house", "0 AS k_rare2")
    return x.withColumns({f"{b}_score": F.when(F.col(f"{b}_rank") > 0, 1.0 / F.col(f"{b}_rank")) for b in features.BLOCKERS})


def _two_best(pool: DataFrame, value: str) -> DataFrame:
    return lists.target_competition(pool.select("s1", "t", F.coalesce(value, F.lit(-1.0)).alias("score")))


def _two_best_sql(name: str, value: str) -> str:
    return f", {name} AS (SELECT t, max(v) FILTER (WHERE r = 1) AS best, coalesce(max(v) FILTER (WHERE r = 2), -1) AS second, max(s1) FILTER (WHERE r = 1) AS best_s1, count(*) AS n_s1 FROM (SELECT s1, t, coalesce({value}, -1) AS v, row_number() OVER (PARTITION BY t ORDER BY coalesce({value}, -1) DESC, s1) AS r FROM pool) GROUP BY t) "


def _overlap_sql(view: str, prefix: str, by_country: bool) -> str:
    """CTE {prefix}_o (s1, t, ...) with the token statistics of a view of nrm."""
    p, same = prefix, "AND x.country = i.country" if by_country else ""
    group, total = ("k.country, token", "(SELECT country, count(*) AS n FROM nrm GROUP BY country) c ON c.country = k.country") if by_country else ("token", "(SELECT count(*) AS n FROM nrm) c ON true")
    return f""", {p}_k AS (SELECT DISTINCT key, country, unnest(list_filter(string_split({view}, ' '), lambda t: t <> '')) AS token FROM nrm),
{p}_i AS (SELECT {group}, ln(any_value(n) / count(*)) AS idf FROM {p}_k k JOIN {total} GROUP BY {group}), {p}_w AS (SELECT x.key, x.token, idf FROM {p}_k x JOIN {p}_i i ON x.token = i.token {same}), {p}_m AS (SELECT key, sum(idf) AS mass, count(*) AS n FROM {p}_w GROUP BY key),
{p}_a AS (SELECT p.s1, p.t, count(y.token) AS n, coalesce(sum(x.idf) FILTER (WHERE y.token IS NOT NULL), 0) AS sh, coalesce(max(x.idf) FILTER (WHERE y.token IS NOT NULL), 0) AS mx, coalesce(max(x.idf) FILTER (WHERE y.token IS NULL), 0) AS un, count(*) FILTER (WHERE y.token IS NOT NULL AND x.idf > 8) AS rare FROM near p JOIN {p}_w x ON x.key = p.s1 LEFT JOIN {p}_w y ON y.key = p.t AND y.token = x.token AND y.idf = x.idf GROUP BY ALL),
{p}_b AS (SELECT p.s1, p.t, coalesce(max(y.idf) FILTER (WHERE x.token IS NULL), 0) AS un FROM near p JOIN {p}_w y ON y.key = p.t LEFT JOIN {p}_w x ON x.key = p.s1 AND y.token = x.token AND y.idf = x.idf GROUP BY ALL),
{p}_o AS (SELECT p.s1, p.t, coalesce(a.n, 0)::INT AS n_shared, abs(coalesce(m1.n, 0) - coalesce(m2.n, 0))::INT AS token_diff, coalesce(sh, 0) / greatest(coalesce(m1.mass, 0) + coalesce(m2.mass, 0) - coalesce(sh, 0), 1e-6) AS idf_jacc, coalesce(sh, 0) / greatest(coalesce(m1.mass, 0), 1e-6) AS idf_cover_s1, coalesce(sh, 0) / greatest(coalesce(m2.mass, 0), 1e-6) AS idf_cover_t, coalesce(mx, 0) AS max_shared_idf, coalesce(rare, 0)::INT AS n_shared_rare, coalesce(a.un, 0) AS max_unmatched_idf_s1, coalesce(b.un, 0) AS max_unmatched_idf_t
  FROM near p LEFT JOIN {p}_a a ON a.s1 = p.s1 AND a.t = p.t LEFT JOIN {p}_b b ON b.s1 = p.s1 AND b.t = p.t LEFT JOIN {p}_m m1 ON m1.key = p.s1 LEFT JOIN {p}_m m2 ON m2.key = p.t) """


_STATS = ["idf_jacc", "idf_cover_s1", "idf_cover_t", "max_shared_idf", "n_shared_rare", "max_unmatched_idf_s1", "max_unmatched_idf_t"]


def _place(v: str, rank: str, gap: str, margin: bool = False) -> str:
    line = f"PARTITION BY s1 ORDER BY {v} DESC NULLS LAST, t"
    out = f"CASE WHEN {v} IS NOT NULL THEN row_number() OVER ({line}) END AS {v}_{rank}, round(max({v}) OVER (PARTITION BY s1) - {v}, 6) AS {v}_{gap}"
    return out + (f", round({v} - CASE WHEN row_number() OVER ({line}) = 1 THEN coalesce(nth_value({v}, 2) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -1) ELSE max({v}) OVER (PARTITION BY s1) END, 6) AS {v}_margin" if margin else "")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# ---- pair features ----------------------------------------------------------------------------------------------------


def written_records(s, d) -> DataFrame:
    return _kept(s)(_normal(s, d).select("key", *features.VIEWS, "numbers"))


def _written(s, d, pool: DataFrame | None = None, normal: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pool and the normalized records, which a plan of many steps reads again and again: as tables, so that it stays small."""
    return _kept(s)(_pool(s, d) if pool is None else pool), written_records(s, d) if normal is None else normal


@query("f_pruner_features")
def _(s, d):
    return pruner_table(s, d)


def pruner_table(s, d, pool: DataFrame | None = None) -> DataFrame:
    pool, normal = _written(s, d, pool)
    return _rounded(features.pruner_features(pool, normal, _two_best(pool, "emb_cos"), _kept(s)))


_PLAIN = ["emb_cos", "emb_margin_other", "name_jacc", "addr_jacc", "b2w_score", "b1_score"]


@query("f_pruner_features_sql", sql(_POOL + _two_best_sql("rev", "emb_cos") + _overlap_sql("name_core", "name", False) + _overlap_sql("address_core", "addr", False) + f""", x AS (
SELECT p.s1, p.t, round(b4_score, 6) AS b4_score, round(b2w_score, 6) AS b2w_score, round(b1_score, 6) AS b1_score, nullif(b4_rank, 0) AS b4_rank, nullif(b2w_rank, 0) AS b2w_rank, nullif(b1_rank, 0) AS b1_rank, emb_cos, emb_cos - CASE WHEN best_s1 = p.s1 THEN second ELSE best END AS emb_margin_other,
(b.address_core = '')::INT AS t_addr_empty, CASE WHEN a.house_no <> '' AND b.house_no <> '' THEN (a.house_no = b.house_no)::INT END AS house_eq, n.idf_jacc AS name_jacc, CASE WHEN a.address_core <> '' AND b.address_core <> '' THEN o.idf_jacc END AS addr_jacc, (p.t // 10000000000 = 2)::INT AS t_is_s2, count(*) OVER (PARTITION BY p.s1) AS n_pool
FROM pool p JOIN rev ON rev.t = p.t JOIN nrm a ON a.key = p.s1 JOIN nrm b ON b.key = p.t JOIN name_o n ON n.s1 = p.s1 AND n.t = p.t JOIN addr_o o ON o.s1 = p.s1 AND o.t = p.t)
SELECT * REPLACE (round(emb_margin_other, 6) AS emb_margin_other, round(name_jacc, 6) AS name_jacc, round(addr_jacc, 6) AS addr_jacc), {', '.join(_place(v, 'prank', 'pgap') for v in ['emb_cos'])}, {', '.join(f"CASE WHEN {v} IS NOT NULL THEN round(max({v}) OVER (PARTITION BY s1) - {v}, 6) END AS {v}_pgap" for v in ('emb_margin_other', 'name_jacc', 'addr_jacc'))} FROM x""", "rec", "nrm"))
def _(s, d):
    """Without the three string scores and their places, which SQL lacks; places of values that rounding decides aren't compared."""
    x = QUERIES["f_pruner_features"](s, d)
    keep = [c for c in x.columns if not c.startswith(("name_tset", "name_ratio", "addr_tset")) and not (c.endswith(("_prank", "_pgap")) and c not in ("emb_cos_prank", "emb_cos_pgap", "emb_margin_other_pgap", "name_jacc_pgap", "addr_jacc_pgap"))]
    return x.select(keep)


@query("f_stage1_features")
def _(s, d):
    return stage1_table(s, d)


def stage1_table(s, d, pool: DataFrame | None = None, normal: DataFrame | None = None) -> DataFrame:
    pool, normal = _written(s, d, pool, normal)
    return _rounded(features.stage1_features(pool, normal, _two_best(pool, "b2w_score"), _two_best(pool, "emb_cos"), keep=_kept(s)))


_EQ = "CASE WHEN a.{0} <> '' AND b.{0} <> '' THEN (a.{0} = b.{0})::INT END"
_LEN = "least(length(a.{0}), length(b.{0})) / greatest(length(a.{0}), length(b.{0}), 1)"
_LEV = "CASE WHEN greatest(length(a.{0}), length(b.{0})) = 0 THEN 1 ELSE 1 - levenshtein(a.{0}, b.{0}) / greatest(length(a.{0}), length(b.{0})) END"
_BOTH = "a.address_core <> '' AND b.address_core <> ''"
_TOKENS = [(p, v, c) for p, v, c in (("name", "name_core", False), ("addr", "address_core", False), ("num", "numbers", False), ("name_pc", "name_core", True), ("addr_pc", "address_core", True))]


@query("f_stage1_features_sql", sql(_POOL + _two_best_sql("comp", "b2w_score") + _two_best_sql("rev", "emb_cos") + "".join(_overlap_sql(v, p, c) for p, v, c in _TOKENS) + f""",
same AS (SELECT country, name_core, count(*) FILTER (WHERE src = 1) AS f1, count(*) FILTER (WHERE src > 1) AS ft FROM nrm GROUP BY ALL), own AS (SELECT n.*, f1, ft FROM nrm n LEFT JOIN same z ON n.country = z.country AND n.name_core = z.name_core)
SELECT p.s1, p.t, round(jaro_winkler_similarity(a.name_core, b.name_core), 6) AS name_core_jw, round(jaro_winkler_similarity(a.name_ascii, b.name_ascii), 6) AS name_ascii_jw, round({_LEV.format('name_core')}, 6) AS name_core_lev, round({_LEV.format('name_ascii')}, 6) AS name_ascii_lev, CASE WHEN {_BOTH} THEN round(jaro_winkler_similarity(a.address_core, b.address_core), 6) END AS addr_jw,
{', '.join(f'{p}_o.n_shared AS {p}_n_shared, {p}_o.token_diff AS {p}_token_diff' for p, _, c in _TOKENS if not c)}, {', '.join(f'round({p}_o.{x}, 6) AS {p}_{x}' for p, _, _ in _TOKENS for x in _STATS)},
{', '.join(f"{_EQ.format(v)} AS {n}" for n, v in (('postal_eq', 'postal'), ('house_eq', 'house_no'), ('legal_eq', 'legal_form')))}, round({_LEN.format('name_core')}, 6) AS name_len_ratio, CASE WHEN {_BOTH} THEN round({_LEN.format('address_core')}, 6) END AS addr_len_ratio, (b.address_core = '')::INT AS t_addr_empty, (b.landmark <> '')::INT AS t_landmark, (a.landmark <> '')::INT AS s1_landmark, (p.t // 10000000000 = 2)::INT AS t_is_s2,
round(ln(1 + a.f1), 6) AS name_freq_s1_in_s1, round(ln(1 + a.ft), 6) AS name_freq_s1_in_t, round(ln(1 + b.f1), 6) AS name_freq_t_in_s1, round(ln(1 + b.ft), 6) AS name_freq_t_in_t, nullif(b4_rank, 0) AS b4_rank, nullif(b2w_rank, 0) AS b2w_rank, nullif(b1_rank, 0) AS b1_rank, round(b4_score, 6) AS b4_score, round(b2w_score, 6) AS b2w_score, round(b1_score, 6) AS b1_score, {', '.join(_KEYS)}, round(prune_p, 6) AS prune_p, emb_cos,
comp.n_s1 AS t_n_s1_cands, round(CASE WHEN comp.best_s1 = p.s1 THEN comp.second ELSE comp.best END, 6) AS b2w_t_best_other_s1, round(coalesce(b2w_score, -1) - CASE WHEN comp.best_s1 = p.s1 THEN comp.second ELSE comp.best END, 6) AS b2w_margin_vs_other_s1, (comp.best_s1 = p.s1)::INT AS b2w_is_t_argmax, round(CASE WHEN rev.best_s1 = p.s1 THEN rev.second ELSE rev.best END, 6) AS emb_t_best_other_s1_cos, round(emb_cos - CASE WHEN rev.best_s1 = p.s1 THEN rev.second ELSE rev.best END, 6) AS emb_margin_vs_other_s1, (rev.best_s1 = p.s1)::INT AS emb_is_t_argmax,
count(*) OVER (PARTITION BY p.s1) AS n_cands, sum((p.t // 10000000000 = 2)::INT) OVER (PARTITION BY p.s1)::BIGINT AS n_cands_s2
FROM pool p JOIN comp ON comp.t = p.t JOIN rev ON rev.t = p.t JOIN own a ON a.key = p.s1 JOIN own b ON b.key = p.t {' '.join(f'JOIN {p}_o ON {p}_o.s1 = p.s1 AND {p}_o.t = p.t' for p, _, _ in _TOKENS)}""", "rec", "nrm"))
def _(s, d):
    """Without the scores of common subsequences, what is made of them, the acronym (f9_acronym_match has it) and the places."""
    x = QUERIES["f_stage1_features"](s, d)
    gone = ("_ratio", "_tset", "_tsort", "_partial", "combo", "acronym_match", "_grank", "_gap", "_margin")
    return x.select([c for c in x.columns if not c.endswith(gone) or c.endswith("len_ratio")])


@query("f9_acronym_match", sql(_POOL + ", w AS (SELECT key, name_core, list_filter(string_split(name_core, ' '), lambda t: t <> '') AS ws FROM nrm), y AS (SELECT key, CASE WHEN len(ws) >= 2 THEN array_to_string(list_transform(ws, lambda t: t[1]), '') ELSE '' END AS acr, replace(name_core, ' ', '') AS compact FROM w) SELECT s1, t, ((a.acr <> '' AND a.acr = b.compact) OR (b.acr <> '' AND b.acr = a.compact)) AS hit FROM near JOIN y a ON a.key = s1 JOIN y b ON b.key = t", "rec", "nrm"))
def _(s, d):
    r = _normal(s, d).select("key", text.acronym(F.col("name_core")).alias("acr"), F.replace("name_core", F.lit(" "), F.lit("")).alias("compact"))
    x = features.gathered(_pool(s, d).select("s1", "t"), r, ["acr", "compact"])
    return x.select("s1", "t", similarity.acronym_match(F.col("a.acr"), F.col("a.compact"), F.col("b.acr"), F.col("b.compact")).alias("hit"))


@query("p23_blocker_texts", sql("SELECT key, name_ascii AS b1, trim(concat_ws(' ', name_core, address_core)) AS b2w FROM nrm", "rec", "nrm"))
def _(s, d):
    return _normal(s, d).select("key", text.blocker_text("b1").alias("b1"), text.blocker_text("b2w").alias("b2w"))


@query("p24_model_texts", sql("SELECT key, 'query: ' || name_ascii || ' | ' || address_norm AS embedder, name_ascii || ' | ' || address_norm AS reranker, coalesce(business_name, '') || ' | ' || coalesce(business_address, '') AS raw FROM nrm JOIN rec USING (key)", "rec", "nrm"))
def _(s, d):
    return _normal(s, d).select("key", *(text.model_text(k).alias(k) for k in ("embedder", "reranker", "raw")))


# ---- candidates -------------------------------------------------------------------------------------------------------


@query("j11_positions", sql("SELECT s1, t, coalesce(p_size, -1) AS at FROM prs LEFT JOIN part ON p_partkey = t AND p_partkey % 3 = 0", "prs"))
def _(s, d):
    return stack.positions(pairs(s, d).select("s1", "t"), table(s, d, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey AS t", "p_size AS at"), "t", "at")


@query("j12_gather", sql(_POOL + "SELECT s1, t, a.name_core AS name_s1, b.name_core AS name_t, a.postal AS postal_s1, b.postal AS postal_t FROM near JOIN nrm a ON a.key = s1 JOIN nrm b ON b.key = t", "rec", "nrm"))
def _(s, d):
    x = features.gathered(_pool(s, d).select("s1", "t"), _normal(s, d), ["name_core", "postal"])
    return x.select("s1", "t", F.col("a.name_core").alias("name_s1"), F.col("b.name_core").alias("name_t"), F.col("a.postal").alias("postal_s1"), F.col("b.postal").alias("postal_t"))


def _inner(body: str) -> str:
    return "WITH " + body.removeprefix("+").replace("FROM rec", "FROM nrm")


_BY_KEY = "SELECT a.key AS s1, b.key AS t FROM f a JOIN (SELECT key, {0} AS k, count(*) OVER (PARTITION BY {0}) AS n FROM f WHERE src > 1 AND {0} IS NOT NULL) b ON a.{0} = b.k AND a.src = 1 AND b.n <= 20"
_WORDS = "list_filter(string_split(name_core, ' '), lambda t: t <> '')"
_CHARS = "list_transform(range(1, length(name_ascii) - 1), lambda i: substr(name_ascii, i, 3))"


@query("j20_block_universe", sql(_FOUR + f", wa AS ({_inner(_topk_sql(_WORDS, 0.1, 8, 10))}), ca AS ({_inner(_topk_sql(_CHARS, 0.02, 12, 5))}), kp AS ({_BY_KEY.format('k_postal')}), kr AS ({_BY_KEY.format('k_rare2')}) SELECT s1, t, wa.score AS b2w_score, ca.score AS b1_score, coalesce(wa.rank, 0)::INT AS b2w_rank, coalesce(ca.rank, 0)::INT AS b1_rank, coalesce(kp.k, 0)::INT AS k_postal, coalesce(kr.k, 0)::INT AS k_rare2 FROM wa FULL JOIN ca USING (s1, t) FULL JOIN (SELECT DISTINCT s1, t, 1 AS k FROM kp) kp USING (s1, t) FULL JOIN (SELECT DISTINCT s1, t, 1 AS k FROM kr) kr USING (s1, t)", "rec", "nrm"))
def _(s, d):
    rows = _named_rows(s, d)
    r = rows.select("key", "country", "name_core", "name_ascii", (F.col("src") == 1).alias("is_s1"))
    word = blocking.tfidf_topk(r, "name_core", "word", 0.1, 8, 10, _kept(s)).select("s1", "t", "score", "rank")
    char = blocking.tfidf_topk(r, "name_ascii", "char3", 0.02, 12, 5, _kept(s)).select("s1", "t", "score", "rank")
    k = _kept(s)(_four_keys(s, d, rows))
    keyed = {n: blocking.key_block_pairs(k.where("src = 1").selectExpr("key AS s1", f"{n} AS key"), k.where("src > 1").selectExpr("key AS t", f"{n} AS key"), 20) for n in ("k_postal", "k_rare2")}
    return blocking.union_pool({"b2w": word, "b1": char}, keyed)


@query("k2_union_prune", sql(_POOL + "SELECT s1, t, CASE WHEN b4_rank BETWEEN 1 AND 10 THEN b4_rank ELSE 0 END AS b4_rank, CASE WHEN b2w_rank BETWEEN 1 AND 5 THEN b2w_rank ELSE 0 END AS b2w_rank FROM pool WHERE b4_rank BETWEEN 1 AND 10 OR b2w_rank BETWEEN 1 AND 5", "rec"))
def _(s, d):
    p = _pool(s, d)
    cut = {b: p.where(F.col(f"{b}_rank").between(1, k)).select("s1", "t", F.col(f"{b}_score").alias("score"), F.col(f"{b}_rank").alias("rank")) for b, k in (("b4", 10), ("b2w", 5))}
    return blocking.union_pool(cut, {}).select("s1", "t", "b4_rank", "b2w_rank")


_TRIPLES = f"SELECT p.s1 AS anchor, p.t AS positive, h.t AS negative FROM prs p JOIN ({ORACLES['j18_hard_negative']}) h ON h.s1 = p.s1 WHERE label = 1"


@query("j21_triplets", sql(_TRIPLES, "prs"))
def _(s, d):
    return stack.triplets(pairs(s, d).where("label = 1").select("s1", "t"), QUERIES["j18_hard_negative"](s, d))


@query("j22_record_swap", sql("SELECT s1, t, CASE WHEN md5(s1 || ':' || t) < '8' THEN t ELSE s1 END AS l, CASE WHEN md5(s1 || ':' || t) < '8' THEN s1 ELSE t END AS r FROM prs", "prs"))
def _(s, d):
    p = pairs(s, d).selectExpr("s1", "t", "s1 AS l", "t AS r")
    return stack.swapped(p, "l", "r", F.md5(F.concat_ws(":", F.col("s1").cast("string"), F.col("t").cast("string"))) < "8")


_UNIT = "+u AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) "


@query("s9_unit_vectors", sql(_UNIT + "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (CASE WHEN n > 0 THEN x / n ELSE x END)::FLOAT::DOUBLE)), 4) AS total, len(embedding) AS n FROM u", "own"))
def _(s, d):
    v = store.unit_vectors(table(s, d, "embeddings"), "embedding")
    return v.selectExpr("vec_id", "round(aggregate(embedding, 0D, (a, x) -> a + CAST(x AS DOUBLE)), 4) AS total", "size(embedding) AS n")


# ---- stage 2 ----------------------------------------------------------------------------------------------------------


@query("j9_rerank_join", sql("SELECT s1, t, p, rr AS rr_p, CASE WHEN t % 2 = 0 THEN emb END AS rw_p FROM prs", "prs"))
def _(s, d):
    x = pairs(s, d)
    blocks = {"rr": x.where("rr is not null").select("s1", "t", F.col("rr").alias("p")), "rw": x.where("t % 2 = 0").select("s1", "t", F.col("emb").alias("p"))}
    return stack.attach(x.select("s1", "t", "p"), blocks)


@query("j10_extra_evidence", sql("SELECT s1, t, p, CASE WHEN label = 1 THEN emb END AS old_emb, CASE WHEN label = 1 THEN b4_rank END AS old_b4_rank FROM prs", "prs"))
def _(s, d):
    x = pairs(s, d)
    return stack.attach(x.select("s1", "t", "p"), {"old": x.where("label = 1").select("s1", "t", "emb", "b4_rank")})


@query("w12_block_features", sql(f"""+c AS ({ORACLES['a13_competition_rerank'].removeprefix('WITH ').partition('SELECT s1, t, CASE')[1]}{ORACLES['a13_competition_rerank'].partition('SELECT s1, t, CASE')[2]})
SELECT p.s1, p.t, rr AS rr_p, tc_other AS rr_t_other_best, tc_is_best AS rr_t_is_argmax, tc_n_hi AS rr_t_n_other_hi, round(max(rr) OVER (PARTITION BY p.s1) - rr, 6) AS rr_gap_best, sum(coalesce((rr > 0.5)::INT, 0)) OVER (PARTITION BY p.s1)::BIGINT AS rr_n_hi, round(rr - coalesce(tc_other, 0), 6) AS rr_margin_t FROM prs p JOIN c ON c.s1 = p.s1 AND c.t = p.t""", "prs"))
def _(s, d):
    return _rounded(stack.block_features(pairs(s, d).selectExpr("s1", "t", "rr AS rr_p"), "rr"))


def target_views(s, d, normal: DataFrame | None = None) -> DataFrame:
    """Targets as stage 2 reads them, with an embedding each from the given ones. normal: the normalized records, if they are written."""
    r = (_normal(s, d) if normal is None else normal.selectExpr("*", "CAST(key div 10000000000 AS INT) AS src", "key % 10000000000 AS doc_id")).where("src > 1")
    e = table(s, d, "embeddings").selectExpr("vec_id AS n", "embedding AS emb")
    return r.withColumn("n", F.col("doc_id") % 500).join(e, "n", "left").selectExpr("key", "name_core AS name", "address_core AS addr", "src AS source", "emb")


@query("w11_graph_features")
def _(s, d):
    p = _pool(s, d).selectExpr("s1", "t", "prune_p AS p", "emb_cos")
    targets = target_views(s, d)
    rr = p.where("t % 3 = 0").select("s1", "t", F.col("emb_cos").alias("p"))
    return _rounded(stack.graph_features(spread(p), targets, {"rr": rr}))


@query("w14_with_assignment", sql("+e AS (SELECT 'a' AS frame, s1, t, p FROM prs WHERE s1 % 2 = 0 UNION ALL SELECT 'b', s1, t, p FROM prs WHERE s1 % 2 = 1) SELECT frame, s1, t, CASE WHEN r = 1 AND round(p - coalesce(nx, 0), 9) >= 0.02 THEN p ELSE 0 END AS p FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, s1) AS r, lead(p) OVER (PARTITION BY t ORDER BY p DESC, s1) AS nx FROM e)", "prs"))
def _(s, d):
    p = pairs(s, d)
    return stack.with_assignment({"a": p.where("s1 % 2 = 0"), "b": p.where("s1 % 2 = 1")}, 0.02)


# ---- decision ---------------------------------------------------------------------------------------------------------


@query("d3_emit_expected_f", sql(f"+k AS ({ORACLES['w15_expected_f'].partition('), x AS')[2] and 'SELECT * FROM (SELECT s1, f, k, f0, row_number() OVER (PARTITION BY s1 ORDER BY f DESC, k) AS r FROM (SELECT s1, k, round(1.25::DOUBLE * c / (k + 0.25::DOUBLE * (sp + 0.05::DOUBLE)), 9) AS f, round(0.95::DOUBLE * exp(nn), 9) AS f0 FROM (SELECT s1, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS c, sum(p) OVER (PARTITION BY s1) AS sp, sum(ln(greatest(1 - p, 1e-9))) OVER (PARTITION BY s1) AS nn FROM prs WINDOW w AS (PARTITION BY s1 ORDER BY p DESC NULLS LAST, t)))) WHERE r = 1'}) SELECT q.s1, t, p FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC NULLS LAST, t) AS n FROM prs) q JOIN k ON k.s1 = q.s1 WHERE f > f0 AND n <= k", "prs"))
def _(s, d):
    return decide.emit(pairs(s, d).select("s1", "t", "p"), "expected_f", miss=0.05)


_BEST = f"best AS (SELECT t_emit, t_add, rel FROM ({ORACLES['k4_best_thresholds']}) LIMIT 1)"
_TUNED = "e AS (SELECT s1, t, p FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, t) AS r, max(p) OVER (PARTITION BY s1) AS b FROM prs), best WHERE b >= t_emit AND (r = 1 OR (p >= t_add AND p >= b * rel))), y AS (SELECT s1, t FROM prs WHERE label = 1), n AS (SELECT o.s1, country, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, coalesce(tp, 0) AS tp FROM own o LEFT JOIN (SELECT s1, count(*) AS np FROM e GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS nt FROM y GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS tp FROM e JOIN y USING (s1, t) GROUP BY s1) USING (s1))"


@query("d4_run_tune", sql(f"+{_BEST}, {_TUNED} SELECT country, {_METRICS}, (SELECT t_emit FROM best) AS t_emit, (SELECT t_add FROM best) AS t_add, (SELECT rel FROM best) AS rel FROM n GROUP BY country UNION ALL SELECT NULL, {_METRICS}, (SELECT t_emit FROM best), (SELECT t_add FROM best), (SELECT rel FROM best) FROM n", "prs", "own"))
def _(s, d):
    p = pairs(s, d)
    return decide.tune(p, p.where("label = 1").select("s1", "t"), owners(s, d), *_GRID)


_ASSIGNED = "a AS (SELECT s1, t, p FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, s1) AS r, lead(p) OVER (PARTITION BY t ORDER BY p DESC, s1) AS nx FROM prs) WHERE r = 1 AND round(p - coalesce(nx, 0), 9) >= 0.02 AND p > 0), e AS (SELECT s1, t FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, t) AS r, max(p) OVER (PARTITION BY s1) AS b FROM a) WHERE b >= 0.55::DOUBLE AND (r = 1 OR (p >= 0.75::DOUBLE AND p >= b * 0.7::DOUBLE)))"


@query("d5_run_predict", sql(f"+{_ASSIGNED} SELECT 'S1-' || o.s1 AS s1, coalesce(string_agg('S2-' || t, ',' ORDER BY 'S2-' || t), '') AS ids FROM own o LEFT JOIN e ON e.s1 = o.s1 GROUP BY o.s1", "prs", "own"))
def _(s, d):
    named = lambda side: lambda c: F.concat(F.lit(f"S{side}-"), c.cast("string"))
    return decide.predict(pairs(s, d), owners(s, d), margin=0.02, s1_id=named(1), t_id=named(2))


@query("d7_validate_files", "SELECT * FROM (VALUES ('matches', 'duplicate_id', 1), ('matches', 'self_match', 1), ('matches', 'bad_prefix', 1), ('matches', 'unknown_id', 1), ('matches', 'no_tab', 1), ('matches', 'missing_s1', (SELECT count(*) FROM nation) - 5), ('matches', 'unknown_s1', 1), ('matches', 'duplicate_row', 1), ('matches', 'not_in_candidates', 6), ('candidates', 'missing_s1', (SELECT count(*) FROM nation) - 1), ('broken', 'comma_separated', 1)) v(file, rule, n)")
def _(s, d):
    beyond = (table(s, d, "part").agg(F.max("p_partkey")).first()[0] or 0) + 1  # an id that isn't known, however large the table is
    rows = ["S1-0\tS2-1,S2-1", "S1-1\tS1-3", "S1-2\tX-1,S3-2", f"S1-3\tS2-{max(beyond, 999_999)}", "no tab here", "S1-4\t", "S1-4\tS2-2", "S1-77\tS2-3"]
    files = {"matches": (["source1_entity_id\tmatched_entity_ids", *rows], ["source1_entity_id", "matched_entity_ids"]), "candidates": (["source1_entity_id\tcandidate_entity_ids", "S1-0\tS2-1"], ["source1_entity_id", "candidate_entity_ids"]), "broken": (["source1_entity_id,matched_entity_ids", "S1-0,S2-1"], ["source1_entity_id", "matched_entity_ids"])}
    paths = {}
    for name, (lines, header) in files.items():
        paths[name] = (_scratch(s), header)
        s.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(paths[name][0])
    nation = table(s, d, "nation")
    known = table(s, d, "part").selectExpr("explode(array(concat('S2-', p_partkey), concat('S3-', p_partkey))) AS t")
    return decide.validate_files(s, paths, nation.selectExpr("concat('S1-', n_nationkey) AS s1"), known, ("matches", "candidates"))


@query("u5_vote_lists", sql("+r AS (SELECT 0 AS run, s1, list(t ORDER BY p DESC, t) AS l FROM prs WHERE p >= 0.6 GROUP BY s1 UNION ALL SELECT 1, s1, list(t ORDER BY t) FROM prs WHERE p >= 0.8 GROUP BY s1 UNION ALL SELECT 2, s1, list(t ORDER BY t DESC) FROM prs WHERE emb >= 0.05 GROUP BY s1), i AS (SELECT run, s1, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM r), v AS (SELECT s1, t, count(*) AS n, min(run * 1000 + pos) AS place FROM i GROUP BY ALL HAVING count(*) >= 2) SELECT o.s1, coalesce(string_agg(t::VARCHAR, ',' ORDER BY place), '') AS ids FROM own o LEFT JOIN v ON v.s1 = o.s1 GROUP BY o.s1", "prs", "own"))
def _(s, d):
    p, own = pairs(s, d), owners(s, d).select("s1")
    runs = [(p.where("p >= 0.6"), "named_struct('a', -p, 't', t)"), (p.where("p >= 0.8"), "named_struct('a', 0, 't', t)"), (p.where("emb >= 0.05"), "named_struct('a', -t, 't', t)")]
    made = [own.join(x.groupBy("s1").agg(F.expr(f"array_join(sort_array(collect_list({o})).t, ',')").alias("ids")), "s1", "left").na.fill("", ["ids"]) for x, o in runs]
    return decide.vote_lists(made, 2)


@query("d8_unseen_empty", sql("SELECT o.s1, CASE WHEN country <> 'c2' THEN coalesce(string_agg(t::VARCHAR, ',' ORDER BY t::VARCHAR), '') ELSE '' END AS ids, country = 'c2' AS unseen FROM own o LEFT JOIN (SELECT s1, t FROM prs WHERE p >= 0.9) e ON e.s1 = o.s1 GROUP BY o.s1, country", "prs", "own"))
def _(s, d):
    own = owners(s, d)
    out = tsv.id_lists(own, pairs(s, d).where("p >= 0.9").select("s1", F.col("t").cast("string").alias("t")), "ids")
    return reports.emptied(out, own, own.where("country <> 'c2'"))


# ---- reports ----------------------------------------------------------------------------------------------------------

_SETS = {f"union@{k}": f"(b4_rank BETWEEN 1 AND {k} OR b2w_rank BETWEEN 1 AND {k} OR b1_rank BETWEEN 1 AND {k} OR k_name = 1 OR k_house = 1)" for k in (5, 20)} | {f"{b}@{k}": f"{b}_rank BETWEEN 1 AND {k}" for b in ("b4", "b2w", "b1") for k in (5, 20)} | {k: f"{k} > 0" for k in ("k_name", "k_house")}
_RECALL = "round(sum(h) / greatest(sum(nt), 1), 6) AS pair_recall, round(avg(CASE WHEN nt > 0 THEN (h = nt)::INT END), 6) AS entity_recall, round(avg(CASE WHEN nt = 0 THEN 1 WHEN h = 0 THEN 0 ELSE 1.25::DOUBLE * (h / nt) / (0.25::DOUBLE + h / nt) END), 6) AS f05_ceiling, round(avg(nc), 6) AS mean_cands, max(nc) AS max_cands"
_REPORT = _POOL + f", v AS ({' UNION ALL '.join(f"SELECT s1, t, '{n}' AS variant FROM pool WHERE {c}" for n, c in _SETS.items())}), yy AS (SELECT s1, t FROM near WHERE (s1 + t) % 4 = 0), s AS (SELECT key AS s1, country FROM rec WHERE src = 1), h AS (SELECT v.s1, variant, count(*) AS nc, count(yy.s1) AS h FROM v LEFT JOIN yy ON yy.s1 = v.s1 AND yy.t = v.t GROUP BY ALL), n AS (SELECT s1, count(*) AS nt FROM yy GROUP BY s1), x AS (SELECT s.s1, country, w.variant, coalesce(nt, 0) AS nt, coalesce(nc, 0) AS nc, coalesce(h, 0) AS h FROM s CROSS JOIN (SELECT DISTINCT variant FROM v) w LEFT JOIN n ON n.s1 = s.s1 LEFT JOIN h ON h.s1 = s.s1 AND h.variant = w.variant) "


def _report(s, d, *by):
    pool = _pool(s, d)
    sets = reports.variants_of(pool, [5, 20], ["b4", "b2w", "b1"], ["k_name", "k_house"])
    return reports.recall(sets, pool.where("(s1 + t) % 4 = 0").select("s1", "t"), records(s, d).where("src = 1").selectExpr("key AS s1", "country"), *by)


@query("a10_recall_report", sql(_REPORT + f"SELECT variant, {_RECALL} FROM x GROUP BY variant", "rec"))
def _(s, d):
    return _report(s, d, "variant")


@query("a10_recall_by_country", sql(_REPORT + f"SELECT variant, country, {_RECALL} FROM x GROUP BY variant, country", "rec"))
def _(s, d):
    return _report(s, d, "variant", "country")


@query("a34_recall_eval", sql(f"+e AS ({ORACLES['j2_vector_topk']}), a AS (SELECT vec_id AS s1, label FROM embeddings WHERE vec_id % 5 = 0 AND md5(vec_id::VARCHAR) < 'c'), n AS (SELECT a.s1, 'g' || a.label AS country, count(b.vec_id) AS nt FROM a LEFT JOIN embeddings b ON b.vec_id % 5 <> 0 AND b.vec_id % 50 = a.s1 % 50 + 1 AND b.label = a.label GROUP BY ALL), x AS (SELECT n.*, coalesce(nc, 0) AS nc, coalesce(h, 0) AS h FROM n LEFT JOIN (SELECT s1, count(*) AS nc, count(*) FILTER (WHERE t % 50 = s1 % 50 + 1) AS h FROM e GROUP BY s1) z ON z.s1 = n.s1) SELECT country, {_RECALL} FROM x GROUP BY country", "own"))
def _(s, d):
    a, b = _vectors(s, d)
    asked = a.where(F.md5(F.col("s1").cast("string")) < "c")
    y = asked.select("s1", "grp").join(b.select("t", "grp"), "grp").where("t % 50 = s1 % 50 + 1").select("s1", "t")
    return reports.recall(blocking.vector_topk(asked, b, 30).select("s1", "t"), y, asked.selectExpr("s1", "concat('g', grp) AS country"), "country")


@query("a28_stress_slices", sql("""+y AS (SELECT s1, t FROM tru), n AS (SELECT s1, count(*) AS nt FROM y GROUP BY s1), w AS (SELECT z.*, rec.business_name, coalesce(nt, 0) AS nt, count(*) OVER (PARTITION BY z.name_core) AS same FROM nrm z JOIN rec ON rec.key = z.key LEFT JOIN n ON n.s1 = z.key WHERE z.src = 1),
j AS (SELECT y.s1, min(jaro_winkler_similarity(a.name_ascii, b.name_ascii)) AS jw FROM y JOIN nrm a ON a.key = y.s1 JOIN nrm b ON b.key = y.t GROUP BY y.s1), x AS (SELECT w.*, jw FROM w LEFT JOIN j ON j.s1 = w.key)
SELECT key, 'singleton' AS slice FROM x WHERE nt = 0 UNION ALL SELECT key, 'multi_match' FROM x WHERE nt >= 3 UNION ALL SELECT key, 'short_or_empty_address' FROM x WHERE len(list_filter(string_split(address_norm, ' '), lambda t: t <> '')) <= 3 UNION ALL SELECT key, 'landmark_only_address' FROM x WHERE address_core = '' AND landmark <> '' UNION ALL SELECT key, 'chain_name' FROM x WHERE same >= 5 UNION ALL SELECT key, 'name_has_digits' FROM x WHERE regexp_matches(business_name, '[0-9]') UNION ALL SELECT key, 'short_name' FROM x WHERE length(name_core) <= 6 UNION ALL SELECT key, 'hard_transliteration' FROM x WHERE jw < 0.85""", "rec", "tru", "nrm"))
def _(s, d):
    r, y = _normal(s, d), truth(s, d)
    x = features.gathered(y, r, ["name_ascii"])
    alike = x.select("s1", similarity.scorers()["jaro_winkler"]("a.name_ascii", "b.name_ascii").alias("jw"))
    return reports.slices(r.where("src = 1"), y, alike)


@query("a35_examples", sql("+e AS (SELECT s1, t FROM prs WHERE p >= 0.9), y AS (SELECT s1, t FROM prs WHERE label = 1), b AS (SELECT coalesce(e.s1, y.s1) AS s1, coalesce(e.t, y.t) AS t, CASE WHEN e.s1 IS NOT NULL AND y.s1 IS NOT NULL THEN 'TP' WHEN e.s1 IS NOT NULL THEN 'FP' ELSE 'missed' END AS status FROM e FULL JOIN y ON e.s1 = y.s1 AND e.t = y.t), k AS (SELECT DISTINCT s1 FROM b WHERE status <> 'TP' ORDER BY md5(s1::VARCHAR), s1 LIMIT 10) SELECT s1, t, status FROM b WHERE s1 IN (SELECT s1 FROM k)".replace("SELECT DISTINCT s1 FROM b WHERE status <> 'TP' ORDER BY md5(s1::VARCHAR), s1 LIMIT 10", "SELECT s1 FROM (SELECT DISTINCT s1 FROM b WHERE status <> 'TP') ORDER BY md5(s1::VARCHAR), s1 LIMIT 10"), "prs"))
def _(s, d):
    p = pairs(s, d)
    return reports.examples(p.where("p >= 0.9"), p.where("label = 1"), 10, F.md5(F.col("s1").cast("string")))


@query("a31_country_codes", "SELECT value, (dense_rank() OVER (ORDER BY value) - 1)::INT AS code FROM (SELECT n_name AS value FROM nation UNION SELECT r_name FROM region)")
def _(s, d):
    return reports.coded({"a": table(s, d, "nation").select(F.col("n_name").alias("v")), "b": table(s, d, "region").select(F.col("r_name").alias("v"))}, "v")


@query("a32_latest_run", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1")
def _(s, d):
    return reports.latest(table(s, d, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("a33_better_everywhere", sql("+x AS (SELECT country, avg(p) AS a, avg(p + emb) AS b FROM prs JOIN own USING (s1) GROUP BY country) SELECT bool_and(b > a) AS keep FROM x", "prs", "own"))
def _(s, d):
    x = pairs(s, d).join(owners(s, d), "s1").groupBy("country").agg(F.avg("p").alias("a"), F.avg(F.col("p") + F.col("emb")).alias("b"))
    return reports.better_everywhere(x.select("country", F.col("a").alias("recall")), x.select("country", F.col("b").alias("recall")))


# ---- sources and models -----------------------------------------------------------------------------------------------


@query("s5_load_normalized", sql("SELECT key, country, name_core, postal FROM nrm WHERE src > 1", "rec", "nrm"))
def _(s, d):
    """Sources written as tab-separated files, normalized on first use, and read again by the columns asked for."""
    base = _scratch(s)
    own = store.Settings(data=f"{base}/data", work=f"{base}/work")
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\t\n\r]", " ").alias(c)
    for n in (2, 3):
        tsv.write_tsv(records(s, d).where(f"src = {n}").select("entity_id", clean("business_name"), clean("business_address"), clean("country")), own.source("test", n))
    store.normalized(s, own, "test", "targets")
    return store.normalized(s, own, "test", "targets", ["key", "country", "name_core", "postal"])


@query("s6_by_country", "SELECT c_mktsegment AS country, count(*) AS n FROM customer GROUP BY ALL")
def _(s, d):
    path, key = _scratch(s), store.stamp({"table": "customer"})
    for _ in range(2):  # made once, then found
        out = store.made(s, path, key, lambda: table(s, d, "customer").withColumnRenamed("c_mktsegment", "country"), ("country",))
    return out.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query("s11_json", "SELECT round(avg(l_discount), 6) AS t_emit, count(*) AS n FROM lineitem")
def _(s, d):
    """Side data of a stage: made from a table, written as JSON, read again."""
    path, made = _scratch(s), table(s, d, "lineitem").agg(F.round(F.avg("l_discount"), 6).alias("t_emit"), F.count(F.lit(1)).alias("n")).first()
    store.write_json(s, path, made.asDict())
    got = store.read_json(s, path)
    return s.createDataFrame([(got["t_emit"], got["n"])], "t_emit double, n long")


_LANDS = ["US", "India", "France"]


def _ids(s, d) -> DataFrame:
    return table(s, d, "customer").selectExpr("c_custkey AS id")


@query("s13_synthetic")
def _(s, d):
    """Sources with noisy copies, a business for each customer; without SQL: s13_businesses has it for what they are made from."""
    s1, targets, lists_ = synthetic.sources(_ids(s, d), _LANDS)
    return s1.withColumn("side", F.lit("s1")).unionByName(targets.withColumn("side", F.lit("targets")))


def _drawn(salt: int) -> str:
    return f"('0x' || substr(md5('{salt}:' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def _picked(names: list[str], salt: int) -> str:
    return f"({names})[floor({_drawn(salt)} * {len(names)})::INT + 1]"


def _landed(entries: dict[str, list[str]], salt: int) -> str:
    return "CASE country " + " ".join(f"WHEN '{k}' THEN {_picked(v, salt)}" for k, v in entries.items()) + " END"


def _capital(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


@query("s13_businesses", f"WITH c AS (SELECT c_custkey AS id FROM customer), b AS (SELECT id, {_picked(_LANDS, 1)} AS country FROM c) SELECT id, country, {_capital(_picked(synthetic.FIRST, 2))} || ' ' || {_capital(_picked(synthetic.SECOND, 3))} || ' ' || {_capital(_picked(synthetic.TRADE, 4))} AS name, {_landed(synthetic.LEGAL, 5)} AS legal, (1 + floor({_drawn(6)} * 999))::BIGINT::VARCHAR AS house, {_capital(_picked(synthetic.SECOND, 7))} AS street, {_landed(synthetic.STREET, 8)} AS kind, {_capital(_picked(synthetic.FIRST, 9))} || 'ville' AS town, (10000 + floor({_drawn(10)} * 90000))::INT::VARCHAR AS postal FROM b")
def _(s, d):
    return synthetic.businesses(_ids(s, d), _LANDS)


@query("p32_stress_rewrites")
def _(s, d):
    """The records of all sources rewritten; without SQL: golden cases are in tests/test_stress.py."""
    side = F.when(F.col("src") == 1, "S1").otherwise("T").alias("side")
    return stress.french_records(spread(records(s, d)).select("entity_id", side, "business_name", "business_address")).drop("orig_name", "orig_address")


@query("x_stream_two_best", sql("SELECT s1, t, p AS score FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, s1) AS r FROM prs) WHERE r <= 2", "prs"))
def _(s, d):
    return competition.two_best(pairs(s, d).select("s1", "t", F.col("p").alias("score")))
