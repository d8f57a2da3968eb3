"""One query for each operator, over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import ids, indic, similarity, tables, text
from quillmark.operators import blocking, checks, decide, lists, models, tokens
from quillmark.plans.views import owners, pairs, records, spread, sql, table, truth
from quillmark.sources import tsv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "flagship_block_decide_f05"


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _r(col: str):
    return F.round(col, 6).alias(col)


def _tokens(s, d) -> DataFrame:
    return tokens.token_table(records(s, d).withColumn("low", F.lower("business_name")), "key", "low", "country")


def _scratch(s) -> str:
    """A new path in the folder that driver and executors share; in one process on one machine (tests) a temporary one serves."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base and s.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='quillmark-')}/scratch/{uuid.uuid4().hex}"


TOK = "SELECT DISTINCT key, country, token FROM tok WHERE token <> ''"

# ---- scans, sinks, ids ------------------------------------------------------------------------------------------------


@query("s1_tsv_roundtrip", sql("SELECT entity_id, c_name AS business_name, c_mktsegment AS business_address, 'n' || c_nationkey AS country FROM (SELECT 'S' || (1 + c_custkey % 3) || '-' || c_custkey AS entity_id, * FROM customer)", "own"))
def _(s, d):
    path = _scratch(s)
    tsv.write_tsv(table(s, d, "customer").selectExpr("concat('S', 1 + c_custkey % 3, '-', c_custkey) AS entity_id", "c_name AS business_name", "c_mktsegment AS business_address", "concat('n', c_nationkey) AS country"), path)
    return tsv.read_tsv(s, path, tsv.RECORD)


@query("s4_cached_projection", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def _(s, d):
    return tsv.cache(table(s, d, "customer"), _scratch(s)).where("c_acctbal > 0").select("c_custkey", "c_name")


@query("s7_id_list_sink", sql("SELECT key AS s1, coalesce(string_agg(DISTINCT 'S' || (t // 10000000000) || '-' || (t % 10000000000), ',' ORDER BY 'S' || (t // 10000000000) || '-' || (t % 10000000000)), '') AS matched_entity_ids FROM rec LEFT JOIN tru ON key = s1 GROUP BY key", "rec", "tru"))
def _(s, d):
    return tsv.id_lists(records(s, d).select(F.col("key").alias("s1")), truth(s, d).select("s1", ids.id_of(F.col("t")).alias("t")))


@query("l1_explode_lists", sql("SELECT s1, 'S' || (t // 10000000000) || '-' || (t % 10000000000) AS t FROM tru", "rec", "tru"))
def _(s, d):
    return tsv.explode_lists(QUERIES["s7_id_list_sink"](s, d), "s1", "matched_entity_ids")


@query("p20_id_keys", sql("SELECT entity_id, key AS id_key, entity_id AS back FROM rec", "rec"))
def _(s, d):
    k = records(s, d).select("entity_id", ids.key_of(F.col("entity_id")).alias("id_key"))
    return k.withColumn("back", ids.id_of(F.col("id_key")))


def _draw(key: str, salt: int) -> str:
    return f"('0x' || substr(md5('{salt}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query("p22_roles_hash", sql(f"SELECT key, CASE WHEN {_draw('key', 7)} < 0.15 THEN 2 WHEN {_draw('key', 8)} < 0.5 THEN 1 WHEN {_draw('key', 8)} < 0.8 THEN 3 ELSE 0 END AS role FROM rec", "rec"))
def _(s, d):
    return records(s, d).select("key", ids.role(F.col("key"), 0.15, 0.5, 0.3, 7).alias("role"))


@query("k9_group_folds", sql(f"SELECT key, floor({_draw('key', 99)} * 5)::INT AS fold FROM rec", "rec"))
def _(s, d):
    return records(s, d).select("key", ids.fold(F.col("key"), 5).alias("fold"))


@query("k6_hash_sample", sql(f"SELECT key FROM rec ORDER BY {_draw('key', 3)}, key LIMIT 100", "rec"))
def _(s, d):
    return records(s, d).orderBy(ids.draw(F.col("key"), 3), "key").limit(100).select("key")


@query("p21_hash_uniform", sql("""+z AS (SELECT key, ((key::HUGEINT + 1663341875487337577) % 18446744073709551616)::UBIGINT AS z FROM rec),
z1 AS (SELECT key, xor(z, z >> 30) AS z FROM z), z2 AS (SELECT key, ((((z & 4294967295)::HUGEINT * 13787848793156543929) % 18446744073709551616 + (((z >> 32)::HUGEINT * (13787848793156543929 % 4294967296)) % 4294967296) * 4294967296) % 18446744073709551616)::UBIGINT AS z FROM z1),
z3 AS (SELECT key, xor(z, z >> 27) AS z FROM z2), z4 AS (SELECT key, ((((z & 4294967295)::HUGEINT * 10723151780598845931) % 18446744073709551616 + (((z >> 32)::HUGEINT * (10723151780598845931 % 4294967296)) % 4294967296) * 4294967296) % 18446744073709551616)::UBIGINT AS z FROM z3)
SELECT key, (xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM z4""", "rec"))
def _(s, d):
    return records(s, d).select("key", ids.splitmix(F.col("key"), 4).alias("u"))


@query("s2_count_data_lines", "SELECT count(*) AS n FROM customer")
def _(s, d):
    path = _scratch(s)
    tsv.write_tsv(table(s, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS entity_id", "c_name").coalesce(1), path)
    return s.createDataFrame([(tsv.count_data_lines(s, path),)], "n long")


@query("l1_stray_tokens", "SELECT s1, CASE WHEN ids = '' THEN 0 ELSE len(list_filter(string_split(ids, ','), lambda t: t = ''))::INT END AS stray FROM (SELECT doc_id AS s1, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'S2-' || doc_id || ',,S3-1' WHEN 2 THEN ',' ELSE 'S2-1' END AS ids FROM documents)")
def _(s, d):
    x = table(s, d, "documents").selectExpr("doc_id AS s1", "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('S2-', doc_id, ',,S3-1') WHEN 2 THEN ',' ELSE 'S2-1' END AS ids")
    return x.select("s1", tsv.stray_tokens(F.col("ids")).alias("stray"))


# ---- text -------------------------------------------------------------------------------------------------------------

def _normal(s, d) -> DataFrame:
    return text.normalize(spread(records(s, d)))


#: Latin letters that all of five scripts have, with their places in a script's block.
_PLACES = {"a": 0x05, "i": 0x07, "u": 0x09, "e": 0x0F, "o": 0x13, "k": 0x15, "g": 0x17, "c": 0x1A, "j": 0x1C, "t": 0x24, "d": 0x26, "n": 0x28, "p": 0x2A, "b": 0x2C, "m": 0x2E, "y": 0x2F, "r": 0x30, "l": 0x32, "s": 0x38, "h": 0x39}
_SCRIPTS = ["devanagari", "bengali", "gujarati", "telugu", "kannada"]


@query("p1_indic_scripts", f"SELECT p_partkey, script, lower(p_name) AS back FROM part, (SELECT unnest({_SCRIPTS}) AS script)")
def _(s, d):
    """Names written in the letters of five scripts, and read back."""
    x = table(s, d, "part").select("p_partkey", F.lower("p_name").alias("n"), F.explode(F.array(*map(F.lit, _SCRIPTS))).alias("script"))
    written = reduce(lambda out, k: F.when(F.col("script") == k, F.translate("n", "".join(_PLACES), "".join(chr(indic.SCRIPTS[k][0] + p) for p in _PLACES.values()))).otherwise(out), _SCRIPTS, F.col("n"))
    return x.select("p_partkey", "script", text.ascii_lower(written).alias("back"))


@query("p7_name_ascii", sql("SELECT key, name_ascii FROM nrm", "rec", "nrm"))
def _(s, d):
    return spread(records(s, d)).select("key", text.name_ascii(F.col("business_name")).alias("name_ascii"))


@query("p11_name_core", sql("SELECT key, name_core FROM nrm", "rec", "nrm"))
def _(s, d):
    return _normal(s, d).select("key", "name_core")


@query("p10_legal_forms", sql("SELECT key, legal_form FROM nrm", "rec", "nrm"))
def _(s, d):
    return _normal(s, d).select("key", "legal_form")


@query("p14_numbers", "SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(props, '\\d+'), lambda t: CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END))), ' ') AS numbers FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", text.numbers(F.col("props")).alias("numbers"))


@query("p12_house_no", sql("SELECT key, house_no FROM nrm", "rec", "nrm"))
def _(s, d):
    return _normal(s, d).select("key", "house_no")


@query("p13_postal", sql("SELECT key, postal FROM nrm", "rec", "nrm"))
def _(s, d):
    return _normal(s, d).select("key", "postal")


@query("p25_acronym", sql("+w AS (SELECT key, list_filter(string_split(name_core, ' '), lambda t: t <> '') AS ws FROM nrm) SELECT key, CASE WHEN len(ws) >= 2 THEN array_to_string(list_transform(ws, lambda t: t[1]), '') ELSE '' END AS acronym, array_to_string(ws, '') AS compact FROM w", "rec", "nrm"))
def _(s, d):
    n = F.col("name_core")
    return _normal(s, d).select("key", text.acronym(n).alias("acronym"), F.replace(n, F.lit(" "), F.lit("")).alias("compact"))


_VIEWS = ["key", "country", "name_ascii", "name_core", "legal_form", "address_norm", "address_core", "landmark", "house_no", "postal", "numbers"]


@query("p19_normalize_frame", sql(f"SELECT {', '.join(_VIEWS)} FROM nrm", "rec", "nrm"))
def _(s, d):
    return _normal(s, d).select(_VIEWS)


@query("p29_logit_adjust", sql("SELECT s1, t, round(1 / (1 + exp(-(1.2 * ln(q / (1 - q)) - 0.1))), 6) AS q FROM (SELECT s1, t, greatest(least(p, 0.999999), 0.000001) AS q FROM prs)", "prs"))
def _(s, d):
    return pairs(s, d).select("s1", "t", F.round(decide.logit_adjust(F.col("p"), 1.2, -0.1), 6).alias("q"))


# ---- similarity -------------------------------------------------------------------------------------------------------

_NEAR = "+x AS (SELECT a.key AS s1, b.key AS t, a.business_name AS na, b.business_name AS nb FROM rec a JOIN rec b ON a.country = b.country AND a.src = 1 AND b.src > 1 AND a.doc_id // 10 = b.doc_id // 10) "


def _near(s, d) -> DataFrame:
    r = records(s, d)
    a = r.where("src = 1").selectExpr("key AS s1", "business_name AS na", "country", "doc_id div 10 AS g")
    b = r.where("src > 1").selectExpr("key AS t", "business_name AS nb", "country", "doc_id div 10 AS g")
    return a.join(b, ["country", "g"]).select("s1", "t", "na", "nb")


#: DuckDB measures bytes: a control character, which no text holds, stands for each accented letter of the tables.
_LETTERS = "àâäçèéêëíîïñóôöùûúüÀÄÇÈÉÊÍÑÓÖÜßáÁ"[:31]
_BYTES = f"translate({{0}}, '{_LETTERS}', {' || '.join(f'chr({i})' for i in [*range(1, 9), *range(11, 13), *range(14, 32), 127, 64, 94][: len(_LETTERS)])})"


@query("f6_levenshtein", sql(_NEAR + f"SELECT s1, t, round(CASE WHEN greatest(length(na), length(nb)) = 0 THEN 1 ELSE 1 - levenshtein({_BYTES.format('na')}, {_BYTES.format('nb')}) / greatest(length(na), length(nb)) END, 6) AS lev FROM x", "rec"))
def _(s, d):
    return _near(s, d).select("s1", "t", F.round(similarity.levenshtein_similarity(F.col("na"), F.col("nb")), 6).alias("lev"))


@query("f5_jaro_winkler", sql(_NEAR + f"SELECT s1, t, round(jaro_winkler_similarity({_BYTES.format('na')}, {_BYTES.format('nb')}), 6) AS jw FROM x", "rec"))
def _(s, d):
    return _near(s, d).select("s1", "t", F.round(similarity.scorers()["jaro_winkler"]("na", "nb"), 6).alias("jw"))


@query("f1_f4_fuzzy_ratios")
def _(s, d):
    k = similarity.scorers()
    return _near(s, d).select("s1", "t", *(F.round(k[n]("na", "nb"), 6).alias(n) for n in ("ratio", "token_sort", "token_set", "partial")))


#: Common subsequences in SQL: one row of the table for each character of the longer text. The best entry of a row up to a place is at the character's last place before it.
_LCS = """c AS (SELECT a, b, list_transform(string_split(CASE WHEN length(a) < length(b) THEN a ELSE b END, ''), lambda x: unicode(x)) AS p, list_transform(string_split(CASE WHEN length(a) < length(b) THEN b ELSE a END, ''), lambda x: [unicode(x)]) AS q FROM (SELECT DISTINCT a, b FROM asked WHERE a <> '' AND b <> '')),
e AS (SELECT a, b, list_last(list_reduce(list_prepend(list_transform(range(0, len(p) + 1), lambda x: 0), q), lambda row, y: list_transform(range(1, len(p) + 2), lambda i: greatest(row[i], coalesce(row[i - list_position(list_reverse(p[1:i - 1]), y[1])] + 1, 0))))) AS lcs FROM c)"""
_SETS = """w AS (SELECT s1, t, na, nb, list_sort(list_filter(string_split_regex(na, '\\s+'), lambda x: x <> '')) AS sa, list_sort(list_filter(string_split_regex(nb, '\\s+'), lambda x: x <> '')) AS sb FROM (SELECT s1, t, coalesce(na, '') AS na, coalesce(nb, '') AS nb FROM x)),
v AS (SELECT *, array_to_string(sa, ' ') AS ja, array_to_string(sb, ' ') AS jb, array_to_string(list_sort(list_distinct(list_filter(sa, lambda z: list_contains(sb, z)))), ' ') AS i, array_to_string(list_sort(list_distinct(list_filter(sa, lambda z: NOT list_contains(sb, z)))), ' ') AS l, array_to_string(list_sort(list_distinct(list_filter(sb, lambda z: NOT list_contains(sa, z)))), ' ') AS r FROM w),
u AS (SELECT *, trim(i || ' ' || l) AS il, trim(i || ' ' || r) AS ir FROM v), asked AS (SELECT na AS a, nb AS b FROM u UNION SELECT ja, jb FROM u UNION SELECT il, ir FROM u UNION SELECT i, il FROM u UNION SELECT i, ir FROM u)"""


def _ratio_sql(a: str, b: str, k: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * coalesce({k}.lcs, 0) / (length({a}) + length({b})) END"


_ASKED = {"r": ("na", "nb"), "o": ("ja", "jb"), "p": ("il", "ir"), "m": ("i", "il"), "n": ("i", "ir")}


@query("f1_f3_ratios", sql(_NEAR + f", {_SETS}, {_LCS} SELECT s1, t, round({_ratio_sql('na', 'nb', 'r')}, 6) AS ratio, round({_ratio_sql('ja', 'jb', 'o')}, 6) AS token_sort, round(CASE WHEN ja = '' OR jb = '' THEN 0.0::DOUBLE WHEN i <> '' AND (l = '' OR r = '') THEN 100.0::DOUBLE ELSE greatest({_ratio_sql('il', 'ir', 'p')}, CASE WHEN i <> '' THEN greatest({_ratio_sql('i', 'il', 'm')}, {_ratio_sql('i', 'ir', 'n')}) ELSE 0 END) END, 6) AS token_set FROM u " + " ".join(f"LEFT JOIN e {k} ON {k}.a = u.{a} AND {k}.b = u.{b}" for k, (a, b) in _ASKED.items()), "rec"))
def _(s, d):
    k = similarity.scorers()
    return _near(s, d).select("s1", "t", *(F.round(k[n]("na", "nb"), 6).alias(n) for n in ("ratio", "token_sort", "token_set")))


@query("f8_f10_flags", sql(_NEAR + "SELECT s1, t, CASE WHEN na <> '' AND nb <> '' THEN (na = nb)::INT END AS eq, round(least(length(na), length(nb)) / greatest(length(na), length(nb), 1), 6) AS len_ratio FROM x", "rec"))
def _(s, d):
    a, b = F.col("na"), F.col("nb")
    return _near(s, d).select("s1", "t", similarity.same_state(a, b).alias("eq"), F.round(similarity.length_ratio(a, b), 6).alias("len_ratio"))


# ---- tokens -----------------------------------------------------------------------------------------------------------


@query("a1_doc_freq", sql(f"SELECT token, count(*) AS df FROM ({TOK}) GROUP BY token", "rec", "tok"))
def _(s, d):
    return tokens.doc_freq(_tokens(s, d))


@query("a2_idf", sql(f"SELECT token, count(*) AS df, round(ln((SELECT count(*) FROM rec) / count(*)), 6) AS idf FROM ({TOK}) GROUP BY token", "rec", "tok"))
def _(s, d):
    return tokens.idf(_tokens(s, d), records(s, d).agg(F.count(F.lit(1)).alias("n"))).select("token", "df", _r("idf"))


def _by_country(s, d) -> DataFrame:
    return tokens.idf(_tokens(s, d), records(s, d).groupBy("country").agg(F.count(F.lit(1)).alias("n")), "country")


_IDFC = f"+i AS (SELECT k.country, token, count(*) AS df, ln(any_value(n) / count(*)) AS idf FROM ({TOK}) k JOIN (SELECT country, count(*) AS n FROM rec GROUP BY country) c ON k.country = c.country GROUP BY k.country, token) "


@query("a3_idf_country", sql(_IDFC + "SELECT country, token, df, round(idf, 6) AS idf FROM i", "rec", "tok"))
def _(s, d):
    return _by_country(s, d).select("country", "token", "df", _r("idf"))


@query("a4_mass", sql(_IDFC + f"SELECT key, round(sum(idf), 6) AS mass FROM ({TOK}) k JOIN i ON k.country = i.country AND k.token = i.token GROUP BY key", "rec", "tok"))
def _(s, d):
    return tokens.mass(_tokens(s, d), _by_country(s, d), "key", "country").select("key", _r("mass"))


@query("a6_overlap", sql(_IDFC + f"""
, w AS (SELECT key, k.token, idf FROM ({TOK}) k JOIN i ON k.country = i.country AND k.token = i.token), m AS (SELECT key, sum(idf) AS mass, count(*) AS n FROM w GROUP BY key),
c AS (SELECT p.s1, p.t, count(w2.token) AS n, coalesce(sum(w1.idf) FILTER (WHERE w2.token IS NOT NULL), 0) AS sh, max(w1.idf) FILTER (WHERE w2.token IS NOT NULL) AS mx, max(w1.idf) FILTER (WHERE w2.token IS NULL) AS un
  FROM tru p JOIN w w1 ON w1.key = p.s1 LEFT JOIN w w2 ON w2.key = p.t AND w2.token = w1.token AND w2.idf = w1.idf GROUP BY p.s1, p.t)
SELECT c.s1, c.t, c.n::INT AS n_shared, abs(m1.n - m2.n)::INT AS token_diff, round(sh / greatest(m1.mass + m2.mass - sh, 1e-6), 6) AS idf_jacc, round(sh / greatest(m1.mass, 1e-6), 6) AS idf_cover_s1, round(coalesce(mx, 0), 6) AS max_shared_idf, round(coalesce(un, 0), 6) AS max_unmatched_idf_s1
FROM c JOIN m m1 ON m1.key = c.s1 JOIN m m2 ON m2.key = c.t""", "rec", "tru", "tok"))
def _(s, d):
    w = _tokens(s, d).join(_by_country(s, d), ["country", "token"]).select("key", "token", "idf")
    return tokens.overlap(truth(s, d), w).select("s1", "t", "n_shared", "token_diff", _r("idf_jacc"), _r("idf_cover_s1"), _r("max_shared_idf"), _r("max_unmatched_idf_s1"))


@query("a7_name_frequency", "SELECT p_partkey, count(*) FILTER (WHERE p_partkey % 3 = 0) OVER (PARTITION BY p_brand, p_name) AS n_s1, count(*) FILTER (WHERE p_partkey % 3 <> 0) OVER (PARTITION BY p_brand, p_name) AS n_t FROM part")
def _(s, d):
    return tokens.name_frequency(table(s, d, "part").withColumn("side", F.col("p_partkey") % 3 == 0), "p_brand", "p_name", "side").select("p_partkey", "n_s1", "n_t")


_RARE = f"+k AS ({TOK}), r AS (SELECT key, k.token, row_number() OVER (PARTITION BY key ORDER BY df, k.token) AS rn FROM k JOIN (SELECT token, count(*) AS df FROM k GROUP BY token) f ON k.token = f.token), rr AS (SELECT key, max(token) FILTER (WHERE rn = 1) AS r1, max(token) FILTER (WHERE rn = 2) AS r2 FROM r WHERE rn <= 2 GROUP BY key) "


@query("a8_rare_tokens", sql(_RARE + "SELECT * FROM rr", "rec", "tok"))
def _(s, d):
    return tokens.rare_tokens(_tokens(s, d), "key")


# ---- blocking ---------------------------------------------------------------------------------------------------------


def _topk_sql(gram: str, max_df: float, top_m: int, k: int) -> str:
    return f"""+g AS (SELECT key, country, src = 1 AS is_s1, gram, count(*) AS tf FROM (SELECT key, country, src, unnest({gram}) AS gram FROM rec) GROUP BY ALL),
f AS (SELECT gram, count(*) AS df FROM g GROUP BY gram), n AS (SELECT count(*)::DOUBLE AS n FROM rec),
w0 AS (SELECT g.*, ln((1 + n) / (1 + df)) + 1 AS idf, tf * (ln((1 + n) / (1 + df)) + 1) AS w, df <= n * {max_df} AS usable FROM g JOIN f ON g.gram = f.gram CROSS JOIN n),
w1 AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS u FROM w0), w2 AS (SELECT * FROM w1 WHERE usable),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idf DESC, gram) AS rn FROM w2 WHERE is_s1) WHERE rn <= {top_m}),
s AS (SELECT q.key AS s1, b.key AS t, round(sum(q.u * b.u), 6) AS score FROM q JOIN w2 b ON q.country = b.country AND q.gram = b.gram AND NOT b.is_s1 GROUP BY ALL HAVING round(sum(q.u * b.u), 6) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, t) AS rank FROM s) SELECT s1, t, score, rank FROM r WHERE rank <= {k}"""


def _blocker(s, d, kind: str, max_df: float, top_m: int, k: int) -> DataFrame:
    return blocking.tfidf_topk(records(s, d).selectExpr("key", "country", "src = 1 AS is_s1", "lower(business_name) AS low"), "low", kind, max_df, top_m, k, _kept(s))


def _kept(s):
    """Writes a table that is read several times."""
    return lambda x: tsv.cache(x, _scratch(s))


@query("j1_word_topk", sql(_topk_sql("list_filter(regexp_split_to_array(lower(business_name), '\\s+'), lambda t: t <> '')", 0.1, 8, 20), "rec"))
def _(s, d):
    return _blocker(s, d, "word", 0.1, 8, 20)


@query("j1_char3_topk", sql(_topk_sql("list_transform(range(1, length(lower(business_name)) - 1), lambda i: substr(lower(business_name), i, 3))", 0.02, 12, 5), "rec"))
def _(s, d):
    return _blocker(s, d, "char3", 0.02, 12, 5)


@query("j1_char_wb_topk")
def _(s, d):
    return _blocker(s, d, "char_wb", 0.02, 12, 5)


_VEC = "+a AS (SELECT vec_id AS s1, label, embedding AS v FROM embeddings WHERE vec_id % 5 = 0), b AS (SELECT vec_id AS t, label, embedding AS w FROM embeddings WHERE vec_id % 5 <> 0), s AS (SELECT s1, t, round(list_sum(list_transform(list_zip(v, w), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score FROM a JOIN b ON a.label = b.label)"


def _vectors(s, d):
    e = table(s, d, "embeddings").withColumnRenamed("label", "grp")
    return e.where("vec_id % 5 = 0").selectExpr("vec_id AS s1", "grp", "embedding AS v"), e.where("vec_id % 5 <> 0").selectExpr("vec_id AS t", "grp", "embedding AS w")


@query("j2_vector_topk", sql(_VEC + " SELECT s1, t, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, t) AS rank FROM s) WHERE rank <= 30", "own"))
def _(s, d):
    return blocking.vector_topk(*_vectors(s, d), 30)


@query("j3_reverse_top2", sql(_VEC + ", r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, s1) AS rn FROM s) SELECT b.t, coalesce(max(score) FILTER (WHERE rn = 1), -1) AS best, max(r.s1) FILTER (WHERE rn = 1) AS best_s1, coalesce(max(score) FILTER (WHERE rn = 2), -1) AS second FROM b LEFT JOIN r ON b.t = r.t AND rn <= 2 GROUP BY b.t", "own"))
def _(s, d):
    return blocking.reverse_top2(*_vectors(s, d))


_KEYS = _RARE + ", kk AS (SELECT rec.key, src, business_name AS bn, country || '|' || business_name AS key_name, country || '|' || least(r1, r2) || '|' || greatest(r1, r2) AS key_rare2, r1, r2 FROM rec LEFT JOIN rr ON rec.key = rr.key) "


def _keys(s, d) -> DataFrame:
    k = blocking.block_keys()
    r = records(s, d).join(tokens.rare_tokens(_tokens(s, d), "key"), "key", "left").withColumn("name_core", F.col("business_name"))
    return r.select("key", "src", k["k_name"].alias("key_name"), k["k_rare2"].alias("key_rare2"))


_FOUR = """+k AS (SELECT DISTINCT key, unnest(list_filter(string_split(name_core, ' '), lambda t: t <> '')) AS token FROM nrm), r AS (SELECT key, k.token, row_number() OVER (PARTITION BY key ORDER BY df, k.token) AS rn FROM k JOIN (SELECT token, count(*) AS df FROM k GROUP BY token) f ON k.token = f.token),
rr AS (SELECT key, max(token) FILTER (WHERE rn = 1) AS r1, max(token) FILTER (WHERE rn = 2) AS r2 FROM r WHERE rn <= 2 GROUP BY key), w AS (SELECT n.*, r1, r2, regexp_extract(address_core, '^\\D*\\d\\S*(?:\\s+\\S{1,2}|\\s+\\S*\\d\\S*)*\\s+([a-z]{3,})', 1) AS street_word FROM nrm n LEFT JOIN rr ON n.key = rr.key),
f AS (SELECT key, src, country, CASE WHEN name_core <> '' THEN concat_ws('|', country, name_core) END AS k_name, CASE WHEN postal <> '' AND r1 IS NOT NULL THEN concat_ws('|', country, postal, r1) END AS k_postal, CASE WHEN house_no <> '' AND street_word <> '' THEN concat_ws('|', country, house_no, street_word) END AS k_house, CASE WHEN r2 IS NOT NULL THEN concat_ws('|', country, least(r1, r2), greatest(r1, r2)) END AS k_rare2 FROM w) """


def _named_rows(s, d) -> DataFrame:
    """Normalized records without their addresses, as a table: keys and their words read it several times."""
    r = _normal(s, d).withColumn("street_word", text.street_word(F.col("address_core")))
    return _kept(s)(r.select("key", "src", "country", "name_core", "name_ascii", "postal", "house_no", "street_word"))


def _four_keys(s, d, rows: DataFrame | None = None) -> DataFrame:
    r = _named_rows(s, d) if rows is None else rows
    rare = tokens.rare_tokens(tokens.token_table(r, "key", "name_core", "country"), "key")
    return r.join(rare, "key", "left").select("key", "src", "country", *(k.alias(name) for name, k in blocking.block_keys().items()))


@query("j5_block_keys", sql(_FOUR + "SELECT key, src, k_name, k_postal, k_house, k_rare2 FROM f", "rec", "nrm"))
def _(s, d):
    return _four_keys(s, d).drop("country")


@query("p27_street_word", sql(_FOUR + "SELECT key, street_word FROM w", "rec", "nrm"))
def _(s, d):
    return _normal(s, d).select("key", text.street_word(F.col("address_core")).alias("street_word"))


def _blocked(s, d, name: str, cap: int) -> DataFrame:
    k = _keys(s, d).withColumnRenamed(name, "bk")
    return blocking.key_block_pairs(k.where("src = 1").selectExpr("key AS s1", "bk AS key"), k.where("src > 1").selectExpr("key AS t", "bk AS key"), cap)


@query("j4_key_block", sql(_KEYS + ", tt AS (SELECT *, count(*) OVER (PARTITION BY key_rare2) AS n FROM kk WHERE src > 1 AND r2 IS NOT NULL) SELECT a.key AS s1, b.key AS t FROM kk a JOIN tt b ON a.key_rare2 = b.key_rare2 AND a.src = 1 AND a.r2 IS NOT NULL AND b.n <= 20", "rec", "tok"))
def _(s, d):
    return _blocked(s, d, "key_rare2", 20)


def _sides(s, d, name: str) -> tuple[DataFrame, DataFrame]:
    k = _keys(s, d).withColumnRenamed(name, "bk")
    return k.where("src = 1").selectExpr("key AS s1", "bk AS key"), k.where("src > 1").selectExpr("key AS t", "bk AS key")


@query("j4_keys_left_out", sql(_KEYS + ", n AS (SELECT key_rare2 AS key, (count(*) FILTER (WHERE src = 1))::BIGINT AS n_s1, (count(*) FILTER (WHERE src > 1))::BIGINT AS n_t FROM kk WHERE r2 IS NOT NULL GROUP BY key_rare2) SELECT *, n_s1 * n_t AS n_pairs FROM n WHERE n_t > 2 AND n_s1 > 0", "rec", "tok"))
def _(s, d):
    return blocking.key_block_left_out(*_sides(s, d, "key_rare2"), 2)


@query("j4_key_block_rest", sql(_KEYS + ", tt AS (SELECT *, count(*) OVER (PARTITION BY key_rare2) AS n FROM kk WHERE src > 1 AND r2 IS NOT NULL) SELECT a.key AS s1, b.key AS t FROM kk a JOIN tt b ON a.key_rare2 = b.key_rare2 AND a.src = 1 AND a.r2 IS NOT NULL AND b.n > 20", "rec", "tok"))
def _(s, d):
    return blocking.key_block_rest(*_sides(s, d, "key_rare2"), 20, 4096, _kept(s))


@query("j6_pool_union", "WITH a AS (SELECT l_orderkey AS s1, l_partkey AS t, max(l_quantity) AS sc, min(l_linenumber) AS rk FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), b AS (SELECT l_orderkey AS s1, l_partkey AS t, max(l_tax) AS sc, min(l_linenumber) AS rk FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL), k AS (SELECT DISTINCT l_orderkey AS s1, l_partkey AS t FROM lineitem WHERE l_returnflag = 'R') SELECT s1, t, a.sc AS w_score, b.sc AS v_score, coalesce(a.rk, 0)::INT AS w_rank, coalesce(b.rk, 0)::INT AS v_rank, (k1 IS NOT NULL)::INT AS k_name FROM a FULL JOIN b USING (s1, t) FULL JOIN (SELECT *, 1 AS k1 FROM k) k USING (s1, t)")
def _(s, d):
    li = table(s, d, "lineitem").withColumnsRenamed({"l_orderkey": "s1", "l_partkey": "t"})
    agg = lambda x, v: x.groupBy("s1", "t").agg(F.max(v).alias("score"), F.min("l_linenumber").cast("int").alias("rank"))
    return blocking.union_pool({"w": agg(li.where("l_linenumber <= 3"), "l_quantity"), "v": agg(li.where("l_linenumber >= 2"), "l_tax")}, {"k_name": li.where("l_returnflag = 'R'").select("s1", "t").distinct()})


@query("p31_in_candidate_set", "WITH x AS (" + ORACLES["j6_pool_union"] + ") SELECT * FROM x WHERE w_rank BETWEEN 1 AND 1 OR v_rank BETWEEN 1 AND 2 OR k_name = 1")
def _(s, d):
    return QUERIES["j6_pool_union"](s, d).where(blocking.in_candidate_set({"w": 1, "v": 2}, ["k_name"]))


_RANKS = "+r0 AS (SELECT s1, t, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, t) AS ar, row_number() OVER (PARTITION BY s1 ORDER BY emb DESC, t) AS br FROM prs), a AS (SELECT s1, t, ar FROM r0 WHERE ar <= 3), b AS (SELECT s1, t, br FROM r0 WHERE br <= 3), rk AS (SELECT s1, t, coalesce(ar, 0) AS a_rank, coalesce(br, 0) AS b_rank FROM a FULL JOIN b USING (s1, t)) "


def _ranks(s, d) -> DataFrame:
    p = pairs(s, d)
    rank = lambda c: p.select("s1", "t", F.row_number().over(lists.best_first("s1", c, "t")).alias("rank"))
    return blocking.outer_ranks(rank("p"), rank("emb"), 3)


@query("j7_outer_ranks", sql(_RANKS + "SELECT * FROM rk", "prs"))
def _(s, d):
    return _ranks(s, d)


@query("j18_hard_negative", sql(_RANKS + ", c AS (SELECT rk.s1, rk.t, CASE WHEN a_rank > 0 THEN a_rank ELSE 999 END * 1000 + CASE WHEN b_rank > 0 THEN b_rank ELSE 999 END AS cost FROM rk ANTI JOIN (SELECT s1, t FROM prs WHERE label = 1) y ON rk.s1 = y.s1 AND rk.t = y.t) SELECT s1, t, cost FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY cost, t) AS rn FROM c) WHERE rn = 1", "prs"))
def _(s, d):
    return blocking.hard_negatives(_ranks(s, d), pairs(s, d).where("label = 1").select("s1", "t"))


@query("j8_label_lookup", sql("+tt AS (SELECT DISTINCT l_orderkey AS s1, l_partkey % 500 AS t FROM lineitem WHERE l_discount > 0.05) SELECT p.s1, p.t, (tt.s1 IS NOT NULL)::INT AS y FROM prs p LEFT JOIN tt ON p.s1 = tt.s1 AND p.t = tt.t", "prs"))
def _(s, d):
    y = table(s, d, "lineitem").where("l_discount > 0.05").selectExpr("l_orderkey AS s1", "l_partkey % 500 AS t").distinct().withColumn("y", F.lit(1))
    return pairs(s, d).select("s1", "t").join(y, ["s1", "t"], "left").na.fill(0, ["y"])


@query("j16_contested", sql("+x AS (SELECT * FROM prs WHERE p >= 0.9) SELECT s1, t, p FROM x WHERE s1 % 10 <> 0 AND t IN (SELECT t FROM x WHERE s1 % 10 = 0)", "prs"))
def _(s, d):
    x = pairs(s, d).where("p >= 0.9").select("s1", "t", "p")
    return lists.contested(x, x.where("s1 % 10 = 0").select("s1").distinct())


@query("j19_incremental_scores", sql("SELECT s1, t, CASE WHEN rr IS NOT NULL THEN rr ELSE p END AS score FROM prs", "prs"))
def _(s, d):
    x = pairs(s, d)
    old = x.where("rr is not null").select("s1", "t", F.col("rr").alias("score"))
    return old.unionByName(x.join(old, ["s1", "t"], "left_anti").select("s1", "t", F.col("p").alias("score")))


@query("a9_coverage", sql("""+c AS (SELECT s1, t FROM prs WHERE p >= 0.3), y AS (SELECT s1, t FROM prs WHERE label = 1),
x AS (SELECT o.s1, coalesce(nc, 0) AS n_c, coalesce(nt, 0) AS n_true, coalesce(nh, 0) AS n_hit FROM own o LEFT JOIN (SELECT s1, count(*) AS nc FROM c GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS nt FROM y GROUP BY s1) USING (s1) LEFT JOIN (SELECT y.s1, count(*) AS nh FROM y JOIN c USING (s1, t) GROUP BY y.s1) USING (s1))
SELECT round(sum(n_hit) / greatest(sum(n_true), 1), 6) AS pair_recall, round(avg(CASE WHEN n_true > 0 THEN (n_hit = n_true)::INT END), 6) AS entity_recall, round(avg(CASE WHEN n_true = 0 THEN 1 WHEN n_hit = 0 THEN 0 ELSE 1.25::DOUBLE * (n_hit / n_true) / (0.25::DOUBLE + n_hit / n_true) END), 6) AS f05_ceiling, round(avg(n_c), 6) AS mean_cands,
round(quantile_cont(n_c, 0.99), 6) AS p99_cands, max(n_c) AS max_cands, round(100 * avg((n_c = 0)::INT), 6) AS no_cands_pct, round(1 - sum(n_c) / (count(*) * 500.0::DOUBLE), 6) AS reduction_ratio FROM x""", "prs", "own"))
def _(s, d):
    p = pairs(s, d)
    return blocking.coverage(p.where("p >= 0.3").select("s1", "t"), p.where("label = 1").select("s1", "t"), owners(s, d), 500)


# ---- lists and competition --------------------------------------------------------------------------------------------

_LINE = "PARTITION BY s1 ORDER BY %s DESC NULLS LAST, t"
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query("w3_w5_group_features", sql(f"SELECT s1, t, n_cands, CASE WHEN rr IS NOT NULL THEN rn END AS rr_grank, b - rr AS rr_gap, rr - CASE WHEN rn = 1 THEN coalesce(sec, -1) ELSE b END AS rr_margin FROM (SELECT *, count(*) OVER (PARTITION BY s1) AS n_cands, row_number() OVER ({_LINE % 'rr'}) AS rn, max(rr) OVER (PARTITION BY s1) AS b, nth_value(rr, 2) OVER ({_LINE % 'rr'} {_ALL}) AS sec FROM prs)", "prs"))
def _(s, d):
    return lists.group_features(pairs(s, d).select("s1", "t", "rr"), "rr").drop("rr")


@query("w6_prune_keep", sql(f"SELECT s1, t, p FROM (SELECT *, row_number() OVER ({_LINE % 'p'}) AS r FROM prs) WHERE (r <= 4 AND (p >= 0.2 OR r <= 2)) OR b4_rank BETWEEN 1 AND 1", "prs"))
def _(s, d):
    return lists.prune_keep(pairs(s, d), 4, 2, 0.2, 1).select("s1", "t", "p")


@query("w7_rerank_select", sql(f"SELECT s1, t FROM (SELECT *, row_number() OVER ({_LINE % 'p'}) AS r, row_number() OVER ({_LINE % 'emb'}) AS q FROM prs) WHERE p >= 0.8 OR r <= 2 OR q <= 1", "prs"))
def _(s, d):
    return lists.rerank_select(pairs(s, d), 0.8, 2, 1).select("s1", "t")


@query("w9_list_features", sql(f"SELECT s1, t, p1 AS best_p, coalesce(p2, 0) AS second_p, coalesce(p3, 0) AS third_p, rn AS p_rank, round(p / greatest(p1, 1e-6), 6) AS p_rel_best, round(p1 - p, 6) AS p_gap_best, round(sp, 6) AS sum_p, nh::INT AS n_hi, CASE WHEN rn = 1 THEN t2 ELSE t1 END AS sib1, CASE WHEN rn <= 2 THEN t3 ELSE t2 END AS sib2 FROM (SELECT *, row_number() OVER ({_LINE % 'p'}) AS rn, sum(p) OVER (PARTITION BY s1) AS sp, sum((p > 0.5)::INT) OVER (PARTITION BY s1) AS nh, {', '.join(f'nth_value(p, {i}) OVER ({_LINE % "p"} {_ALL}) AS p{i}, nth_value(t, {i}) OVER ({_LINE % "p"} {_ALL}) AS t{i}' for i in (1, 2, 3))} FROM prs)", "prs"))
def _(s, d):
    return lists.list_features(pairs(s, d).select("s1", "t", "p")).drop("p")


@query("a11_target_competition", sql("SELECT t, max(p) FILTER (WHERE r = 1) AS best, coalesce(max(p) FILTER (WHERE r = 2), -1) AS second, max(s1) FILTER (WHERE r = 1) AS best_s1, count(*) AS n_s1 FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, s1) AS r FROM prs) GROUP BY t", "prs"))
def _(s, d):
    return lists.target_competition(pairs(s, d).withColumnRenamed("p", "score"))


_COMP = "SELECT s1, t, CASE WHEN r = 1 THEN coalesce(b2, 0) ELSE b1 END AS tc_other, (r = 1)::INT AS tc_is_best, n - 1 AS tc_n, h - (v > 0.5)::INT AS tc_n_hi FROM (SELECT s1, t, v, row_number() OVER (PARTITION BY t ORDER BY v DESC, s1) AS r, max(v) OVER (PARTITION BY t) AS b1, nth_value(v, 2) OVER (PARTITION BY t ORDER BY v DESC, s1 " + _ALL + ") AS b2, count(*) OVER (PARTITION BY t) AS n, (sum((v > 0.5)::INT) OVER (PARTITION BY t))::BIGINT AS h FROM (SELECT s1, t, %s AS v FROM prs WHERE %s IS NOT NULL))"


@query("a12_competition_p", sql(_COMP % ("p", "p"), "prs"))
def _(s, d):
    return lists.competition_p(pairs(s, d).select("s1", "t", "p")).drop("p")


@query("a13_competition_rerank", sql(_COMP % ("rr", "rr") + " UNION ALL SELECT s1, t, NULL, NULL, NULL, NULL FROM prs WHERE rr IS NULL", "prs"))
def _(s, d):
    return lists.competition_p(pairs(s, d).select("s1", "t", "rr"), "rr").drop("rr")


_ASSIGN = "SELECT s1, t, CASE WHEN r = 1 AND round(p - coalesce(nx, 0), 9) >= 0.02 THEN p ELSE 0 END AS p FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, s1) AS r, lead(p) OVER (PARTITION BY t ORDER BY p DESC, s1) AS nx FROM prs)"


@query("w13_assign", sql(_ASSIGN, "prs"))
def _(s, d):
    return lists.assign_targets(pairs(s, d).select("s1", "t", "p"), 0.02)


@query("w15_expected_f", sql(f"+x AS (SELECT s1, row_number() OVER ({_LINE % 'p'}) AS k, sum(p) OVER ({_LINE % 'p'} ROWS UNBOUNDED PRECEDING) AS c, sum(p) OVER (PARTITION BY s1) AS sp, sum(ln(greatest(1 - p, 1e-9))) OVER (PARTITION BY s1) AS nn FROM prs), y AS (SELECT s1, k, round(1.25::DOUBLE * c / (k + 0.25::DOUBLE * (sp + 0.05::DOUBLE)), 9) AS f, round(0.95::DOUBLE * exp(nn), 9) AS f0 FROM x), z AS (SELECT s1, f, k, f0, row_number() OVER (PARTITION BY s1 ORDER BY f DESC, k) AS r FROM y) SELECT s1, CASE WHEN f > f0 THEN k ELSE 0 END AS k, round(greatest(f, f0), 6) AS f FROM z WHERE r = 1", "prs"))
def _(s, d):
    return lists.expected_f_select(pairs(s, d), 0.05)


@query("w16_pseudo_clean", sql("SELECT * FROM (SELECT s1, sum((p >= 0.7)::INT)::BIGINT AS n_emit, min(p) FILTER (WHERE p >= 0.7) AS min_emit, max(p) FILTER (WHERE p < 0.7) AS max_rest, max(p) AS best FROM prs GROUP BY s1) WHERE (n_emit > 0 AND min_emit >= 0.8 AND coalesce(max_rest, 0) <= 0.5) OR (n_emit = 0 AND best <= 0.3)", "prs"))
def _(s, d):
    return lists.pseudo_clean(pairs(s, d).withColumn("e", F.col("p") >= 0.7), "e", 0.8, 0.5, 0.3)


@query("w17_negatives", sql(f"+x AS (SELECT *, floor(greatest(sum(label) OVER (PARTITION BY s1), 1) * 2) AS q FROM prs), y AS (SELECT *, ceil(q * 0.75) AS hq, row_number() OVER ({_LINE % 'p'}) AS r FROM x WHERE label = 0), z AS (SELECT *, row_number() OVER (PARTITION BY s1, r <= hq ORDER BY md5(t::VARCHAR), t) AS e FROM y) SELECT s1, t FROM z WHERE r <= hq OR e <= q - hq", "prs"))
def _(s, d):
    return lists.sample_negatives(pairs(s, d), 2, 0.75, F.md5(F.col("t").cast("string"))).select("s1", "t")


@query("k8_stratified_cap", sql("SELECT s1, country FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5(s1::VARCHAR), s1) AS r FROM own) WHERE r <= 50", "own"))
def _(s, d):
    return lists.stratified_cap(owners(s, d), "country", 50, F.md5(F.col("s1").cast("string")), "s1", _kept(s))


# ---- decision ---------------------------------------------------------------------------------------------------------

_EMIT = "SELECT s1, t, p FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, t) AS r, max(p) OVER (PARTITION BY s1) AS b FROM prs) WHERE b >= {0}::DOUBLE AND (r = 1 OR (p >= {1}::DOUBLE AND p >= b * {2}::DOUBLE))"
_RULE = (0.55, 0.75, 0.7)


def _emitted(s, d, rule=_RULE) -> DataFrame:
    return decide.apply_rule(pairs(s, d).select("s1", "t", "p"), *rule)


@query("d1_rule", sql(_EMIT.format(*_RULE), "prs"))
def _(s, d):
    return _emitted(s, d)


_COUNTS = f"+e AS ({_EMIT.format(*_RULE)}), y AS (SELECT s1, t FROM prs WHERE label = 1), n AS (SELECT o.s1, country, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, coalesce(tp, 0) AS tp FROM own o LEFT JOIN (SELECT s1, count(*) AS np FROM e GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS nt FROM y GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS tp FROM e JOIN y USING (s1, t) GROUP BY s1) USING (s1)) "
_F = "CASE WHEN np = 0 AND nt = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25::DOUBLE * (tp / np) * (tp / nt) / (0.25::DOUBLE * (tp / np) + tp / nt) END"
_METRICS = f"count(*) AS n_s1, round(avg({_F}), 6) AS macro_f05, round(avg(CASE WHEN nt = 0 THEN (np = 0)::INT END), 6) AS singleton_acc, round(sum(tp) / greatest(sum(np), 1), 6) AS pair_precision, round(sum(tp) / greatest(sum(nt), 1), 6) AS pair_recall"


def _counts(s, d) -> DataFrame:
    return decide.counts(owners(s, d), _emitted(s, d), pairs(s, d).where("label = 1").select("s1", "t"))


@query("a14_f05", sql(_COUNTS + f"SELECT s1, np AS n_pred, nt AS n_true, tp, round({_F}, 6) AS f FROM n", "prs", "own"))
def _(s, d):
    return _counts(s, d).select("s1", "n_pred", "n_true", "tp", F.round(decide.f05(F.col("tp"), F.col("n_pred"), F.col("n_true")), 6).alias("f"))


@query("a15_a18_metrics", sql(_COUNTS + f"SELECT {_METRICS} FROM n", "prs", "own"))
def _(s, d):
    return decide.metrics(_counts(s, d))


@query("a18_metrics_country", sql(_COUNTS + f"SELECT country, {_METRICS} FROM n GROUP BY country", "prs", "own"))
def _(s, d):
    return decide.metrics(_counts(s, d), "country")


#: 14 x 16 x 6 thresholds.
_GRID = ([k / 20 for k in range(4, 18)], [k / 20 for k in range(4, 20)], [0.0, 0.4, 0.6, 0.7, 0.8, 0.9])


@query("d2_grid_search", sql(f"+gr AS (SELECT * FROM (SELECT unnest({_GRID[0]})::DOUBLE AS t_emit), (SELECT unnest({_GRID[1]})::DOUBLE AS t_add), (SELECT unnest({_GRID[2]})::DOUBLE AS rel)), m AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, t) AS r, max(p) OVER (PARTITION BY s1) AS b FROM prs), e AS (SELECT t_emit, t_add, rel, s1, count(*) AS np, sum(label) AS tp FROM m, gr WHERE b >= t_emit AND (r = 1 OR (p >= t_add AND p >= b * rel)) GROUP BY ALL), n AS (SELECT gr.*, o.s1, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, coalesce(tp, 0) AS tp FROM own o CROSS JOIN gr LEFT JOIN e ON e.s1 = o.s1 AND e.t_emit = gr.t_emit AND e.t_add = gr.t_add AND e.rel = gr.rel LEFT JOIN (SELECT s1, sum(label) AS nt FROM prs GROUP BY s1) y ON y.s1 = o.s1) SELECT t_emit, t_add, rel, round(avg({_F}), 6) AS macro_f05 FROM n GROUP BY t_emit, t_add, rel", "prs", "own"))
def _(s, d):
    p = pairs(s, d)
    return decide.grid_search(p.select("s1", "t", "p"), p.where("label = 1").select("s1", "t"), owners(s, d), *_GRID)


@query("k4_best_thresholds", f"SELECT * FROM ({ORACLES['d2_grid_search']}) ORDER BY macro_f05 DESC, t_emit, t_add, rel LIMIT 5")
def _(s, d):
    return decide.best_thresholds(QUERIES["d2_grid_search"](s, d), 5)


@query("a19_emission_profile", sql(f"+e AS ({_EMIT.format(*_RULE)}) SELECT country, count(*) AS n_s1, round(avg((n IS NULL)::INT), 6) AS empty_share, round(coalesce(sum(n), 0) / greatest(count(n), 1), 6) AS pairs_per_matched, round(avg(b), 6) AS mean_best_p, round(coalesce(sum(sp), 0) / greatest(coalesce(sum(n), 0), 1), 6) AS mean_emitted_p FROM own LEFT JOIN (SELECT s1, max(p) AS b FROM prs GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS n, sum(p) AS sp FROM e GROUP BY s1) USING (s1) GROUP BY country", "prs", "own"))
def _(s, d):
    return decide.emission_profile(pairs(s, d), _emitted(s, d), owners(s, d))


_RUNS = [(0.55, 0.75, 0.7), (0.4, 0.6, 0.5), (0.8, 0.9, 0.9)]


@query("u5_vote", sql("SELECT s1, t, count(*) AS votes FROM (" + " UNION ALL ".join(f"SELECT s1, t FROM ({_EMIT.format(*r)})" for r in _RUNS) + ") GROUP BY s1, t HAVING count(*) >= 2", "prs"))
def _(s, d):
    return decide.vote([_emitted(s, d, r) for r in _RUNS], 2)


@query("u6_subset_check", sql(f"SELECT s1, t FROM ({_EMIT.format(*_RULE)}) WHERE (s1, t) NOT IN (SELECT (s1, t) FROM prs WHERE b4_rank <= 3)", "prs"))
def _(s, d):
    return decide.subset_violations(_emitted(s, d), pairs(s, d).where("b4_rank <= 3"))


@query("a27_error_buckets", sql(f"+x AS (SELECT label = 1 AS y, e.s1 IS NOT NULL AS e, p.b4_rank <= 3 AS c FROM prs p LEFT JOIN ({_EMIT.format(*_RULE)}) e ON p.s1 = e.s1 AND p.t = e.t) SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN y AND e THEN 'found' WHEN y AND c THEN 'missed_candidate' WHEN y THEN 'missed_blocking' WHEN e THEN 'false' END AS bucket FROM x) WHERE bucket IS NOT NULL GROUP BY bucket", "prs"))
def _(s, d):
    p = pairs(s, d)
    return decide.error_buckets(p.where("label = 1"), _emitted(s, d), p.where("b4_rank <= 3"))


@query("w19_unseen_thresholds", sql("SELECT country, CASE WHEN country = 'c0' THEN 0.55 ELSE greatest(round(quantile_cont(b, 0.4), 6), 0.55) END::DOUBLE AS t_emit FROM (SELECT s1, max(p) AS b FROM prs GROUP BY s1) JOIN own USING (s1) GROUP BY country", "prs", "own"))
def _(s, d):
    best = pairs(s, d).groupBy("s1").agg(F.max("p").alias("best")).join(owners(s, d), "s1")
    return decide.unseen_thresholds(best, ["c0"], 0.4, 0.55)


@query("d6_validator", sql("""+o AS (SELECT doc_id, 'S1-' || doc_id AS s1, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'S2-' || doc_id WHEN 2 THEN 'S1-5' WHEN 3 THEN 'S2-' || doc_id || ',,S3-1' WHEN 4 THEN 'S2-1,S2-1' ELSE 'S3-' || (doc_id * 3) END AS ids FROM documents WHERE doc_id % 11 <> 0),
k AS (SELECT 'S1-' || doc_id AS s1 FROM documents WHERE doc_id % 13 <> 0), kt AS (SELECT 'S2-' || doc_id AS t FROM documents UNION ALL SELECT 'S3-' || doc_id FROM documents), i AS (SELECT s1, unnest(string_split(ids, ',')) AS t FROM o WHERE ids <> ''),
r AS (SELECT 'duplicate_row' AS rule FROM (SELECT s1 FROM o GROUP BY s1 HAVING count(*) > 1) UNION ALL SELECT 'duplicate_id' FROM (SELECT s1, t FROM i WHERE t <> '' GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'bad_prefix' FROM i WHERE t <> '' AND NOT regexp_matches(t, '^S[23]-') UNION ALL SELECT 'stray_token' FROM i WHERE t = '' UNION ALL SELECT 'unknown_id' FROM i WHERE t <> '' AND t NOT IN (SELECT t FROM kt) UNION ALL SELECT 'unknown_s1' FROM o WHERE s1 NOT IN (SELECT s1 FROM k) UNION ALL SELECT 'missing_s1' FROM k WHERE s1 NOT IN (SELECT s1 FROM o))
SELECT rule, count(*) AS n FROM r GROUP BY rule""", "own"))
def _(s, d):
    docs = table(s, d, "documents").select("doc_id")
    out = docs.where("doc_id % 11 <> 0").selectExpr("concat('S1-', doc_id) AS s1", "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN concat('S2-', doc_id) WHEN 2 THEN 'S1-5' WHEN 3 THEN concat('S2-', doc_id, ',,S3-1') WHEN 4 THEN 'S2-1,S2-1' ELSE concat('S3-', doc_id * 3) END AS ids")
    return decide.validate(out, docs.where("doc_id % 13 <> 0").selectExpr("concat('S1-', doc_id) AS s1"), docs.selectExpr("explode(array(concat('S2-', doc_id), concat('S3-', doc_id))) AS t"))


# ---- checks -----------------------------------------------------------------------------------------------------------


@query("a20_field_stats", sql("SELECT country, count(*) AS n, round(100 * avg((business_name = '')::INT), 6) AS pct_empty_name, round(100 * avg((business_address = '')::INT), 6) AS pct_empty_address, round(100 * avg(regexp_matches(business_name, '[ऀ-෿]')::INT), 6) AS pct_indic, count(*) - count(DISTINCT entity_id) AS n_dup_ids FROM rec GROUP BY country", "rec"))
def _(s, d):
    return checks.field_stats(records(s, d))


_N = "+m AS (SELECT o.s1, country, count(t) AS n, count(t) FILTER (WHERE t % 2 = 0) AS n2, count(t) FILTER (WHERE t % 2 = 1) AS n3 FROM own o LEFT JOIN (SELECT s1, t FROM prs WHERE label = 1) USING (s1) GROUP BY o.s1, country) "
_STATS = "count(*) AS n_s1, round(100 * avg((n = 0)::INT), 6) AS singleton_pct, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS max, sum((n2 > 0 AND n3 = 0)::INT)::BIGINT AS s2_only, sum((n2 = 0 AND n3 > 0)::INT)::BIGINT AS s3_only, sum((n2 > 0 AND n3 > 0)::INT)::BIGINT AS both"


def _matches(s, d) -> DataFrame:
    y = pairs(s, d).where("label = 1").groupBy("s1").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("t") % 2 == 0, 1)).alias("n2"), F.count(F.when(F.col("t") % 2 == 1, 1)).alias("n3"))
    return owners(s, d).join(y, "s1", "left").na.fill(0)


@query("a21_match_histogram", sql(_N + "SELECT least(n, 11) AS matches, count(*) AS n_s1 FROM m GROUP BY ALL", "prs", "own"))
def _(s, d):
    return checks.match_histogram(_matches(s, d))


@query("a22_truth_stats", sql(_N + f"SELECT country, {_STATS} FROM m GROUP BY country", "prs", "own"))
def _(s, d):
    return checks.truth_stats(_matches(s, d), "country")


@query("a23_exclusivity", sql("SELECT t, count(DISTINCT s1) AS n_lists FROM prs WHERE label = 1 GROUP BY t HAVING count(DISTINCT s1) > 1", "prs"))
def _(s, d):
    return checks.exclusivity(pairs(s, d).where("label = 1"))


@query("a24_cross_country", sql("+c AS (SELECT t, 'c' || (t % 3) AS country FROM (SELECT DISTINCT t FROM prs)) SELECT a.country AS a, c.country AS b, count(*) AS n FROM prs p JOIN own a ON a.s1 = p.s1 JOIN c ON c.t = p.t WHERE label = 1 AND a.country <> c.country GROUP BY ALL ORDER BY n DESC, a, b LIMIT 10", "prs", "own"))
def _(s, d):
    far = 1_000_000_000_000  # S1 and targets are numbered apart
    p = pairs(s, d)
    country = owners(s, d).selectExpr("s1 AS key", "country").unionByName(p.select("t").distinct().selectExpr(f"t + {far} AS key", "concat('c', t % 3) AS country"))
    return checks.cross_country(p.where("label = 1").selectExpr("s1", f"t + {far} AS t"), country)


@query("a25_unlabeled", sql("SELECT src, country, count(*) AS n, round(100 * avg((t IS NULL)::INT), 6) AS pct_unlabeled FROM rec LEFT JOIN (SELECT DISTINCT t FROM tru) ON key = t WHERE src > 1 GROUP BY src, country", "rec", "tru"))
def _(s, d):
    return checks.unlabeled(records(s, d).where("src > 1"), truth(s, d))


@query("a26_integrity", sql("""+l AS (SELECT 'S1-' || doc_id AS s1, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'S2-' || (doc_id // 3 * 3 + 1) WHEN 2 THEN 'S2-1,S2-1' ELSE 'S3-999999999,,S2-1' END AS ids FROM documents WHERE doc_id % 2 = 0), i AS (SELECT s1, unnest(string_split(ids, ',')) AS t FROM l WHERE ids <> ''), k AS (SELECT entity_id AS s1 FROM rec WHERE entity_id LIKE 'S1-%')
SELECT 'repeated_id' AS counter, count(*) AS n FROM (SELECT entity_id FROM rec GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'malformed_id', count(*) FROM rec WHERE NOT regexp_matches(entity_id, '^S[123]-(0|[1-9][0-9]{0,9})$') UNION ALL SELECT 'unknown_id', count(*) FROM i WHERE t <> '' AND t NOT IN (SELECT entity_id FROM rec) UNION ALL SELECT 'unknown_owner', count(*) FROM l WHERE s1 NOT IN (SELECT s1 FROM k)
UNION ALL SELECT 'missing_list', count(*) FROM k WHERE s1 NOT IN (SELECT s1 FROM l) UNION ALL SELECT 'stray_token', count(*) FROM i WHERE t = '' UNION ALL SELECT 'twice_in_list', count(*) FROM (SELECT s1, t FROM i WHERE t <> '' GROUP BY ALL HAVING count(*) > 1)""", "rec"))
def _(s, d):
    lists_ = table(s, d, "documents").where("doc_id % 2 = 0").selectExpr("concat('S1-', doc_id) AS s1", "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('S2-', doc_id div 3 * 3 + 1) WHEN 2 THEN 'S2-1,S2-1' ELSE 'S3-999999999,,S2-1' END AS ids")
    return checks.integrity(records(s, d), lists_)


# ---- models (rows only) -----------------------------------------------------------------------------------------------


@query("a30_isotonic")
def _(s, d):
    return models.calibrate(pairs(s, d)).select("s1", "t", F.round("calibrated", 6).alias("calibrated"))


# ---- flagship ---------------------------------------------------------------------------------------------------------


@query(FLAGSHIP, sql(f"""+a AS (SELECT key AS s1, country, business_name AS n FROM rec WHERE src = 1), b AS (SELECT key AS t, country, business_name AS n, count(*) OVER (PARTITION BY country, business_name) AS c FROM rec WHERE src > 1 AND business_name <> ''),
e AS (SELECT s1, t FROM a JOIN b ON a.country = b.country AND a.n = b.n AND b.c <= 50), y AS (SELECT s1, t FROM tru WHERE s1 < 20000000000 AND t >= 20000000000), n AS (SELECT a.s1, country, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, coalesce(tp, 0) AS tp FROM a LEFT JOIN (SELECT s1, count(*) AS np FROM e GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS nt FROM y GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS tp FROM e JOIN y USING (s1, t) GROUP BY s1) USING (s1))
SELECT country, {_METRICS} FROM n GROUP BY country""", "rec", "tru"))
def _(s, d):
    r = records(s, d).withColumn("bk", F.when(F.col("business_name") != "", F.concat_ws("|", "country", "business_name")))
    s1 = r.where("src = 1")
    found = blocking.key_block_pairs(s1.selectExpr("key AS s1", "bk AS key"), r.where("src > 1").selectExpr("key AS t", "bk AS key"), 50)
    y = truth(s, d).where("s1 < 20000000000 AND t >= 20000000000")
    return decide.metrics(decide.counts(s1.selectExpr("key AS s1", "country"), found, y), "country")
