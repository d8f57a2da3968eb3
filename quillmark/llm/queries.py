"""The queries of this subpackage, op1 to op13 and the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import audit, jaccard, language, linededup, linkgraph, mixing, packing, quality_rules, resampling, sharding, subword, suffixes, topk
from quillmark.llm.common import crc_mod

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: The tree of the mix: sources by domain, and weights of domains and languages; sources of a language weigh the same.
DOMAINS = {"web": range(0, 10), "books": range(10, 15)}
WEIGHTS = {"domain": {"web": 6, "books": 3, "other": 1}, "language": {"en": 6, "fr": 2, "de": 1, "es": 1}}
MIX = {"fraction": 0.6, "epochs": 2, "seed": 13}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: str):
    out = F.lit("other")
    for name, numbers in DOMAINS.items():
        out = F.when(F.col(source).isin([f"src{i}" for i in numbers]), F.lit(name)).otherwise(out)
    return out


def tokens_of(text: str):
    """A quarter of the UTF-8 bytes, rounded up; 0 for null."""
    return F.expr(f"CAST((coalesce(octet_length({text}), 0) + 3) DIV 4 AS BIGINT)")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("CAST(coalesce(octet_length(text), 0) + 16 AS BIGINT)").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = sharding.shard(rows, "size", ["doc_id", "text_crc32", "size"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    out = subword.score(docs, subword.fit(docs, seen))
    return out.select("doc_id", (F.coalesce(crc_mod("doc_id", 5), F.lit(0)) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, domain_of("source"), tokens_of("text"), **MIX)
    return taken.select("doc_id", *mixing.LEVELS, "tokens", "copies", "leaf_budget")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(crc_mod("doc_id", 4) != 2))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.length)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1,
    "op2_quality_rules": op2,
    "op3_jaccard_join": op3,
    "op4_sharding": op4,
    "op5_quality_classifier": op5,
    "op6_mixing": op6,
    "op7_url_filter": op7,
    "op8_topk": op8,
    "op9_language": op9,
    "op10_line_dedup": op10,
    "op11_resampling": op11,
    "op12_decontamination": op12,
    "op13_filter_audit": op13,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, b.y FROM r JOIN b ON b.x = r.reach)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.reach) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""


def _case(weights: dict[str, int], column: str) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {float(v)}" for k, v in weights.items())} ELSE 1.0 END" if weights else "1.0"


def _share(name: str, source: str, parent: str, column: str, keep: str) -> str:
    """SQL of mixing.share: CTE `name` from `source`, which has budget, capacity and weight."""
    part = f"PARTITION BY {parent} ORDER BY capacity / weight, {column} NULLS FIRST"
    return f"""
{name}_a AS (SELECT *, budget - coalesce(sum(capacity) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lft, sum(weight) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst FROM {source}),
{name}_b AS (SELECT *, capacity <= lft / rst * weight AS fills FROM {name}_a),
{name}_c AS (SELECT *, first_value(CASE WHEN NOT fills THEN lft / rst END IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lvl FROM {name}_b),
{name} AS (SELECT {keep}, CASE WHEN fills THEN capacity ELSE least(capacity, greatest(0.0, lvl * weight)) END AS budget FROM {name}_c)"""


_SOURCES = " ".join(f"WHEN source IN ({', '.join(f"'src{i}'" for i in r)}) THEN '{d}'" for d, r in DOMAINS.items())

_OP6 = f"""
WITH base AS (SELECT doc_id, CASE {_SOURCES} ELSE 'other' END AS domain, lang AS language, source AS origin, ((coalesce(strlen(text), 0) + 3) // 4)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * {float(MIX["epochs"])} AS capacity FROM base GROUP BY ALL),
d0 AS (SELECT domain, sum(capacity) AS capacity, sum(tokens) AS t, 0 AS root FROM leaves GROUP BY domain),
d1 AS (SELECT domain, root, capacity, least(floor(sum(t) OVER () * {MIX["fraction"]}::DOUBLE), sum(capacity) OVER ()) AS budget, {_case(WEIGHTS["domain"], "domain")}::DOUBLE AS weight FROM d0),
{_share("d2", "d1", "root", "domain", "domain")},
l1 AS (SELECT m.domain, m.language, m.capacity, d2.budget, {_case(WEIGHTS["language"], "language")}::DOUBLE AS weight FROM (SELECT domain, language, sum(capacity) AS capacity FROM leaves GROUP BY ALL) m JOIN d2 ON m.domain IS NOT DISTINCT FROM d2.domain),
{_share("l2", "l1", "domain", "language", "domain, language")},
o1 AS (SELECT v.domain, v.language, v.origin, v.tokens, v.capacity, l2.budget, 1.0::DOUBLE AS weight FROM leaves v JOIN l2 ON v.domain IS NOT DISTINCT FROM l2.domain AND v.language IS NOT DISTINCT FROM l2.language),
{_share("o2", "o1", "domain, language", "origin", "domain, language, origin, tokens")},
plan AS (SELECT domain, language, origin, tokens AS all_tokens, floor(budget + 1e-6)::BIGINT AS leaf_budget, CASE WHEN tokens > 0 THEN floor(floor(budget + 1e-6) / tokens)::INT ELSE 0 END AS full_epochs FROM o2),
placed AS (SELECT b.*, leaf_budget, full_epochs, leaf_budget - full_epochs * all_tokens AS part, ('0x' || substr(md5({MIX["seed"]} || ':' || full_epochs || ':' || doc_id), 1, 8))::BIGINT AS draw
  FROM base b JOIN plan p ON b.domain = p.domain AND b.language IS NOT DISTINCT FROM p.language AND b.origin IS NOT DISTINCT FROM p.origin),
run AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed),
out AS (SELECT doc_id, domain, language, origin, tokens, (full_epochs + CASE WHEN before < part THEN 1 ELSE 0 END)::INT AS copies, leaf_budget FROM run)
SELECT * FROM out WHERE copies > 0
"""

_OP8 = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT DISTINCT * FROM ok WHERE vec_id % 100 = 0) q JOIN ok c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


#: Of the SQL of op7, which can't test for the end: 0.85 ** 130 is under 1e-9.
ROUNDS = 130


def _op7() -> str:
    host, path = r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)", r"regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    rules = sorted(linkgraph.RULES, key=lambda r: -len(r.pattern))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{getattr(r, what)}'" for r in rules) + " END"
    ranks = []
    for name, edges, seeds in (("t", "links", "good"), ("d", "back", "bad")):
        ranks.append(f"{name}f AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS part FROM {edges})")
        ranks.append(f"{name}0 AS MATERIALIZED (SELECT host, seed AS new FROM {seeds})")
        for k in range(ROUNDS):
            ranks.append(f"{name}{k + 1} AS MATERIALIZED (SELECT dst AS host, sum(new * part) * 0.85::DOUBLE AS new FROM {name}f JOIN {name}{k} ON src = host GROUP BY dst)")
        ranks.append(f"{name}a AS (SELECT host, sum(new) AS mass FROM ({' UNION ALL '.join(f'SELECT * FROM {name}{k}' for k in range(ROUNDS + 1))}) GROUP BY host)")
        ranks.append(f"{name}r AS (SELECT host, mass / sum(mass) OVER () AS rank FROM {name}a)")
    return f"""
WITH u AS (SELECT page_id, html, coalesce(translate({host}, {upper}), '') AS host, coalesce({path}, '') AS path FROM pages),
v AS (SELECT *, {case("pattern")} AS rule, {case("verdict")} AS said FROM u),
c AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE said = 'allow') AS g, count(*) FILTER (WHERE said = 'block') AS b FROM v WHERE host <> '' GROUP BY host),
good AS (SELECT host, (g / n) / (SELECT sum(g / n) FROM c) AS seed FROM c WHERE g > 0),
bad AS (SELECT host, (b / n) / (SELECT sum(b / n) FROM c) AS seed FROM c WHERE b > 0),
h AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*((?:https?:)?//[^"''\\s>]+)', 1)) AS t FROM u WHERE host <> ''),
links AS (SELECT src, dst, count(*) AS n FROM (SELECT src, translate(regexp_extract(t, '^(?:[A-Za-z]+:)?//([^/?#]*)', 1), {upper}) AS dst FROM h) WHERE dst <> '' AND src <> dst GROUP BY ALL),
back AS (SELECT dst AS src, src AS dst, n FROM links),
{", ".join(ranks)}
SELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN coalesce(dr.rank, 0.0) - coalesce(tr.rank, 0.0) * (1 + 1e-6::DOUBLE) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN tr ON v.host = tr.host LEFT JOIN dr ON v.host = dr.host
"""


def _crc_table() -> list[int]:
    """The 256 values of the CRC-32 of a byte, by its polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [v >> 1 ^ 0xEDB88320 * (v & 1) for v in out]
    return out


#: text_crc32 byte by byte; sizes in the order of the rows, cut where the middle of a row falls.
_OP4 = f"""
WITH t AS (SELECT {_crc_table()}::UBIGINT[] AS c),
d AS (SELECT doc_id, (coalesce(strlen(text), 0) + 16)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)),
  lambda a, b: xor(a >> 8, c[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM documents, t),
o AS (SELECT *, sum(size) OVER line AS upto, sum(size) OVER () AS total, row_number() OVER line AS n FROM d WINDOW line AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least((2 * upto - size)::HUGEINT * 40 // greatest(2 * total, 1), 39)::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s
"""

_LETTERS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP11 = f"""
WITH crc AS (SELECT {_crc_table()}::UBIGINT[] AS c),
d AS (SELECT doc_id, coalesce({_LETTERS}, []) AS ws FROM documents), b AS (SELECT {_LETTERS} AS ws FROM benchmark),
v AS (SELECT DISTINCT unnest(ws) AS w FROM d UNION SELECT DISTINCT unnest(ws) FROM b),
k AS (SELECT w, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::UBIGINT)), lambda a, b: xor(a >> 8, c[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000)::INT AS bucket FROM v, crc),
dp AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN k USING (w) GROUP BY ALL),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dp GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS w FROM b) JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dp JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= 20 AS able FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE able) OVER () * 10 // 100 AS drawn FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= drawn THEN r END AS rank FROM z
"""

_OP12 = f"""
WITH d AS (SELECT doc_id, coalesce({_LETTERS}, []) AS ws FROM documents), b AS (SELECT item_id, {_LETTERS} AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, size, array_to_string(ws[p:p + size - 1], ' ') AS win FROM (SELECT item_id, ws, least(len(ws), 10) AS size, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0)),
o AS (SELECT doc_id, p, size, array_to_string(ws[p:p + size - 1], ' ') AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM i) WHERE len(ws) >= size)),
m AS (SELECT doc_id, p, size, item_id FROM o JOIN i USING (size, win)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM m)) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(x),
  'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)} AS bad FROM t LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, [bad['A'], bad['B'], bad['C'], bad['D'], bad['E']] AS bad, count(*) AS n FROM f GROUP BY ALL),
c AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c1.k, d.k, e.k] AS o FROM c a, c b, c c1, c d, c e WHERE len(list_distinct([a.k, b.k, c1.k, d.k, e.k])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step, o[step] AS own, o[1:step - 1] AS before FROM o, (SELECT k AS step FROM c)),
r AS (SELECT part, filter_order, step, own, n, good, toxic, bad[own] AS fails, len(list_filter(before, lambda i: bad[i])) > 0 AS gone, len(list_filter(bad, lambda b: b)) = 1 AS sole FROM g, s),
e AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE fails AND sole), 0)::BIGINT AS unique_fails, coalesce(sum(n * good) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(n * toxic) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM e
"""

ORACLES = {"op11_resampling": _OP11, "op12_decontamination": _OP12, "op13_filter_audit": _OP13, "op4_sharding": _OP4, "op3_jaccard_join": _OP3, "op6_mixing": _OP6, "op7_url_filter": _op7(), "op8_topk": _OP8}
