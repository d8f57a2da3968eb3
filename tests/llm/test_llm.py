import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quillmark.llm import jaccard, language, linededup, linkgraph, mixing, packing, quality_rules, sharding, subword, topk, words
from quillmark.llm.queries import WEIGHTS, domain_of, tokens_of

SCHEMA = "doc_id long, text string, lang string, source string, n long, rank int, _k string, shard string, ids string"
ODD = ["", " \n\t ", "a b", None, "one two three four five six seven eight nine ten " * 3, "x" * 300_000, "it's  we'll\n\n 'start' 's é× ½ 日本", "b a", "b a"]


def docs(spark, texts=ODD):
    base = [(i, t, "en" if i % 2 else None, f"src{i % 20}" if i % 3 else None, 1, 2, "z", "q", "i") for i, t in enumerate(texts)]
    return spark.createDataFrame([*base, *base[-1:], (None, "a null id with words enough for a line of text", "en", "src1", 1, 1, "", "", "")] if texts else [], SCHEMA)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_packing_round_trip(spark):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs(spark), tokenizer, capacity=64, pool=8, low=4).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    by, seqs = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length
        by.setdefault(r.doc_id, {})[r.start] = ids
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(ODD[:-1]):
        got = np.concatenate([by[i][k] for k in sorted(by[i])])
        assert list(got) == [*t.encode(text or "", add_special_tokens=False).ids, 1]
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64 and (at >= 56 or at & (at - 1) == 0)
    assert packing.pack(docs(spark, []), tokenizer).count() == 0


def test_fill_is_the_best_subset_sum():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 40, rng.integers(1, 9))
        counts = {int(s): int((sizes == s).sum()) for s in sizes}
        cap = int(rng.integers(1, 90))
        best = max(sum(s for k, s in enumerate(sizes) if m >> k & 1) for m in range(1 << len(sizes)) if sum(s for k, s in enumerate(sizes) if m >> k & 1) <= cap)
        taken = packing.fill(counts, cap)
        assert sum(s * n for s, n in taken.items()) == best and all(n <= counts[s] for s, n in taken.items())


def test_statistics_against_brute_force(spark):
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark), []).collect()}
    for i, t in enumerate(ODD):
        w, seen = words_of(t), {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        inside = {j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
    assert quality_rules.judge(docs(spark, []), []).count() == 0


def test_rules_learn_a_threshold():
    x = {n: np.random.default_rng(k).random(600) for k, n in enumerate(quality_rules.RATIOS)}
    bad = x["symbol_rate"] > 0.8
    rules = quality_rules.learn(x, bad)
    covered = np.zeros(600, bool)
    for r in rules:
        covered |= r.covers(x)
    assert rules and (covered == bad).mean() > 0.97
    assert quality_rules.learn(x, np.zeros(600, bool)) == []


def brute_components(texts, percent=80):
    sets = []
    for t in texts:
        w = words_of((t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


SMALL = {"count_bits": 8, "slice_bits": 8}
SHAPES = {
    "plain": jaccard.Shape(count_bits=12, slice_bits=10),
    "split lists": jaccard.Shape(**SMALL, part=4, block=2, hot=1, guides=2),
    "cells over cells": jaccard.Shape(**SMALL, room_sets=4, room=200, pivots=3, leaf=2),
    "blocks": jaccard.Shape(**SMALL, part=4, guides=1, room_sets=3, room=100, pivots=2, leaf=2, levels=0, load=1),
    "names that clash": jaccard.Shape(**SMALL, name_bits=3),
}


@pytest.mark.parametrize("shape", SHAPES.values(), ids=SHAPES)
def test_jaccard_against_brute_force(spark, shape):
    rng = np.random.default_rng(3)
    texts = [*ODD]
    for _ in range(12):
        base = rng.integers(0, 400, rng.integers(6, 90))
        for _ in range(rng.integers(1, 9)):
            own = base.copy()
            own[rng.integers(0, len(own), rng.integers(0, 4))] = rng.integers(0, 400)
            texts.append(" ".join(map(str, own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts), shape).where("doc_id is not null").collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_cells_against_brute_force():
    """Clusters of any tightness, so that windows hold a few sets or all; links of home sets must all be found."""
    rng = np.random.default_rng(12)
    for round_ in range(12):
        held = []
        for _ in range(rng.integers(1, 12)):
            base = np.unique(rng.integers(0, 500 if round_ % 2 else 1 << 40, rng.integers(3, 120)).astype(np.uint64))
            for _ in range(rng.integers(1, 30)):
                keep = rng.random(len(base)) > rng.choice([0.02, 0.1, 0.3])
                held.append(np.unique(np.append(base[keep], rng.integers(0, 1 << 50, rng.integers(1, 6)).astype(np.uint64))))
        order = rng.permutation(len(held))
        held = [held[i] for i in order]
        home = rng.random(len(held)) < 0.6
        groups = jaccard.Groups(len(held))
        for i in range(len(held)):
            for j in range(i):
                common = len(np.intersect1d(held[i], held[j]))
                if (home[i] or home[j]) and 100 * common >= 80 * (len(held[i]) + len(held[j]) - common):
                    groups.join(i, j)
        got = jaccard.Groups(len(held))
        for a, b in jaccard.cell(held, home, jaccard.Shape(leaf=6, pivots=8)):
            common = len(np.intersect1d(held[a], held[b]))
            assert 100 * common >= 80 * (len(held[a]) + len(held[b]) - common)
            got.join(a, b)
        same = lambda g: [[g.root(i) == g.root(j) for j in range(len(held))] for i in range(len(held))]
        linked, want = np.array(same(got)), np.array(same(groups))
        assert (linked >= want).all()


def test_vectors_never_reject_a_link():
    rng = np.random.default_rng(13)
    shape = jaccard.Shape(buckets=4, load=2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 200)).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, len(a) // 12).astype(np.uint64)))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
            v = jaccard.Vectors([len(a), len(b)], [jaccard._vector(x, shape) for x in (a, b)], shape)
            assert v.hits(0, np.array([1])).all() and v.hits(1, np.array([0])).all()


def test_jaccard_empty(spark):
    assert jaccard.join(docs(spark, []), jaccard.Shape(count_bits=8, slice_bits=8)).count() == 0


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = [" ".join(map(str, rng.integers(0, 50, rng.integers(1, 14)))) for _ in range(30)]
    texts = [*ODD]
    for _ in range(60):
        lines = []
        for _ in range(rng.integers(1, 5)):
            w = pool[rng.integers(0, 30)].split()
            k = rng.integers(0, 5)
            at = rng.integers(0, len(w))
            w = w[:at] + w[at + 1 :] if k == 0 and len(w) > 1 else w[:at] + ["q"] + w[at:] if k == 1 else w[:at] + ["r"] + w[at + 1 :] if k == 2 else w
            lines.append(("  " if k == 3 else " ").join(w))
        texts.append("\n".join(lines))

    def near(a, b):
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
        return abs(len(a) - len(b)) <= 1 and p + s >= max(len(a), len(b)) - 1

    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for line in (t or "").split("\n"):
            w = words_of(line)
            hit = w and any(w == x or (len(w) >= 8 and len(x) >= 8 and near(w, x)) for x in seen)
            if w:
                seen.append(w)
            if not hit:
                kept.append(line)
        want[i] = None if t is None else "\n".join(kept)
    got = {r.doc_id: r for r in linededup.dedup(docs(spark, texts)).where("doc_id is not null").collect()}
    assert {i: got[i].text for i in want} == want
    assert got[3].n_lines == 0 and got[3].n_dropped == 0
    assert linededup.dedup(docs(spark, [])).count() == 0


def test_shards(spark):
    rows = docs(spark).selectExpr("doc_id", "CAST(coalesce(octet_length(text), 0) + 16 AS BIGINT) AS size", "rank", "shard")
    got = sharding.shard(rows, "size", ["doc_id", "size"], 3).collect()
    assert len(got) == len(ODD) + 2
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    even = spark.range(1000).selectExpr("id", "1L AS size")
    assert {r["count"] for r in sharding.shard(even, "size", ["id"], 40).groupBy("shard").count().collect()} == {25}
    assert sharding.shard(rows.limit(0), "size", ["doc_id"], 3).count() == 0


def test_mixing_reaches_the_budget(spark):
    d = docs(spark, [f"word {i} " * (i % 7 + 1) for i in range(300)])
    got = mixing.mix(d, WEIGHTS, domain_of("source"), tokens_of("text"), fraction=0.5, epochs=2)
    by = {}
    for r in got.collect():
        x = by.setdefault((r.domain, r.language, r.origin), [r.leaf_budget, 0, 0])
        x[1] += r.tokens * r.copies
        x[2] = max(x[2], r.tokens)
    assert by and all(b <= n < b + m for b, n, m in by.values())
    total = d.selectExpr("sum((octet_length(text) + 3) div 4) AS n").first().n
    assert abs(sum(b for b, _, _ in by.values()) - total // 2) <= len(by) + 60
    assert mixing.mix(docs(spark, []), WEIGHTS, domain_of("source"), tokens_of("text")).count() == 0


def test_url_rules_and_distrust(spark):
    pages = [(0, "http://A.Example.net/en/x?q", None), (1, "https://b.net/x", ""), (2, "http://example.com/de/", "x"), (3, "http://q.org/fr/a#b", None), (4, None, "x"), (5, "no scheme", "x"), (6, "http://spam.info/", '<a href="http://b.net/y">'), (7, "http://clean.info/", '<a href="/local">'), (8, "http://friend.info/p", "<a href='//q.org/'>"), (8, "http://friend.info/p", "<a href='//q.org/'>")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("b.net", "/x", "net/", "block")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][3] == "block" and got[7][3] == "allow" and got[8][3] == "allow"


def test_topk_against_brute_force(spark):
    """Null, odd, repeated and huge vectors, other lengths, two vectors of one id, in blocks of several sizes."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (350, 16)).astype(np.float32).round(1))]
    rows += [(1000, None), (1001, [None] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] * 16), (5, rows[5][1]), (None, rows[6][1])]
    rows += [(100, rows[7][1]), (100, rows[100][1]), (2000, [1.0, -2.0]), (2100, []), (400, [3e38, -1e30, 0.25]), (401, [-2e38] * 16), (403, [2e38, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, _c string, v int")
    v = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in x]) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    want = []
    for q, x in {(i, tuple(x)) for i, x in v if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in v if i != q)[:10]
        want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]
    for block in (64, 16384):
        assert sorted(tuple(r) for r in topk.search(df, block=block).collect()) == sorted(want)
    assert topk.search(df.limit(0)).count() == 0
    assert topk.search(df.where("vec_id = 2000")).count() == 0


def test_topk_index_stops_on_proof():
    """Fewer postings are walked than candidates x dimensions, and fewer candidates scored than there are; none of the best is lost."""
    rng = np.random.default_rng(21)
    centres = rng.normal(0, 1, (12, 32))
    x = np.floor(200 * (centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.3, (3000, 32))))
    index = topk.Index(x)
    for i in range(40):
        q, k = x[i] * rng.choice([-1, 1]), 10
        s = x @ q
        kth = np.sort(s)[-k]
        assert set(np.flatnonzero(s >= kth)) <= set(index.search(q, k))
    assert index.touched < 0.6 * 40 * x.size
    assert index.rescored < 0.2 * 40 * len(x)


def test_language(spark):
    rng = np.random.default_rng(4)
    langs = {"a": "abcdefg", "b": "hijklmn"}
    data = [(i, " ".join("".join(rng.choice(list(langs[k]), 5)) for _ in range(20)), k, "s", 1, 1, "", "", "") for i, k in enumerate("ab" * 60)]
    train = spark.createDataFrame(data[:80], SCHEMA)
    model = language.fit(train)
    out = language.identify(spark.createDataFrame(data, SCHEMA), model).collect()
    assert all(r.lang_pred == r.lang and not r.lang_rejected for r in out)
    odd = {r.doc_id: r for r in language.identify(docs(spark), model).collect()}
    assert odd[3].lang_pred == odd[0].lang_pred == "und" and odd[3].lang_rejected and odd[3].lang_score == 0
    assert language.identify(docs(spark), language.fit(train.limit(0))).where("lang_rejected").count() == len(ODD) + 2


def test_quality_classifier(spark):
    rng = np.random.default_rng(6)
    good, bad = [f"g{k}ood" for k in range(60)], [f"j{k}unk" for k in range(60)]
    data = [(i, " ".join(rng.choice(good if i % 2 else bad, 30)), "en", "s", 1, 1, "", "", "") for i in range(300)]
    d = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300) if zlib.crc32(str(i).encode()) % 5], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in subword.score(d, subword.fit(d, labels)).collect()}
    assert min(s for i, s in got.items() if i % 2) > max(s for i, s in got.items() if i % 2 == 0)
    none = subword.score(docs(spark), subword.fit(d, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(ODD) + 2


def test_components():
    assert jaccard.prefix(10, 80) == 3 and jaccard.prefix(1, 80) == 1


def test_encoder_equals_the_tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        e = packing.Encoder(f.read())
    texts = ["it's 's\n\n x", " a  b \t\tc ", "we'r we'v e'll 'tis", "12ab!!''s --'re", "\x1c \x00", "<|endoftext|> hi", "ñ'té é's", "a\r\n\n", "", "n  "]
    for t, got in zip(texts, e.rows(pa.array(texts))):
        assert list(got) == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_language_counts_every_gram_of_words():
    shape = language.Shape()
    texts = ["Hello, wOrld 12", None, "", "  ", "a", "Straße\n\ntwo\tthree\xa0four", "123 !!", "x" * 140_000 + " " + "ab " * 20_000, *(f"w{i} zz" for i in range(300))]
    got = [(m[i], has[i]) for m, has in language.vectors(pa.array(texts), shape, None) for i in range(len(m))]
    assert len(got) == len(texts)
    for text, (row, has) in zip(texts, got):
        want = np.zeros(shape.buckets)
        for word in re.split("[ \t-\r]+", (text or "").lower()):
            kept = "".join(c for c in word if c.isalpha())
            marked = f" {kept} "
            for gram in [*kept, *(marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1))] if kept else []:
                x = ord(gram[0])
                for c in gram[1:]:
                    x = (x * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                want[(x * 0xD6E8FEB86659FD93 % 2**64 >> 40) % shape.buckets] += 1
        assert (row == want).all() and has == any(c.isalpha() for c in text or "")


def test_word_hashes_tell_words_apart():
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice(list("abé0"), n)) for n in [*range(1, 40), 255, 256, 257, 1000] for _ in range(40)] + ["a\0", "a\0\0", "a"]
    text = " ".join(made).encode()
    flat = np.frombuffer(text, np.uint8)
    starts, ends, _ = words.split(flat, np.array([0, len(flat)]))
    by: dict[bytes, set[int]] = {}
    for h, a, b in zip(words.hashed(flat, starts, ends).tolist(), starts, ends):
        by.setdefault(text[a:b], set()).add(h)
    assert set(by) == {w.encode() for w in made} and all(len(x) == 1 for x in by.values())
    assert len(set().union(*by.values())) == len(by)
    assert len(words.hashed(flat[:0], starts[:0], ends[:0])) == 0
