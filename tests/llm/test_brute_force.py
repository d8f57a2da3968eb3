"""Operators without SQL against plain Python over the same rows, and columns whose names clash with those that operators make."""

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from test_llm import ODD, docs, words_of

from quillmark.llm import language, linededup, quality_rules, sharding, subword

CLASH = "doc_id long, text string, _k int, _n string, _j int, own string, `all` string, part int, size long, n_chars long, `a.b` int"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, i * 3, f"n{i}", -i, "o", "a", i % 2, len((t or "").encode()) + 16, i, 7) for i, t in enumerate(texts)], CLASH)


def test_shards_are_cut_at_equal_targets(spark):
    rows = clashing(spark, [("word " * (k * 37 % 91)) for k in range(200)] + ODD)
    got = sorted(sharding.shard(rows, "size", ["doc_id"], 7, partitions=5).collect(), key=lambda r: r.doc_id)
    total, before, slots = sum(r.size for r in got), 0, {}
    for r in got:
        assert r.shard == min((2 * before + r.size) * 7 // (2 * total), 6)
        assert r.slot == slots.setdefault(r.shard, 0)
        slots[r.shard] += 1
        before += r.size
    assert [tuple(r)[2:11] for r in got] == [tuple(r)[2:] for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


def test_line_dedup_keeps_columns_of_any_name(spark):
    texts = ["a line\nof text\na line", "a line", None, ""]
    got = sorted(linededup.dedup(clashing(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [(r.text, r.n_lines, r.n_dropped) for r in got] == [("a line\nof text", 3, 1), ("", 1, 1), (None, 0, 0), ("", 1, 0)]
    assert [tuple(r)[2:11] for r in got] == [tuple(r)[2:] for r in sorted(clashing(spark, texts).collect(), key=lambda r: r.doc_id)]


def test_quality_statistics(spark):
    texts = [*ODD, "# a $\nb\n# a $\n\n\nb \nc|d <e> & 100%\nB\nb", "one two three four five six seven eight " * 9, " ".join(f"w{i}" for i in range(40))]
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, texts), []).where("doc_id is not null").collect()}
    for i, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        r, n = got[i], len(words_of(t))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.n_dup_lines == len(lines) - len({*lines})
        assert r.base_failed == (n < 20 or 100 * r.n_repeat_words > 30 * n) and r.kept == (not r.base_failed)


def test_classifier_scores_by_hand(spark):
    """The mean of the buckets' values over a text's words, their n-grams and word pairs, through the softmax."""
    shape, rng = subword.Shape(buckets=997), np.random.default_rng(2)
    model = subword.Model(shape, rng.normal(0, 3, 997), 0.4)
    texts = ["The cat sat on the the mat", *ODD]
    for t, got in zip(texts, model.scores(pa.array(texts, pa.string()))):
        w = [x.lower().encode() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x).encode() for x in words_of(t)]
        values = []
        for x in w:
            values.append(model.logits[xxhash.xxh3_64_intdigest(x) % 997])
            marked = f"<{x.decode()}>"
            values += [model.logits[xxhash.xxh3_64_intdigest(marked[i : i + n], n) % 997] for n in (3, 4) for i in range(len(marked) - n + 1)]
        hashed = [xxhash.xxh3_64_intdigest(x) for x in w]
        buckets = subword._pairs(np.array(hashed, np.uint64), np.array([0, len(w)]), shape)[1] if len(w) > 1 else []
        assert len(buckets) == max(0, len(w) - 1)
        values += [model.logits[b] for b in buckets]
        z = (sum(values) / len(values) if values else 0.0) + 0.4
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_classifier_training_does_not_depend_on_how_rows_are_dealt(spark):
    rows = docs(spark, [None, "", *(f"word {i} is {'good' if i % 2 else 'bad'}" for i in range(60)), None])
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, quality int")
    one, two = (subword.fit(r, labels, shape=subword.Shape(buckets=512, least_steps=50)) for r in (rows.coalesce(1), rows.orderBy(rows.doc_id.desc()).repartition(5)))
    assert (one.logits == two.logits).all() and one.bias == two.bias


def test_language_by_hand(spark):
    """Cosines of TF-IDF vectors with the centroids, one text at a time; every language is learned, however many there are."""
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèàñçøåæœðþłńśźżčšžřůđ"
    names = [f"l{k}" for k in range(520)]
    rows = [(i, " ".join("".join(rng.choice(list(letters[k % 40 : k % 40 + 8]), 5)) for _ in range(6)), name, "s", 1, 1, "", "", "") for i, (k, name) in enumerate((k, n) for k, n in enumerate(names) for _ in range(2))]
    train = spark.createDataFrame(rows, docs(spark).schema)
    shape = language.Shape(buckets=512, centroids=2, least_rows=2, sample_total=100, cuts=(1,))
    model = language.fit(train, shape)
    assert model.names == tuple(sorted(names))
    texts = [rows[0][1], rows[700][1], "zzz", "Ein Satz", *ODD]
    pred, score, _ = model.predict(pa.array(texts, pa.string()))
    for t, name, s in zip(texts, pred, score):
        counts = np.zeros(512)
        for word in re.split("[ \t-\r]+", (t or "").lower()):
            kept = "".join(c for c in word if c.isalpha())
            for gram in [*kept, *(f" {kept} "[i : i + n] for n in (2, 3) for i in range(len(kept) + 3 - n))] if kept else []:
                x = ord(gram[0])
                for c in gram[1:]:
                    x = (x * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                counts[(x * 0xD6E8FEB86659FD93 % 2**64 >> 40) % 512] += 1
        if not counts.any():
            assert (name, s) == ("und", 0)
            continue
        v = np.log1p(counts) * model.idf
        cos = model.centroids @ (v / np.linalg.norm(v))
        assert abs(s - min(1, cos.max())) < 1e-9 and cos[model.of == model.names.index(name)].max() > cos.max() - 1e-9


def test_language_split_is_by_crc(spark):
    from quillmark.llm.common import crc_mod

    got = {r.doc_id: r.m for r in docs(spark).select("doc_id", crc_mod("doc_id", 4).alias("m")).where("doc_id is not null").collect()}
    assert all(m == zlib.crc32(str(i).encode()) % 4 for i, m in got.items())
