"""Resampling against a version with dictionaries, and CRCs against zlib."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_brute_force import clashing
from test_llm import ODD, docs

from quillmark.llm import resampling

TEXTS = [*ODD, *(f"alpha beta w{i % 7} Gamma-{i % 3} ÉTÉ été " * (i % 9) for i in range(60)), "the same " * 20, "the same " * 20]


def features_of(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)


def expected(rows, target, percent, least, longest, buckets):
    count = lambda t: Counter(zlib.crc32(f.encode()) % buckets for f in features_of(t, longest)[0])
    each = [count(t) for _, t in rows]
    s, t = sum(each, Counter()), sum(map(count, target), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for (i, text), c in zip(rows, each):
        weight = sum(gain[b] * n for b, n in c.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), features_of(text, longest)[1] >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = Counter((r[0], r[3], k + 1) for k, r in enumerate(able[: percent * len(able) // 100]))
    return sorted(map(repr, ([i, n, w, s] for i, n, w, s, _ in out))), ranks


@pytest.mark.parametrize(("longest", "runs"), [(1, 1), (3, 32)])
def test_against_dictionaries(spark, longest, runs):
    rows = docs(spark, TEXTS).repartition(5)
    target = ["alpha w1 gamma gamma", None, "", "ÉTÉ 1 the"]
    shape = resampling.Shape(buckets=97, longest=longest, parts=5, runs=runs)
    got = resampling.resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), 30, 20, shape=shape).collect()
    want, ranks = expected([(r.doc_id, r.text) for r in rows.collect()], target, 30, 20, longest, 97)
    assert sorted(repr([r.doc_id, r.n_features, r.weight, r.score]) for r in got) == want
    assert Counter((r.doc_id, r.score, r["rank"]) for r in got if r["rank"]) == ranks


def test_crc_goes_on_from_a_state():
    flat = np.frombuffer(b"hello wonderful", np.uint8)
    a = resampling.crc(flat, np.array([0, 6, 3]), np.array([5, 15, 3]))
    assert a.tolist() == [zlib.crc32(b"hello"), zlib.crc32(b"wonderful"), 0]
    assert resampling.crc(flat, np.array([5]), np.array([15]), a[:1]).tolist() == [zlib.crc32(flat.tobytes())]


def test_empty_tables_and_columns_of_any_name(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(docs(spark, []), target).count() == 0
    none = resampling.resample(docs(spark), target.limit(0)).collect()
    assert len(none) == len(ODD) + 2 and all(r.score is not None for r in none)
    rows = clashing(spark, TEXTS)
    kept = [c for c in rows.columns if c != "text"]
    got = resampling.resample(rows, target, 50)
    assert got.columns == [*kept, "n_features", "weight", "score", "rank"]
    assert sorted(tuple(r)[: len(kept)] for r in got.collect()) == sorted(tuple(r) for r in rows.select(*(f"`{c}`" for c in kept)).collect())
