import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_llm import brute_components

import corpus_pipeline
from quillmark.llm import packing

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture
def rows():
    """Texts with copies and near copies, under null, repeated and own doc_ids."""
    rng = np.random.default_rng(8)
    texts = [prose(rng, int(n)) for n in rng.integers(12, 40, 12)]
    texts += [texts[0], texts[1] + " more", texts[2], "", None]
    ids = [None, None, 5, 5, 6, None, 7, 7, None, 9, 10, None, None, 3, None, None, None]
    return [(i, t, "en", f"src{k % 4}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]


def run(spark, stage, rows):
    return [tuple(r) for r in STAGES[stage](spark, spark.createDataFrame(rows, SCHEMA), "").collect()]


def test_jaccard_keeps_one_of_each_component(spark, rows):
    sets = brute_components([r[1] for r in rows])
    groups = {}
    for k, (n, root) in enumerate(sets):
        groups.setdefault(("alone", k) if n == 0 else root, []).append(rows[k])
    left = Counter(run(spark, "ngram_jaccard_join", rows))
    assert sum(left.values()) == len(groups) == 14
    for group in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in group)
        assert sum(left[r] for r in {*group}) == 1
        assert any(left[r] for r in group if (r[0] is None, r[0] or 0) == least)


def test_language_keeps_what_is_not_rejected_and_fills_lang(spark, rows):
    rows = [*rows, (None, rows[0][1], None, "s", 1), (5, "?!", "en", "s", 2)]
    want = [(*r[:2], "en", *r[3:]) for r in rows if re.search("[a-z]", r[1] or "")]
    assert Counter(run(spark, "language_id", rows)) == Counter(want)


def test_line_dedup_keeps_each_line_once(spark, rows):
    """Without ties: the order is (doc_id, line number), and of lines at one place of it both stay."""
    rng = np.random.default_rng(9)
    lines = [" ".join(w + str(k) for w in rng.permutation(WORDS)) for k in range(8)]
    texts = ["\n".join(lines[a] for a in x) for x in ([0, 1], [1, 2], [3], [4, 3], [5, 5], [6], [7, 0])]
    ids = [1, 2, 3, 3, 4, None, None]
    got = run(spark, "line_dedup", [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)])
    assert Counter(x for r in got for x in r[1].split("\n")) == Counter(lines)
    assert all(r[4] == len(r[1]) for r in got)
    assert {r[1] for r in got if r[0] is None} == {lines[6], lines[7]}


def test_mixing_copies_whole_rows(spark, rows):
    from quillmark.llm import mixing
    from quillmark.llm.queries import MIX, WEIGHTS, domain_of, tokens_of

    rows = [*rows, rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.mix(df, WEIGHTS, domain_of("source"), tokens_of("text"), **MIX).collect()
    key = {r._row: r.copies for r in taken}
    named = df.selectExpr("xxhash64(doc_id, text, lang, source) AS h", "*").collect()
    want = Counter()
    for r in named:
        want[tuple(r)[1:]] += key.get(r.h, 0)
    assert Counter(run(spark, "mixing", rows)) == +want and want


def test_packing_holds_every_id(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), corpus_pipeline.TOKENIZER).collect()
    assert {*map(tuple, got)} and Counter(x for r in got for x in np.frombuffer(bytes(r.ids), "<u4").tolist()) == Counter(x for r in rows for x in [*t.encode(r[1] or "", add_special_tokens=False).ids, 1])
