"""The learned verdict of op2: the list's rules one by one in plain Python, on learned and on given rules."""

import numpy as np
from test_llm import ODD, docs, words_of

from quillmark.llm import quality_rules
from quillmark.llm.quality_rules import Rule


def ratios(r):
    """The ratios of one row, from its counts."""
    names = {n: getattr(r, n) for n in quality_rules.STATS}
    return {n: float(eval(sql.replace("greatest", "max").replace("cast(n_words as double)", "n_words"), {"max": max}, names)) for n, sql in quality_rules.RATIOS.items()}  # noqa: S307


def kept(r, rules):
    x = ratios(r)
    bad = any(all(x[n] >= t if least else x[n] < t for n, least, t in rule.conditions) for rule in rules)
    return not r.base_failed and not bad


def texts():
    rng = np.random.default_rng(6)
    out = []
    for k in range(240):
        w = [f"w{int(i)}" for i in rng.integers(0, 400, int(rng.integers(10, 60)))]
        if k % 3 == 0:
            w[::4] = ["SHOUT!!"] * len(w[::4])
        if k % 5 == 0:
            w[::3] = ["#|$"] * len(w[::3])
        out.append("\n".join([" ".join(w), "same line", "same line"][: 1 + k % 3]))
    return out


def test_learned_list_by_hand(spark):
    rows = docs(spark, [*texts(), *ODD])
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(240)], "doc_id long, quality int")
    rules = quality_rules.fit(rows, labels)
    assert rules
    got = quality_rules.judge(rows, rules).collect()
    assert len(got) == 240 + len(ODD) + 2
    assert [r.kept for r in got] == [kept(r, rules) for r in got]
    good = [r for r in got if r.doc_id is not None and r.doc_id < 240 and not r.base_failed]
    assert np.mean([r.kept == (r.doc_id % 3 != 0) for r in good]) > 0.95


def test_the_first_rule_that_fits_decides_and_bounds_are_kept(spark):
    rows = docs(spark, texts())
    x = [ratios(r)["upper_rate"] for r in quality_rules.judge(rows, []).collect()]
    edge = sorted({v for v in x if v})[0]
    for rules in ([Rule((("upper_rate", True, edge),))], [Rule((("upper_rate", False, edge), ("words", True, 30.0))), Rule((("symbol_rate", True, 0.01),))] if "symbol_rate" in quality_rules.RATIOS else []):
        got = quality_rules.judge(rows, rules).collect()
        assert [r.kept for r in got] == [kept(r, rules) for r in got]
