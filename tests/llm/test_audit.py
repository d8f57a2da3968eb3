"""The filter audit against all orders run one by one."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from test_llm import ODD, docs

from quillmark.llm import audit

TEXTS = [*ODD, "a b c " * 80, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), "A# " * 250, "a # b", " ".join(f"w{i}" for i in range(250)), "A&", "A&", *(f"{'up ' * (i % 5)}{'LO' * (i % 3)} word{i % 11} | x" * (1 + i % 4) for i in range(40))]


def expected(rows, labels):
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    for r in rows:
        if r.doc_id is not None:
            t = r.text or ""
            first[t] = min(first.get(t, r.doc_id), r.doc_id)
    table = []
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len({*w}) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": t in first and (r.doc_id is None or r.doc_id > first[t])}
        table.append((r.source or "", bad, r.doc_id in good, r.doc_id in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {x[0] for x in table}:
        mine = [x for x in table if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                fails = [x for x in mine if x[1][f]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(fails) - len(gone), sum(sum(x[1].values()) == 1 for x in fails), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_against_all_orders(spark):
    rows = docs(spark, TEXTS)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None)]
    got = audit.interactions(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns[:3] == ["part", "filter_order", "step"]
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == expected(rows.collect(), labels)


def test_hot_copies_and_empty_table(spark):
    rows = docs(spark, ["hot text"] * 1500 + [f"text {i}" for i in range(1500)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = audit.measured(rows, labels)
    assert Counter(r.is_copy for r in m.collect()) == Counter({True: 1499, False: 1503})
    assert audit.interactions(rows.limit(0), labels).count() == 0


def test_each_state_is_walked_once(spark, monkeypatch):
    made = []
    real = type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: (made.append(1), real(self, *a))[1])
    rows = audit.measured(docs(spark, TEXTS[:12]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = audit.edges(rows, audit.FAILS).select("state").distinct().collect()
    assert len(made) == 31 and {r.state for r in got} >= {"", "A", "AB"}
