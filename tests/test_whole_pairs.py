import duckdb
import pytest

import __spark_entry__ as entry
from quillmark.functions import similarity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def names():
    """All (s1, t) -> names that are compared."""
    rows = duckdb.sql(f"SELECT doc_id, split_part(text, '.', 1), lang FROM '{SF}/documents.parquet'").fetchall()
    key = lambda i: (1 + i % 3) * 10_000_000_000 + i
    return {(key(i), key(j)): (a, b) for i, a, x in rows if i % 3 == 0 for j, b, y in rows if j % 3 and x == y and i // 10 == j // 10}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def got(spark, name):
    return {(r[0], r[1]): r for r in entry.queries()[name](spark, SF).collect()}


def test_levenshtein_of_every_pair(spark, names):
    out = got(spark, "f6_levenshtein")
    assert out.keys() == names.keys() and any(not (a + b).isascii() for a, b in names.values())
    for k, (a, b) in names.items():
        assert out[k].lev == pytest.approx(1 - levenshtein(a, b) / max(len(a), len(b)) if a or b else 1, abs=1e-6)


def test_jaro_winkler_of_every_pair(spark, names):
    out = got(spark, "f5_jaro_winkler")
    assert out.keys() == names.keys()
    for k, (a, b) in names.items():
        code = {c: chr(i + 33) for i, c in enumerate(sorted({*a, *b}))}  # DuckDB compares bytes
        if len(code) < 94:
            x, y = ("".join(code[c] for c in t) for t in (a, b))
            assert out[k].jw == pytest.approx(duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [x, y]).fetchone()[0], abs=1e-6)


def test_ratios_of_every_pair(spark, names):
    out = got(spark, "f1_f4_fuzzy_ratios")
    assert out.keys() == names.keys()
    for k, (a, b) in names.items():
        assert out[k].ratio == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100, abs=1e-5)
        assert out[k].token_set == pytest.approx(similarity._set_ratio(a, b), abs=1e-5)
