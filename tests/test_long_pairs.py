"""Scores of long pairs: the same as by their definition, and in a time that such pairs can be given."""

import random
import time

from quillmark.functions import similarity as S


def _text(letters: str, n: int, seed: int) -> str:
    return "".join(random.Random(seed).choices(letters, k=n))


def _common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_partial_of_many_pairs_is_that_of_all_spans():
    def plain(a, b):
        a, b = (b, a) if len(a) > len(b) else (a, b)
        n, m = len(a), len(b)
        spans = [b[i : i + n] for i in range(m - n + 1)] + [b[:k] for k in range(1, n)] + [b[m - k :] for k in range(1, n)]
        return max(200.0 * _common(a, s) / (n + len(s)) for s in spans)

    pairs = [(_text("abc d"[:k], 1 + i % 9, i), _text("abc d"[:k], 1 + i * 7 % 50, -i)) for i in range(60) for k in (2, 5)]
    assert S._partials(pairs) == [plain(*p) for p in pairs]
    assert S._partials([]) == [] and S._partials([("", "a"), ("", "")]) == [0.0, 100.0]


def test_partial_of_a_long_pair_takes_seconds():
    a, b = "ab cd " * 500 + "x", "ab cd " * 2_000 + "y"  # no span can be passed over: all have nearly the same in common
    start = time.process_time()
    assert S._partial(a, b) == 200.0 * 3_000 / (3_001 + 3_000)
    assert time.process_time() - start < 3


def test_common_length_of_texts_of_very_unlike_lengths():
    for seed, (n, m) in enumerate(((4_200, 90), (9_000, 64), (5_000, 1_300), (4_096, 1), (4_500, 4_400))):
        a, b = _text("etaoin shrdlu", n, seed) + "漢" * (seed == 2), "x" * (seed % 2) + _text("etaoin shrdluq", m, -seed)
        assert S._common(a, b) == S._common(b, a) == (_common(a, b) if m < 100 else S._common(b, a))
    assert S._common(_text("abc", 4_200, 1), "xyz") == 0


def test_jaro_winkler_of_long_texts_is_that_of_single_steps(monkeypatch):
    pairs = [(_text("abcde fgh", n, n), _text("abcde fgh" + "z" * (n % 3), m, -m)) for n in (200, 300, 1_000) for m in (90, 310, 2_000)] + [("a" * 200 + "b" * 200, "b" * 200 + "a" * 200), ("q" * 200 + "a" * 9, "a" * 9 + "w" * 300)]
    got = [S._jaro_winkler(*p) for p in pairs]

    def one(a, b, reach):
        used, hits = set(), []
        for i, c in enumerate(a):
            j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == c and j not in used), None)
            if j is not None:
                used.add(j)
                hits.append(c)
        return hits, [b[j] for j in sorted(used)]

    monkeypatch.setattr(S, "_met", one)
    assert got == [S._jaro_winkler(*p) for p in pairs]
