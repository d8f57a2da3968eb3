"""Pairwise string similarity. Levenshtein is native; the others are Arrow UDFs over batches, as Spark has no LCS or Jaro."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillmark.functions.batches import pieces


def _codes(a: str) -> np.ndarray:
    return np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=256)
def _places(a: str) -> dict[str, int]:
    """For each character of a, a whole number with a bit for each of its places."""
    if len(a) < 48:
        where: dict[str, int] = {}
        for i, c in enumerate(a):
            where[c] = where.get(c, 0) | 1 << i
        return where
    codes = _codes(a)
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}


#: Characters after which a row is cut to its places again, and texts from which on rows begin short and grow.
STEP, LONG = 64, 4096


def _row(a: str, b: str) -> int:
    """The last row of the table of common lengths, as one whole number, of which all bits change at once: a 0 where the length grows. The bits of `a` are
    made once for all b it is asked with.

    The first i characters of b lead no farther into a than where all of them are met one after the other. Behind that bits are 1: in long texts they
    aren't there before they are needed."""
    n, places = len(a), _places(a)
    grows = n >= LONG
    row, have, met = (0, 0, 0) if grows else ((1 << n) - 1, n, n)
    for start in range(0, len(b), STEP):
        part = b[start : start + STEP]
        row &= (1 << have) - 1  # carries pile up beyond the last place
        if have < n:
            for c in part:
                if c in places:
                    met = a.find(c, met) + 1
                    if not met:
                        met = n
                        break
            row |= (1 << met) - (1 << have)
            have = met
        for u in map(places.get, part):
            if u:
                u &= row
                row = (row + u) | (row ^ u)
    return row & ((1 << have) - 1) | (1 << n) - (1 << have)


def _grown(row: int, n: int) -> np.ndarray:
    """The common length with each start of a, from 0 to n characters."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8), "little"), np.uint8), count=n, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence. A much longer a is met from both ends, by half of b each: rows are short at first from either side."""
    n, half = len(a), len(b) // 2
    if n < LONG or n < 3 * len(b) or not half:
        return n - _row(a, b).bit_count()
    return int((_grown(_row(a, b[:half]), n) + _grown(_row(a[::-1], b[half:][::-1]), n)[::-1]).max())


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence. What both begin and end with is all common; of the rest the longer text's places are the bits."""
    if a == b:
        return len(a)
    if len(a) < len(b):
        a, b = b, a
    front, most = len(commonprefix((a, b))), len(b)
    back = len(commonprefix((a[: front - len(a) - 1 : -1] if front < len(a) else "", b[: front - len(b) - 1 : -1] if front < most else "")))
    a, b = a[front : len(a) - back], b[front : most - back]
    return front + back + (_common(a, b) if a and b else 0)


def _ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def _set_ratio(a: str, b: str) -> float:
    """The best of three ratios: the words of both with either side's own words, and each of these with the words of both. Those begin alike, so only the
    words that one side has alone are compared by characters."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    start = len(both) + 1 if both else 0
    first, second = start + len(left), start + len(right)
    least = 200.0 * len(both) / (len(both) + min(first, second)) if both else 0.0
    reached = lambda common: 200.0 * (start + common) / (first + second)
    # No more is common than the shorter side, or than the characters of both, in any order.
    if reached(min(len(left), len(right))) <= least or reached(sum(min(left.count(c), right.count(c)) for c in {*left})) <= least:
        return least
    return max(reached(_lcs(left, right)), least)


#: Numbers of a table that is combed at once, about: a few of them are held.
COMBED = 1 << 18


def _combed(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair and character of its b (positions x pairs): where the strand that leaves the table of a and b below that character came in at the top, or a
    number below 0 if it came in at the left. What a has in common with b[i:j] is j - i, less the strands from i on that leave before j.

    Strands of a cell cross unless its characters are equal or they have crossed before (semi-local string comparison, by A. Tiskin). The cells of a
    diagonal, of all pairs, are done at once. Shorter texts are filled up with characters that are equal to none."""
    n, m, k = max(map(len, a)), max(map(len, b)), len(a)
    x, y = np.full((k, n), 1 << 30, np.int32), np.full((k, m), 1 << 31, np.uint32).view(np.int32)
    for row, text in (*zip(x, a), *zip(y, b)):
        row[: len(text)] = _codes(text)
    x, y = np.ascontiguousarray(x.T[::-1]), np.ascontiguousarray(y.T)
    kind = np.int16 if n + m < 1 << 15 else np.int32
    h, v = (np.repeat(np.arange(i, j, dtype=kind), k).reshape(-1, k) for i, j in ((0, n), (n, n + m)))
    low, high, equal = np.empty((n, k), kind), np.empty((n, k), kind), np.empty((n, k), bool)
    for d in range(n + m - 1):
        i, end = max(0, n - 1 - d), min(n, n + m - 1 - d)
        j, w = d - n + 1 + i, end - i
        left, top, lo, hi, eq = h[i:end], v[j : j + w], low[:w], high[:w], equal[:w]
        np.equal(x[i:end], y[j : j + w], out=eq)
        np.minimum(left, top, out=lo)
        np.maximum(left, top, out=hi)
        np.copyto(lo, top, where=eq)
        np.copyto(hi, left, where=eq)
        left[:], top[:] = lo, hi
    return v.astype(np.int64) - n


def _span_ratio(n: int, start: np.ndarray, first: bool, last: bool) -> float:
    """The best ratio of a text of n characters to spans of its length in a part of a longer one, from the starts of the part's strands; also to shorter
    spans at its beginning if it is the first part, and at its end if it is the last."""
    m = len(start)
    end = np.flatnonzero(start >= 0)
    start = start[end]
    low, high = np.maximum(end - n + 1, 0), np.minimum(start, m - n)  # spans that hold the strand
    held = low <= high
    lost = np.cumsum(np.bincount(low[held], minlength=m - n + 2) - np.bincount(high[held] + 1, minlength=m - n + 2))
    best = 100.0 * int(n - lost[: m - n + 1].min()) / n
    size = np.arange(1, n)
    for lost in [np.bincount(end, minlength=m)] * first + [np.bincount(start, minlength=m)[::-1]] * last:
        best = max(best, float((200.0 * (size - np.cumsum(lost)[: n - 1]) / (n + size)).max(initial=0.0)))
    return best


def _partials(pairs: list[tuple[str, str]]) -> list[float]:
    """The best ratio of the shorter text of each pair to any span of its length in the longer one, or to what such a span leaves at either end. Long texts are
    searched in parts that hold each span once or twice; parts of like lengths are done together."""
    out, todo = [0.0] * len(pairs), []
    for at, (a, b) in enumerate(pairs):
        a, b = (b, a) if len(a) > len(b) else (a, b)
        n, m = len(a), len(b)
        if not a or a in b:
            out[at] = 0.0 if b and not a else 100.0
        else:
            step = 3 * n
            todo += [(math.ceil(2 * math.log2(n)), len(part := b[i : i + step + n]), at, a, part, i == 0, i + step + n >= m) for i in range(0, max(m - n, 1), step)]
    todo.sort(key=lambda x: x[:3])
    while todo:
        size, longest = todo[-1][:2]  # the others of this size are no longer
        n = 1
        while n < len(todo) and todo[-1 - n][0] == size and 2 * todo[-1 - n][1] >= longest and (n + 1) * 2 * longest <= COMBED:
            n += 1
        some, todo = todo[-n:], todo[:-n]
        for (_, m, at, a, _b, first, last), start in zip(some, _combed([s[3] for s in some], [s[4] for s in some]).T):
            out[at] = max(out[at], _span_ratio(len(a), start[:m], first, last))
    return out


def _partial(a: str, b: str) -> float:
    return _partials([(a, b)])[0]


def _firsts(at: list[int], own: list[int], reach: int) -> tuple[list[int], list[int]]:
    """Places of a character in one text, each with the first unused one in the other that is within reach. Windows only move on, so places are met once."""
    hits, taken, k = [], [], 0
    for i in at:
        while k < len(own) and own[k] < i - reach:
            k += 1
        if k < len(own) and own[k] <= i + reach:
            hits.append(i)
            taken.append(own[k])
            k += 1
    return hits, taken


def _met(a: str, b: str, reach: int) -> tuple[list[str] | np.ndarray, list[str] | np.ndarray]:
    """The characters of either text that are matched, in its order: each of a takes the first unused equal one of b in its window. If the k-th
    places of a character are within reach of each other, for all k, that makes pairs of them: in long texts all such characters are done at once."""
    if len(a) + len(b) < 256:
        places: dict[str, tuple[list[int], list[int]]] = {}
        for side, text in enumerate((a, b)):
            for i, c in enumerate(text):
                places.setdefault(c, ([], []))[side].append(i)
        both = [_firsts(*p, reach) for p in places.values() if p[0] and p[1]]
        return [a[i] for i in sorted(i for p in both for i in p[0])], [b[j] for j in sorted(j for p in both for j in p[1])]
    x, y = _codes(a), _codes(b)
    if max(x.max(), y.max()) < 1 << 16:
        x, y = x.astype(np.uint16), y.astype(np.uint16)  # sorted by digits
    i, j = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    found, start, count = np.unique(x[i], return_index=True, return_counts=True)
    other, others = np.searchsorted(y[j], found), np.searchsorted(y[j], found, "right")
    most = np.minimum(count, others - other)
    ends = np.cumsum(most)
    place = np.arange(ends[-1]) - np.repeat(ends - most, most)
    hits, taken = i[np.repeat(start, most) + place], j[np.repeat(other, most) + place]
    far = np.flatnonzero(np.abs(hits - taken) > reach)
    if len(far):
        late = np.unique(np.searchsorted(ends, far, "right"))
        near = ~np.repeat(np.isin(np.arange(len(found)), late), most)
        more = [_firsts(i[start[c] : start[c] + count[c]].tolist(), j[other[c] : others[c]].tolist(), reach) for c in late]
        hits, taken = (np.concatenate([v[near], *(np.array(m[side], np.int64) for m in more)]) for side, v in enumerate((hits, taken)))
    return x[np.sort(hits)], y[np.sort(taken)]


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    hits, taken = _met(a, b, max(max(len(a), len(b)) // 2 - 1, 0))
    if not len(hits):
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, taken)) // 2 if isinstance(hits, list) else int((hits != taken).sum()) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    common = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        common += 1
    return jaro + 0.1 * common * (1 - jaro) if jaro > 0.7 else jaro


def _vector(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = np.empty(len(a))
        for i, pair in enumerate(zip(a.fillna(""), b.fillna(""))):
            if pair not in seen:
                seen[pair] = f(*pair)
            out[i] = seen[pair]
        return pd.Series(out)

    return run


def scorers() -> dict[str, object]:
    """Name -> function of two columns; 0 to 100, Jaro-Winkler 0 to 1."""
    return {"ratio": _vector(_ratio), "token_sort": _vector(lambda a, b: _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))), "token_set": _vector(_set_ratio), "partial": _vector(_partial), "jaro_winkler": _vector(_jaro_winkler)}


_KINDS = {"ratio": _ratio, "tset": _set_ratio, "tsort": lambda a, b: _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), "partial": _partial, "jw": _jaro_winkler}
#: Kinds that are worked out for many pairs at once.
_MANY = {"partial": _partials}


def _distinct(kind: str, pairs: list[tuple[str, str]]) -> np.ndarray:
    """Scores of pairs, each worked out once."""
    each = list({*pairs})
    score = dict(zip(each, _MANY[kind](each)))
    return np.array([score[p] for p in pairs])


#: Scores that a task remembers over a batch, about, and the longest texts of a pair among them: some 10 MB.
KNOWN, SHORT = 20_000, 200


def several(wanted: list[str], *sides: Column) -> Column:
    """A struct of scores in one pass. sides: columns in pairs. wanted: {view}_{kind}, the views in the order in which they first
    occur among the wanted, one pair of columns each; a name without a view is of kind and view alike. Null counts as empty."""
    split = [w.rsplit("_", 1) if "_" in w else (w, w) for w in wanted]
    views = list(dict.fromkeys(v for v, _ in split))
    assert len(sides) == 2 * len(views), (views, len(sides))

    @F.arrow_udf(StructType([StructField(w, DoubleType()) for w in wanted]))
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            at, early = 0, {}
            for w, (view, kind) in zip(wanted, split):  # of many pairs: no other column has to be there
                if kind in _MANY:
                    i = 2 * views.index(view)
                    early[w] = np.concatenate([_distinct(kind, list(zip(*(c.fill_null("").to_pylist() for c in part)))) for part in pieces(columns[i : i + 2])])
            known: dict[tuple[str, str, str], float] = {}  # of texts that are short, as equal pairs are
            for part in pieces(columns):
                texts = [c.fill_null("").to_pylist() for c in part]
                pairs = [list(zip(texts[2 * i], texts[2 * i + 1])) for i in range(len(views))]
                out = []
                for w, (view, kind) in zip(wanted, split):
                    if w in early:
                        out.append(early[w][at : at + len(part[0])])
                        continue
                    mine, f = pairs[views.index(view)], _KINDS[kind]
                    fresh = {p: f(*p) for p in {*mine} if (kind, *p) not in known}
                    out.append([fresh[p] if p in fresh else known[kind, *p] for p in mine])
                    if len(known) < KNOWN:
                        known.update(((kind, *p), v) for p, v in fresh.items() if len(p[0]) + len(p[1]) <= SHORT)
                at += len(part[0])
                yield pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in out], wanted)

    return run(*sides)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def same_state(a: Column, b: Column) -> Column:
    """1 equal, 0 different, null if either is missing."""
    return F.when((a != "") & (b != ""), (a == b).cast("int"))


def acronym_match(acr_a: Column, compact_a: Column, acr_b: Column, compact_b: Column) -> Column:
    return F.coalesce(((acr_a != "") & (acr_a == compact_b)) | ((acr_b != "") & (acr_b == compact_a)), F.lit(False))


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
