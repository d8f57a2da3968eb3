"""Learned decision lists over text statistics.

Statistics of every whole text come from one Arrow pass. A list of rules, each a conjunction of thresholds, is learned on
the driver from a bounded sample of labelled statistics by sequential covering: rules grow by the gain of each added
condition on two thirds of the sample, lose their last conditions while that doesn't lower their worth on the other third,
and are taken while they stay precise. The result is an ordered CASE expression that Spark evaluates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import words
from quillmark.llm.common import sampled

SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_same"]
WINDOW = 8


def _count(flat: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(of[flat], out=total[1:])
    return np.diff(total[offsets])


def _table(*spans: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for s in spans:
        t[list(s)] = 1
    return t


_LEAD = np.ones(256, np.uint8)
_LEAD[0x80:0xC0] = 0
_LEAD[words.SPACE] = 0
_SYMBOL, _UPPER, _DIGIT, _MARK = _table(SYMBOLS), _table(bytes(range(0x41, 0x5B))), _table(bytes(range(0x30, 0x3A))), _table(b"!?")


def repeated(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row, how many words lie in windows of eight words that the row holds twice or more. Exact: windows of equal
    hash are compared word by word."""
    rows = len(bounds) - 1
    at, h = words.windows(codes.astype(np.uint64), bounds, WINDOW)
    if not len(at):
        return np.zeros(rows, np.int64)
    row = np.searchsorted(bounds, at, "right") - 1
    h = words.mix(h ^ words.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    a, b = at[order][:-1][same], at[order][1:][same]
    equal = row[order][:-1][same] == row[order][1:][same]
    for k in range(WINDOW):
        equal &= codes[a + k] == codes[b + k]
    extra = np.zeros(0, np.int64)
    if not equal.all():  # a collision of hashes: the windows of such rows are told apart by their words
        pair_row = row[order][1:][same]
        wrong = np.unique(pair_row[~equal])
        for r in wrong:
            mine = at[row == r]
            _, which, n = np.unique(np.stack([codes[mine + k] for k in range(WINDOW)]), axis=1, return_inverse=True, return_counts=True)
            extra = np.append(extra, mine[n[which.ravel()] > 1])
        fine = ~np.isin(pair_row, wrong)
        a, b = a[fine], b[fine]
    hit = np.zeros(len(codes) + 1, np.int64)
    found = np.unique(np.concatenate([a, b, extra]))
    hit[found] += 1
    np.subtract.at(hit, found + WINDOW, 1)
    covered = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(np.cumsum(hit[:-1]) > 0, out=covered[1:])
    return np.diff(covered[bounds])


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each row's whole text; null counts as a text without words."""
    parts: list[dict[str, np.ndarray]] = []
    for _, _, flat, offsets in words.blocks(column):
        starts, ends, bounds = words.split(flat, offsets)
        codes, _ = words.dictionary(flat, starts, ends)
        out = {"n_words": np.diff(bounds), "word_chars": _count(flat, offsets, _LEAD), "n_symbols": _count(flat, offsets, _SYMBOL), "n_upper": _count(flat, offsets, _UPPER), "n_marks": _count(flat, offsets, _MARK), "n_digits": _count(flat, offsets, _DIGIT), "n_repeat_words": repeated(codes, bounds)}
        same = np.zeros(len(codes) + 1, np.int64)
        if len(codes):
            twin = np.append(False, codes[1:] == codes[:-1])
            twin[bounds[:-1][bounds[:-1] < len(codes)]] = False
            np.cumsum(twin, out=same[1:])
        out["n_same"] = np.diff(same[bounds])
        lines, dups = [], []
        for i in range(len(offsets) - 1):
            own = [x for x in flat[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
            lines.append(len(own))
            dups.append(len(own) - len(set(own)))
        parts.append(out | {"n_lines": np.array(lines, np.int64), "n_dup_lines": np.array(dups, np.int64)})
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in STATS}


def with_stats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, statistics) of every whole text, one row for each input row. A null or empty text has zeros everywhere."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k], pa.int64()) for k in STATS)], ["doc_id", *STATS])

    schema = f"doc_id {kind}, " + ", ".join(f"{k} long" for k in STATS)
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


#: Ratios over which conditions are learned, as SQL over the statistics; a text without words has 0.
RATIOS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "same_rate": "n_same / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (ratio, is at least, threshold); matching texts are judged bad."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, least, t in self.conditions:
            out &= x[name] >= t if least else x[name] < t
        return out

    def sql(self) -> str:
        return " AND ".join(f"({RATIOS[n]}) {'>=' if least else '<'} {t!r}D" for n, least, t in self.conditions)


def _gain(pos: float, neg: float, pos0: float, neg0: float) -> float:
    return 0.0 if pos == 0 else pos * (math.log2(pos / (pos + neg)) - math.log2(pos0 / (pos0 + neg0)))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> Rule:
    chosen: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), bool)
    while len(chosen) < most and (~bad[inside]).any():
        pos0, neg0, best = bad[inside].sum(), (~bad[inside]).sum(), (1e-9, None)
        for name in x:
            v = x[name][inside]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, cuts), method="nearest")):
                up = v >= t
                for least, m in ((True, up), (False, ~up)):
                    g = _gain(float(bad[inside][m].sum()), float((~bad[inside][m]).sum()), float(pos0), float(neg0))
                    if g > best[0]:
                        best = (g, (name, least, float(t)))
        if best[1] is None:
            break
        chosen.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return Rule(tuple(chosen))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = r.covers(x)
        p, n = bad[c].sum(), (~bad[c]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule.conditions) > 1 and worth(shorter := Rule(rule.conditions[:-1])) >= worth(rule):
        rule = shorter
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_rules: int = 16, most_conditions: int = 4, cuts: int = 64, least_support: int = 5) -> list[Rule]:
    """Sequential covering over labelled ratios. Deterministic: the third used for pruning is every third row."""
    rules: list[Rule] = []
    held = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        g, p = left & ~held, left & held
        if bad[g].sum() < least_support:
            break
        rule = _prune(_grow({k: v[g] for k, v in x.items()}, bad[g], most_conditions, cuts), {k: v[p] for k, v in x.items()}, bad[p])
        if not rule.conditions:
            break
        c = rule.covers(x) & left
        if bad[c].sum() < least_support or bad[c].mean() < precision:
            break
        rules.append(rule)
        left &= ~c
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered CASE expression over the statistics: false for texts that a rule calls bad."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN false" for r in rules) + " ELSE true END")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, seed: int = 11, **learning) -> list[Rule]:
    """Learn from at most `sample_rows` labelled documents, chosen by a hash of doc_id. Without labels: no rule."""
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    marked = sampled(marked.groupBy("doc_id").agg(F.min("quality").alias("quality")), sample_rows, seed)
    chosen = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # at most sample_rows ids
    rows = with_stats(chosen).join(F.broadcast(marked), "doc_id").selectExpr("doc_id", "quality", *(f"{sql} AS {n}" for n, sql in RATIOS.items())).orderBy("doc_id", *RATIOS).limit(2 * sample_rows).toPandas()  # doc_ids can repeat
    rows = rows.sort_values(["doc_id", *RATIOS], kind="stable")
    if rows.empty:
        return []
    return learn({n: rows[n].to_numpy(float) for n in RATIOS}, rows["quality"].to_numpy() == 0, **learning)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every document's statistics with base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: false if base_failed, else the
    verdict of the decision list. Null and empty texts fail the base rules; repeated rows are judged each by itself; an
    empty table gives no rows; other columns of docs are neither read nor returned."""
    out = with_stats(docs).withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    return out.withColumn("rule_kept", verdict(rules)).withColumn("kept", F.expr("NOT base_failed AND rule_kept"))
