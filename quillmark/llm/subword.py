"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its words, of its words' character n-grams and of its word pairs, all hashed into
one table of buckets; a softmax layer over that average gives the classes. Numpy trains both by stochastic gradient descent
on a bounded sample of labelled texts. Because the output is linear in the average, scoring needs one number per bucket,
and one sum per distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import words
from quillmark.llm.common import sampled


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 16
    dim: int = 12
    shortest: int = 3
    longest: int = 4
    epochs: int = 6
    least_steps: int = 1200
    rate: float = 2.0
    batch: int = 16
    seed: int = 5


def grams(word: bytes, shape: Shape) -> list[int]:
    """Buckets of a word (whole, then its character n-grams between boundary marks)."""
    chars = f"<{word.decode()}>"
    out = [xxhash.xxh3_64_intdigest(word) % shape.buckets]
    for n in range(shape.shortest, min(shape.longest, len(chars)) + 1):
        out += [xxhash.xxh3_64_intdigest(chars[i : i + n], n) % shape.buckets for i in range(len(chars) - n + 1)]
    return out


def _pairs(h: np.ndarray, bounds: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each pair of neighbouring words; a word beside itself is one common pair."""
    n = len(h) - 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(bounds, np.arange(len(h)), "right") - 1
    inside = row[:-1] == row[1:]
    key = np.where(h[:-1] == h[1:], np.uint64(17), words.mix(h[:-1] * np.uint64(3) + h[1:]))
    return row[:-1][inside], (key % np.uint64(shape.buckets)).astype(np.int64)[inside]


def _read(flat: np.ndarray, offsets: np.ndarray):
    flat = words.LOWER[flat]
    starts, ends, bounds = words.split(flat, offsets)
    codes, distinct = words.dictionary(flat, starts, ends)
    return codes, distinct, bounds


def features(column: pa.Array, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights that sum to 1) of each row, for training."""
    for _, _, flat, offsets in words.blocks(column):
        codes, distinct, bounds = _read(flat, offsets)
        own = [np.array(grams(w, shape), np.int64) for w in distinct]
        h = words.hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        pair_row, pair_bucket = _pairs(h, bounds, shape)
        pair_at = np.searchsorted(pair_row, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            mine, n = np.unique(codes[bounds[i] : bounds[i + 1]], return_counts=True)
            b = np.concatenate([*(own[w] for w in mine), pair_bucket[pair_at[i] : pair_at[i + 1]]]) if len(mine) else np.zeros(0, np.int64)
            w = np.concatenate([*(np.full(len(own[c]), k, float) for c, k in zip(mine, n)), np.ones(pair_at[i + 1] - pair_at[i])]) if len(mine) else np.zeros(0)
            at, where = np.unique(b, return_inverse=True)
            total = np.bincount(where, w, len(at))
            yield at, total / max(total.sum(), 1.0)


@dataclass(frozen=True)
class Model:
    """logits[b]: what bucket b adds to (class 1 minus class 0); bias: of a text without words."""

    shape: Shape
    logits: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, flat, offsets in words.blocks(column):
            codes, distinct, bounds = _read(flat, offsets)
            rows = len(offsets) - 1
            if not len(codes):
                out.append(np.zeros(rows))
                continue
            own = [self._word(w) for w in distinct]
            value, size = np.array([x[0] for x in own]), np.array([x[1] for x in own], float)
            row = np.repeat(np.arange(rows), np.diff(bounds))
            total, n = np.bincount(row, value[codes], rows), np.bincount(row, size[codes], rows)
            pair_row, bucket = _pairs(words.hashes(distinct)[codes], bounds, self.shape)
            total += np.bincount(pair_row, self.logits[bucket], rows)
            n += np.bincount(pair_row, minlength=rows)
            out.append(total / np.maximum(n, 1))
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))

    def _word(self, word: bytes) -> tuple[float, int]:
        got = _SUMS.get(word)
        if got is None:
            if len(_SUMS) > 500_000:
                _SUMS.clear()
            b = grams(word, self.shape)
            got = _SUMS[word] = (float(self.logits[b].sum()), len(b))
        return got


_SUMS: dict[bytes, tuple[float, int]] = {}
_SUMS_OF: list[int] = [0]


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, shape: Shape) -> Model:
    """Stochastic gradient descent over embeddings and output layer; deterministic for the same rows in the same order."""
    rng = np.random.default_rng(shape.seed)
    table = rng.uniform(-1 / shape.dim, 1 / shape.dim, (shape.buckets, shape.dim)).astype(np.float32)
    layer, bias = np.zeros((2, shape.dim), np.float32), np.zeros(2, np.float32)
    each = max(1, -(-len(rows) // shape.batch))
    epochs = max(shape.epochs, -(-shape.least_steps // each))
    steps, step = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), shape.batch):
            part = order[k : k + shape.batch]
            rate, step = shape.rate * (1 - step / steps), step + 1
            b = np.concatenate([rows[i][0] for i in part])
            w = np.concatenate([rows[i][1] for i in part]).astype(np.float32)
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            mean = np.stack([np.bincount(of, w * table[b, d], len(part)) for d in range(shape.dim)], 1).astype(np.float32)
            z = mean @ layer.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = p @ layer
            layer -= rate * (p.T @ mean) / len(part)
            bias -= rate * p.mean(0)
            np.subtract.at(table, b, rate * w[:, None] * back[of])
    logit = table @ (layer[1] - layer[0])
    return Model(shape, logit.astype(float), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, shape: Shape = Shape(), seed: int = 7) -> Model:
    """Train on at most `sample_rows` labelled doc_ids, chosen by a hash of doc_id. Without labels every score is 0.5.

    A doc_id's documents all take part, with the least of its labels; of more than twice `sample_rows` documents the first by doc_id and text.
    Their order, null texts first, doesn't depend on how rows are dealt, so neither does the model."""
    marked = sampled(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), sample_rows, seed)
    chosen = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # at most sample_rows ids
    got = chosen.orderBy("doc_id", "text").limit(2 * sample_rows).toArrow()
    order = sorted(range(got.num_rows), key=[(i, t is not None, t or "") for i, t in zip(got["doc_id"].to_pylist(), got["text"].to_pylist(), strict=True)].__getitem__)
    got = got.take(pa.array(order, pa.int64()))
    y = (got["quality"].to_numpy() == 1).astype(int)
    if not len(y):
        return Model(shape, np.zeros(shape.buckets), 0.0)
    return train(list(features(got["text"].combine_chunks(), shape)), y, shape)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text: the probability of class 1.

    Null and empty texts get the output layer's bias alone; repeated rows are scored each by itself; an empty table gives no
    rows; other columns of docs, whatever their names, are neither read nor returned."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _SUMS_OF[0] != hash(shared.value.logits.tobytes()):
            _SUMS.clear()
            _SUMS_OF[0] = hash(shared.value.logits.tobytes())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
