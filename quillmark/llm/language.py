"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed character n-grams (within words, with boundary marks), scaled to length 1. Each
language has several centroids, clustered by cosine from a bounded sample. A text gets the language of the centroid
nearest by cosine, and is rejected when that is farther than nearly all of the language's own sample of that length: the
cosine grows with the number of distinct n-grams, so the bar is learned from cuts of the sample, by classes of that number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import words

UNDETERMINED = "und"


@dataclass(frozen=True)
class Shape:
    buckets: int = 4096
    longest: int = 3
    centroids: int = 4
    rounds: int = 8
    sample_rows: int = 600
    sample_total: int = 8_000
    least_rows: int = 16
    reject_quantile: float = 0.002
    reject_margin: float = 0.9
    cuts: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64, 128)
    seed: int = 3


_ALPHA: list[np.ndarray] = []  # whether a code point is a letter; made once in a process
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _letters() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, and the row of each: letters, and one blank before and after each word. A blank
    between rows belongs to the row that it ends; all else is left out."""
    low = [t.lower() for t in texts]
    points = np.frombuffer((" " + "".join(t + " " for t in low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    kept = np.flatnonzero(_letters()[points] | blank)
    blank = blank[kept]
    again = np.zeros(len(kept), bool)
    again[1:] = blank[1:] & blank[:-1]
    kept = kept[~again]
    return np.where(blank[~again], np.uint32(32), points[kept]), row[np.maximum(kept, 1) - 1]


def _tally(points: np.ndarray, row: np.ndarray, rows: int, shape: Shape) -> np.ndarray:
    """How often each of `rows` rows has n-grams of each bucket; points begin one place before the first row's."""
    out = np.zeros(rows * shape.buckets)
    step = 1 << 17
    for at in range(0, len(points), step):
        c = points[at : at + step + shape.longest - 1].astype(np.uint64)
        r = row[at : at + len(c)].astype(np.int64) * shape.buckets
        blank = c == 32
        x, ok, hits = c.copy(), ~blank, []  # the gram that ends at a place, and whether its inside has no blank
        for n in range(1, shape.longest + 1):
            if n > 1:
                x = x[:-1] * _ODD + c[n - 1 :]
                ok = ~(blank[:-1] & blank[1:]) if n == 2 else ok[:-1] & ~blank[n - 2 : len(c) - 1] if n > 3 else ~blank[1:-1]
            first = 0 if n == 1 else 1  # a gram belongs to the row of its second character
            use = ok[:step]
            bucket = ((x[:step][use] * _OTHER) >> np.uint64(40)) % np.uint64(shape.buckets)
            hits.append(r[first : first + len(use)][use] + bucket.astype(np.int64))
        out += np.bincount(np.concatenate(hits), minlength=len(out))
    return out.reshape(rows, shape.buckets)


def vectors(column: pa.Array, shape: Shape, idf: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: (a dense matrix of their vectors, whether each has a letter). Without idf: of the counts."""
    for i, j, _, _ in words.blocks(column, 1 << 20):
        texts = [t or "" for t in column[i:j].to_pylist()]
        points, row = stream(texts)
        has = np.bincount(row[points != 32], minlength=len(texts)) > 0
        for r in range(0, len(texts), 128):
            to = min(len(texts), r + 128)
            a, b = np.searchsorted(row, [r, to])
            a = max(a - 1, 0)
            own = np.maximum(row[a:b] - r, 0)
            m = _tally(points[a:b], own, to - r, shape)
            if idf is not None:
                np.log1p(m, out=m)
                m *= idf
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            yield m, has[r:to]


def length_class(m: np.ndarray) -> np.ndarray:
    """Half octaves of the number of distinct n-grams of each row."""
    return np.floor(2 * np.log2(np.maximum((m > 0).sum(1), 1))).astype(int)


def bars(texts: list[str], centroids: np.ndarray, shape: Shape, idf: np.ndarray) -> np.ndarray:
    """By length class, the least cosine to the centroids of the language of these texts that isn't rejected: learned from the whole texts and from
    runs of their words. A class without texts takes the bar of the class below; what is shorter than all of them is not rejected."""
    split = [t.split() for t in texts]
    runs = {" ".join(w[at : at + n]) for w in split for n in shape.cuts for at in (0, len(w) // 2)}
    cos, of = [], []
    for m, has in vectors(pa.array(sorted(runs | {*texts}), pa.large_string()), shape, idf):
        cos.append((m @ centroids.T).max(1)[has])
        of.append(length_class(m)[has])
    cos, of = np.concatenate(cos), np.concatenate(of)
    out = np.zeros(2 * shape.buckets.bit_length() + 1)
    for k in range(len(out)):
        own = cos[of == k]
        out[k] = shape.reject_margin * float(np.quantile(own, shape.reject_quantile)) if len(own) else out[max(k - 1, 0)]
    return out


@dataclass(frozen=True)
class Model:
    shape: Shape
    idf: np.ndarray
    centroids: np.ndarray  # one row for each centroid, of length 1
    of: np.ndarray  # its language
    names: tuple[str, ...]
    farthest: np.ndarray  # by language and length class, the least cosine that isn't rejected

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        names, score, rejected = [], [], []
        for m, has in vectors(column, self.shape, self.idf):
            if not len(self.names):
                names += [UNDETERMINED] * len(m)
                score.append(np.zeros(len(m)))
                rejected.append(np.ones(len(m), bool))
                continue
            cos = m @ self.centroids.T
            best = cos.argmax(1)
            lang = self.of[best]
            top = np.clip(cos[np.arange(len(m)), best], 0, 1)
            names += [self.names[k] if h else UNDETERMINED for k, h in zip(lang, has)]
            score.append(np.where(has, top, 0.0))
            rejected.append(~has | (top < self.farthest[lang, length_class(m)]))
        return names, np.concatenate(score) if score else np.zeros(0), np.concatenate(rejected) if rejected else np.zeros(0, bool)


def cluster(m: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centroids of rows of length 1, by cosine."""
    k = min(k, len(m))
    c = m[rng.choice(len(m), k, replace=False)]
    for _ in range(rounds):
        of = (m @ c.T).argmax(1)
        c = np.stack([m[of == j].sum(0) if (of == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, shape: Shape = Shape()) -> Model:
    """Learn from (doc_id, text, lang) rows: at most `sample_rows` texts of each language, or `sample_total` in all but `least_rows` of each, the
    first by a hash of doc_id and text; rows without lang or text are left out. Every language is learned."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    if not sizes:
        return Model(shape, np.zeros(shape.buckets), np.zeros((0, shape.buckets)), np.zeros(0, int), (), np.zeros(0))
    each = max(shape.least_rows, min(shape.sample_rows, shape.sample_total // len(sizes)))
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, 1.5 * each / r["count"] + 100 / r["count"])) for r in sizes], "lang string, _share double")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(shape.seed), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    likely = known.join(F.broadcast(shares), "lang").where(u < F.col("_share")).withColumn("_u", u)
    line = Window.partitionBy("lang").orderBy("_u", "doc_id", "text")  # about 1.5 * each + 100 rows of a language
    got = likely.withColumn("_at", F.row_number().over(line)).where(F.col("_at") <= each).select("doc_id", "text", "lang").toArrow()
    order = sorted(range(got.num_rows), key=[(str(d), t) for d, t in zip(got["doc_id"].to_pylist(), got["text"].to_pylist())].__getitem__)
    got = got.take(pa.array(order, pa.int64()))
    text, lang = got["text"].combine_chunks(), np.array(got["lang"].to_pylist(), object)
    df, unit, at = np.zeros(shape.buckets), np.zeros((len(text), shape.buckets), np.float32), 0
    for m, _ in vectors(text, shape, None):
        df += (m > 0).sum(0)
        unit[at : at + len(m)] = m
        at += len(m)
    idf = np.log((1 + len(unit)) / (1 + df)) + 1
    for part in np.array_split(unit, max(1, len(unit) // 128)):  # in place: the one large matrix of the sample
        np.log1p(part, out=part)
        part *= idf.astype(np.float32)
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    rng, names = np.random.default_rng(shape.seed), tuple(sorted({*lang}))
    centroids, of, farthest = [], [], []
    for k, name in enumerate(names):
        own = unit[lang == name]
        c = cluster(own, shape.centroids, shape.rounds, rng)
        centroids.append(c)
        of += [k] * len(c)
        farthest.append(bars(text.filter(pa.array(lang == name)).to_pylist(), c, shape, idf))
    return Model(shape, idf, np.concatenate(centroids), np.array(of), names, np.array(farthest))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, lang_score (cosine, 0 to 1) and lang_rejected, for every whole text.

    A text that is null or has no letter is `und` with score 0 and rejected. A tie goes to the first centroid, in the order
    of the languages' names. Repeated rows are judged each by itself, an empty table gives no rows, and all columns of docs
    are kept; columns named lang_pred, lang_score or lang_rejected are replaced."""
    new = ["lang_pred", "lang_score", "lang_rejected"]
    docs = docs.drop(*new)  # in any case of letters
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x buckets
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, rejected = shared.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*b.schema.names, *new])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    return docs.mapInArrow(run, schema)
