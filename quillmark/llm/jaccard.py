"""N-gram Jaccard join in Voronoi cells around pivots.

Documents are sets of word n-gram hashes; 1 - Jaccard is a metric. Most documents stand at distance 1 from each other, where no
triangle inequality tells them apart, so sets are gathered first where distances fall below 1. The first members of every set in
one global order (rare before frequent) hold a common member for any two linked sets; all sets that share such a member meet at
the least of them, unless their sizes, and where the member stands in each, leave no room for a link. There, counts of their
members in hash buckets are compared: the sum of differences between two such vectors is no more than the symmetric difference
of the sets, so pairs beyond the bound can't be linked. The components of what is left (galaxies) hold every link. As packed
hashes, sets of galaxies that fit one task go straight to it; those of larger galaxies are written out, as they are met again.

A galaxy is the first region. While a region is too large for a task, by sets or by members, pivots are drawn from it, as many
as its size asks for. Every set goes to the Voronoi cell of its nearest pivot, and is replicated to each cell whose pivot is
farther than the nearest one by no more than twice the threshold: by the triangle inequality, two linked sets meet in the home
cell of either. Sets within the threshold of a pivot are linked to it. Pairs inside a galaxy's core (the part that is linked
already) need no look, so only cells with a home set outside of the core go on, recursively. Cells that stop shrinking are
joined in blocks, home sets against all. Small cells are joined within a task, by the same recursion in memory. Links go to
components; copies were one set from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import words
from quillmark.llm.common import materialize, maybe_among, releasing
from quillmark.llm.graph import components


@dataclass(frozen=True)
class Shape:
    """Links: 100 * intersection >= percent * union. room_sets and room: most sets and members of a region that one task joins.
    All but percent and width choose ways, not results."""

    width: int = 5
    percent: int = 80
    count_bits: int = 24
    slice_bits: int = 18
    hot: int = 6
    part: int = 512
    block: int = 256
    buckets: int = 256
    load: int = 8
    guides: int = 16
    room_sets: int = 256
    room: int = 1 << 20
    pivots: int = 64
    leaf: int = 24
    stuck: float = 0.8
    levels: int = 8
    name_bits: int = 64

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100


def sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct n-gram hashes; of fewer words, one hash of them all; of none, nothing."""
    for _, _, flat, offsets in words.blocks(column):
        flat = words.LOWER[flat]
        starts, ends, bounds = words.split(flat, offsets)
        values = words.hashed(flat, starts, ends)
        at, h = words.windows(values, bounds, width)
        cut = np.searchsorted(at, bounds)
        for i in range(len(bounds) - 1):
            n = bounds[i + 1] - bounds[i]
            if n >= width:
                yield np.unique(h[cut[i] : cut[i + 1]])
            elif n:
                yield np.array([xxhash.xxh3_64_intdigest(values[bounds[i] : bounds[i + 1]].tobytes(), int(n))], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def names_of(s: np.ndarray, shape: Shape) -> tuple[int, int] | tuple[None, None]:
    """A 128-bit name of a set, in two halves: one class for all documents that have it; nulls for the empty set."""
    if not len(s):
        return None, None
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return _signed(x >> 64) >> (64 - shape.name_bits), _signed(x & (1 << 64) - 1)


Clashes = dict[tuple[int, int], int]


def key_of(s: np.ndarray, shape: Shape, clashes: Clashes) -> int | None:
    """The first half of a set's name, or what stands for it where several sets share that half."""
    name = names_of(s, shape)
    return clashes.get(name, name[0])


def prefix(n: int, percent: int) -> int:
    """How many first members of a set of n hold a common one for every linked set."""
    return n - -(-n * percent // 100) + 1


#: Sizes from which the next code holds, about 8 % apart: larger sizes never have lesser codes.
CODES = np.unique(np.ceil(2.0 ** (np.arange(1, 256) / 9)).astype(np.int64))


def _code(n: np.ndarray | int) -> np.ndarray:
    return np.searchsorted(CODES, n, "right").astype(np.uint8)


def largest(n: int, at: np.ndarray, percent: int) -> np.ndarray:
    """The most members of a set that is linked to a set of n, if their first common member is at this position of it, from 0: at most
    n - at are in common then, and a link asks for percent / (100 + percent) of both sizes together."""
    return np.maximum((100 + percent) * (n - at) // percent - n, 0) if percent else np.full(len(at), CODES[-1])


def resolution(n: int, shape: Shape) -> int:
    """Into how many buckets the members of a set of n are counted: at most `load` of them in each, on average."""
    most = shape.buckets
    while most * shape.load < n:
        most *= 2
    return most


def _vector(s: np.ndarray, shape: Shape) -> bytes:
    size = resolution(len(s), shape)
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % size, minlength=size), 255).astype(np.uint8).tobytes()


def _read(docs: DataFrame, shape: Shape) -> DataFrame:
    """(_r, _q, doc_id, n, k, k2, v) for each document; and (slice, counts) with how often each bucket's n-grams occur in a task."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["_r", "_q", "doc_id", "n", "k", "k2", "v", "slice", "counts"]
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    types = [pa.int64(), pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << shape.count_bits, np.uint16)
        mask, size = np.uint64((1 << shape.count_bits) - 1), 1 << shape.slice_bits
        for b in batches:
            own = []
            for s in sets(b.column(3), shape.width):
                at = (s & mask).astype(np.int64)
                counts[at] += counts[at] < 60_000
                own.append((len(s), *names_of(s, shape), _vector(s, shape)))
            columns = [pa.array(x, t) for x, t in zip(zip(*own), types[3:7])] if own else [pa.nulls(0, t) for t in types[3:7]]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns, pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary())], names)
        low, pack = np.minimum(counts, 255).astype(np.uint8).reshape(-1, size), zstandard.ZstdCompressor(1)
        some = [i for i in range(len(low)) if low[i].any()]
        if some:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), t) for t in types[:7]), pa.array(some, pa.int32()), pa.array([pack.compress(low[i].tobytes()) for i in some], pa.binary())], names)

    return docs.select(*_row(), "doc_id", "text").mapInArrow(releasing(run), f"_r long, _q long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, k long, k2 long, v binary, slice int, counts binary")


def _row() -> list:
    """Two hashes that name a row's content."""
    return [F.xxhash64("doc_id", "text").alias("_r"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_q")]


def _clashes(read: DataFrame) -> Clashes:
    """Other keys for sets that share the first half of their names: about n * n / 2 ** 65 of n sets, so a few dozen of 3e10."""
    named = read.select("k", "k2").where("k is not null")
    keys = [r["k"] for r in named.groupBy("k").agg(F.min("k2").alias("_a"), F.max("k2").alias("_z")).where("_a <> _z").select("k").collect()]
    shared = named.where(F.col("k").isin(keys)).groupBy("k").agg(F.collect_set("k2").alias("_all")).collect() if keys else []
    return {(r["k"], k2): _signed(xxhash.xxh3_64_intdigest(f"{r['k']}:{k2}")) for r in shared for k2 in r["_all"]}


def _ranks(counts: DataFrame, shape: Shape) -> np.ndarray:
    """How frequent each bucket is, as a power of two over the mean: one byte for each of a fixed number of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1)):
                have = total.setdefault(s, np.zeros(1 << shape.slice_bits, np.uint64))
                have += np.frombuffer(zstandard.decompress(c.as_py()), np.uint8)
        if total:
            out = [np.floor(np.log2(np.maximum(v / max(v.mean(), 1.0), 1))).astype(np.uint8).tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], ["slice", "ranks"])

    slices = 1 << (shape.count_bits - shape.slice_bits)
    out = np.zeros((slices, 1 << shape.slice_bits), np.uint8)
    got = counts.where("slice is not null").select("slice", "counts").repartition(slices, "slice").mapInArrow(releasing(run), "slice int, ranks binary").toArrow()  # 2 ** count_bits bytes
    for b in got.to_batches():
        for s, r in zip(b.column(0).to_pylist(), b.column(1)):
            out[s] = np.frombuffer(r.as_buffer(), np.uint8)
    return out.ravel()


def _first(s: np.ndarray, ranks: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The set's first members in the global order, and their ranks."""
    rank = ranks[(s & np.uint64((1 << shape.count_bits) - 1)).astype(np.int64)]
    m = prefix(len(s), shape.percent)
    order = np.lexsort((s, rank))[:m]
    return s[order], rank[order]


def _given(docs: DataFrame, ranks, clashes: Clashes, shape: Shape, parts: int) -> DataFrame:
    """(k, p): each set's meeting points, by the members of its prefix. Members of high rank, which a fixed share of all sets may
    hold, go as rows to aggregations and joins that can be split; all others are packed by hash, in 14 bytes: the set, half of the
    member (a part has few, so halves that agree by chance cost some candidates), and codes of the set's size and of the largest that may
    be linked to it there. Where a list, by size, has a step that no set before it reaches across, no link does: each side has its own meeting point."""

    def run(batches: Iterator[pa.RecordBatch], frequent: bool) -> Iterator[pa.RecordBatch]:
        own = ranks.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t, *own = (np.concatenate(x) for x in zip(*held))
            held.clear()
            to = (words.mix(t) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, columns = to[order], [x[order] for x in (own[0], (t >> np.uint64(32)).astype(np.uint32), *own[1:])]
            at = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
            some = [b"".join(x[a:b].tobytes() for x in columns) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(to[at[:-1]], pa.int32()), pa.array(some, pa.binary())], ["part", "packed"])

        for b in batches:
            hot_t, hot_k, seen = [], [], set()
            for s in sets(b.column(0), shape.width):
                k = key_of(s, shape, clashes)
                if k is None or k in seen:
                    continue
                seen.add(k)
                t, rank = _first(s, own, shape)
                hot = rank >= shape.hot
                if frequent:
                    if hot.any():
                        hot_t.append(t[hot].view(np.int64))
                        hot_k.append(np.full(int(hot.sum()), k))
                    continue
                where = np.flatnonzero(~hot)
                held.append((t[where], np.full(len(where), k), np.full(len(where), _code(len(s))), _code(largest(len(s), where, shape.percent))))
                size += len(where)
                if size > 1 << 20:
                    yield from flush()
                    size = 0
            if hot_t:
                t, k = np.concatenate(hot_t), np.concatenate(hot_k)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(k)], ["t", "k"])
        if size:
            yield from flush()

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(x.as_buffer()) for b in batches for x in b.column(0)]
        if not held:
            return
        k, p = _met(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        other = k != p
        k, p = k[other], p[other]
        order = np.lexsort((p, k))
        k, p = k[order], p[order]
        new = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])) if len(k) else np.zeros(0, bool)
        k, p = k[new], p[new]
        for i in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)]), pa.array(p[i : i + (1 << 16)])], ["k", "p"])

    texts = docs.select("text").where("text is not null")
    packed = texts.mapInArrow(releasing(lambda batches: run(batches, False)), "part int, packed binary").repartition(parts, "part").select("packed").mapInArrow(releasing(star), "k long, p long")
    hot = materialize(texts.mapInArrow(releasing(lambda batches: run(batches, True)), "t long, k long").distinct())
    least = materialize(hot.groupBy("t").agg(F.min("k").alias("p"), F.max("k").alias("_z")).where("p <> _z").select("t", "p"))
    met = hot.join(least, "t").where("k <> p").select("k", "p")
    return packed.unionByName(met).distinct()


def _unpacked(packed: pa.Buffer) -> list[np.ndarray]:
    """Sets, halves of members, codes of sizes and of the largest sizes."""
    n = packed.size // 14
    return [np.frombuffer(packed, kind, n, at * n) for kind, at in ((np.int64, 0), (np.uint32, 8), (np.uint8, 12), (np.uint8, 13))]


def _met(k: np.ndarray, t: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, p): where the sets k that hold t meet, if codes n are their sizes and `most` the largest that may be linked to them there."""
    order = np.lexsort((n, t))
    k, t, n, most = k[order], t[order], n[order], most[order]
    head = np.append(True, t[1:] != t[:-1])[: len(t)]
    lists = np.cumsum(head)
    reach = np.maximum.accumulate(lists * 256 + most) - lists * 256  # of all up to here in the list
    head[1:] |= n[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return k, np.repeat(np.minimum.reduceat(k, at), np.diff(np.append(at, len(k)))) if len(k) else k


class Groups:
    """Which of n things are linked, directly or not."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether that linked what wasn't."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of runs of equal keys, the first columns; a row has the other columns."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)
        held.clear()
        return b

    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield out()
    if held:
        yield out()


ALL, GUIDES, BORDER = 0, 1, 2  # what meets in a part: all sets each other; sets the guides; border sets the members


class Vectors:
    """Bucket counts of sets at every resolution that is asked for, to tell which sets can't be linked."""

    def __init__(self, n: list[int], v: list[bytes], shape: Shape):
        self.n, self.shape = np.array(n, np.int64), shape
        self.v = [np.frombuffer(x, np.uint8) for x in v]
        self.size = np.array([len(x) for x in self.v])
        self.folded: dict[int, np.ndarray] = {}
        self.bound = (100 - shape.percent) / (100 + shape.percent)

    def at(self, size: int) -> np.ndarray:
        """All vectors in `size` buckets; those of fewer are left at 0, as they are compared in fewer. Clipped anew: a bucket that was clipped still is."""
        if size not in self.folded:
            out = np.zeros((len(self.v), size), np.int16)
            for i, x in enumerate(self.v):
                if len(x) >= size:
                    out[i] = np.minimum(x.reshape(-1, size).sum(0, dtype=np.int64), 255)
            self.folded[size] = out
        return self.folded[size]

    def hits(self, i: int, among: np.ndarray) -> np.ndarray:
        """Which of the sets `among` may be linked to set i."""
        n, m, p = self.n[among], int(self.n[i]), self.shape.percent
        out = (n * 100 >= m * p) & (m * 100 >= n * p)
        near = among[out]
        hit = np.zeros(len(near), bool)
        least = np.minimum(self.size[near], self.size[i])
        for size in np.unique(least):
            own, v = least == size, self.at(int(size))
            hit[own] = np.abs(v[near[own]] - v[i]).sum(1) <= (self.n[near[own]] + m) * self.bound + 1e-9
        out[out] = hit
        return out


def _sift(rows: DataFrame, shape: Shape) -> DataFrame:
    """(p, a, b): of rows (p, part, mode, role, k, n, v), pairs that may be linked, as far as they join what isn't joined yet;
    b is null for sets of a GUIDES part that no guide may be linked to. Roles: 0 guides, 1 the border, 2 members."""

    def part(mode: int, held: list[tuple]) -> Iterator[tuple]:
        held.sort(key=lambda r: (r[2], r[1]))
        role, k = np.array([r[0] for r in held]), [r[1] for r in held]
        vectors, groups, every = Vectors([r[2] for r in held], [r[3] for r in held], shape), Groups(len(held)), np.arange(len(held))

        def joined(i: int, among: np.ndarray) -> Iterator[tuple]:
            yield from ((k[i], k[j]) for j in among[vectors.hits(i, among)] if k[i] != k[j] and groups.join(i, int(j)))

        if mode == ALL:
            for i in every:
                yield from joined(int(i), every[i + 1 :])
        elif mode == BORDER:
            members = every[role == 2]
            for i in every[role == 1]:
                yield from joined(int(i), members)
        else:
            guides, left = every[role == 0], every[role == 2]
            yield from ((k[guides[0]], k[g]) for g in guides[1:])  # one galaxy
            for g in guides:
                hit = vectors.hits(int(g), left)
                yield from ((k[j], k[g]) for j in left[hit] if k[j] != k[g])
                left = left[~hit]
            yield from ((k[j], None) for j in left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((p, a, b) for (p, _, mode), held in _grouped(batches, 3) for a, b in part(mode, held))
        yield from _batches(found, ["p", "a", "b"], [pa.int64()] * 3)

    return _dealt(rows, "p", "part").select("p", "part", "mode", "role", "k", "n", "v").mapInArrow(releasing(run), "p long, a long, b long")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Small groups brought together: dealt by a hash, each in one run; roles, if any, in their order."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *(c for c in ("mode", "role") if c in rows.columns))


def _may_link(given: DataFrame, vectors: DataFrame, shape: Shape) -> DataFrame:
    """(a, b): sets that may be linked, so that any two linked sets are in one component.

    Lists of more than `part` sets are split: each part meets the list's guides (its first sets by a hash), and only sets that no guide
    may be linked to (the border) meet all others, in blocks."""
    sizes = given.groupBy("p").agg(F.count(F.lit(1)).alias("m"))
    sizes = materialize(sizes.select("p", F.ceil((F.col("m") + 1) / shape.part).cast("long").alias("parts"), "m"))
    placed = given.unionByName(sizes.selectExpr("p AS k", "p")).join(sizes, "p").select("p", F.expr("pmod(xxhash64(k), parts)").alias("part"), "k", "parts", "m")
    mode = F.when(F.col("parts") > 1, GUIDES).otherwise(ALL).alias("mode")
    # a few times as many as there are guides, of which the first stay
    likely = placed.where(f"parts > 1 and pmod(xxhash64(k, 7L), 1000000007L) <= 4.0D * {shape.guides} / m * 1000000007L").groupBy("p", "parts").agg(F.expr(f"slice(sort_array(collect_set(struct(xxhash64(k, 7L) AS h, k AS k))), 1, {shape.guides})").alias("g"))
    guides = likely.select("p", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(GUIDES).alias("mode"), F.lit(0).alias("role"), F.explode("g.k").alias("k"))
    met = materialize(_sift(placed.select("p", "part", mode, F.lit(2).alias("role"), "k").unionByName(guides).join(vectors, "k"), shape))
    edges = met.where("b is not null").select("a", "b")
    border = met.where("b is null").select("p", F.col("a").alias("k"))
    blocks = materialize(border.groupBy("p").agg(F.count(F.lit(1)).alias("c")).join(sizes, "p").select("p", "parts", F.ceil(F.col("c") / shape.block).cast("long").alias("blocks")))
    if blocks.isEmpty():
        return edges
    number = F.expr("part * blocks + block").alias("part")
    inside = placed.drop("parts", "m").join(blocks, "p").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("p", number, F.lit(BORDER).alias("mode"), F.lit(2).alias("role"), "k")
    border = border.join(blocks, "p").withColumn("block", F.expr("pmod(xxhash64(k), blocks)")).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).select("p", number, F.lit(BORDER).alias("mode"), F.lit(1).alias("role"), "k")
    return edges.unionByName(materialize(_sift(inside.unionByName(border).join(vectors, "k"), shape)).select("a", "b"))


def _packed(docs: DataFrame, wanted: DataFrame, reps: DataFrame, clashes: Clashes, shape: Shape) -> DataFrame:
    """(k, s, ...): the wanted sets (k, ...), each once, as packed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(((key_of(s, shape, clashes), s.tobytes()) for s in sets(b.column(0), shape.width)), ["k", "s"], [pa.int64(), pa.binary()], 2_000)

    wanted = materialize(wanted)
    rows = wanted.join(reps.select("k", "_r"), "k").select("_r")
    some = maybe_among(docs.select(F.xxhash64("doc_id", "text").alias("_r"), "text"), "_r", materialize(rows)).select("text")
    return some.mapInArrow(releasing(run), "k long, s binary").join(wanted, "k").groupBy("k").agg(*(F.first(c).alias(c) for c in ("s", *wanted.columns) if c != "k"))


class Region:
    """Sets by position, with all their members in one sorted list."""

    def __init__(self, held: list[np.ndarray]):
        self.held, self.n = held, np.array([len(s) for s in held])
        tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held)), self.n)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def common(self, s: np.ndarray) -> np.ndarray:
        """How many members of s each set holds."""
        a, b = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        size = b - a
        take = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.owner[take], minlength=len(self.n))

    def compare(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances of all sets to s, and which are linked to it."""
        common = self.common(s)
        union = self.n + len(s) - common
        return 1 - common / union, (common * 100 >= percent * union) & (common > 0)


def cell(held: list[np.ndarray], home: np.ndarray, shape: Shape, groups: Groups | None = None, at: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between home sets and any sets of a region, as positions, as far as they join what isn't joined yet; by Voronoi cells
    while those shrink. `at`: positions of these sets in what groups holds."""
    groups = groups or Groups(len(held))
    at = np.arange(len(held)) if at is None else at
    links: list[tuple[int, int]] = []
    region = Region(held)

    def join(i: int, linked: np.ndarray) -> None:
        links.extend((int(at[i]), int(at[j])) for j in np.flatnonzero(linked) if i != j and groups.join(int(at[i]), int(at[j])))

    def done(members: np.ndarray) -> bool:
        first = groups.root(int(at[members[0]]))
        return all(groups.root(int(at[j])) == first for j in members)

    every = np.arange(len(held))
    if len(held) <= shape.leaf:
        for i in np.flatnonzero(home):
            if not done(every):
                join(i, region.compare(held[i], shape.percent)[1])
        return links
    count = min(shape.pivots, max(2, 2 * len(held) // shape.leaf))
    pivots = np.unique(np.linspace(0, len(held) - 1, count).astype(int))
    far = np.empty((len(held), len(pivots)))
    for c, i in enumerate(pivots):
        far[:, c], linked = region.compare(held[i], shape.percent)
        join(i, linked)
    nearest, least = far.argmin(1), far.min(1)
    for c in range(len(pivots)):
        own = home & (nearest == c)
        members = np.flatnonzero(far[:, c] <= least + 2 * shape.radius + 1e-9)
        if not own.any() or done(members):
            continue
        if len(members) <= shape.stuck * len(held):
            links += cell([held[j] for j in members], own[members], shape, groups, at[members])
            continue
        for i in np.flatnonzero(own):
            if not done(members):
                join(i, region.compare(held[i], shape.percent)[1])
    return links


def _joined(rows: DataFrame, shape: Shape) -> DataFrame:
    """(a, b): links of small regions, rows (g, block, k, home, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            for _, held in _grouped(batches, 2):
                unique = {k: (home, s) for k, home, s in sorted(held, key=lambda r: r[1])}  # a home set that is met again as any set
                names = sorted(unique)
                for a, b in cell([np.frombuffer(unique[k][1], np.uint64) for k in names], np.array([unique[k][0] for k in names]), shape):
                    yield names[a], names[b]

        yield from _batches(links(), ["a", "b"], [pa.int64(), pa.int64()])

    return _dealt(rows, "g", "block").select("g", "block", "k", "home", "s").mapInArrow(releasing(run), "a long, b long")


def _nearest(rows: DataFrame, shape: Shape) -> DataFrame:
    """(g, k, p, home, linked): the cells of each set of rows (g, part, role, k, s), by its distances to the pivots (role 0): the
    nearest one's, and those in the window. Of the sets (role 2) one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now, pivots, region = None, [], None
            for b in batches:
                for g, part, role, k, s in zip(*(c.to_pylist() for c in b.columns)):
                    if (g, part) != now:
                        now, pivots, region = (g, part), [], None
                    s = np.frombuffer(s, np.uint64)
                    if role == 0:
                        pivots.append((k, s))
                        continue
                    region = region or Region([x for _, x in pivots])
                    far, linked = region.compare(s, shape.percent)
                    nearest = int(far.argmin())
                    for c in np.flatnonzero((far <= far[nearest] + 2 * shape.radius + 1e-9) | linked):
                        yield g, k, pivots[c][0], c == nearest, bool(linked[c])

        yield from _batches(((g, k, p, bool(h), x) for g, k, p, h, x in found()), ["g", "k", "p", "home", "linked"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()])

    return _dealt(rows, "g", "part").select("g", "part", "role", "k", "s").mapInArrow(releasing(run), "g long, k long, p long, home boolean, linked boolean")


def _measured(cells: DataFrame, shape: Shape) -> DataFrame:
    """(g, m, size, parts) of cells (g, k, n, home, top)."""
    room = F.greatest(F.ceil(F.col("size") / shape.room), F.ceil(F.col("m") / shape.room_sets)).cast("long")
    return cells.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), F.max("home").alias("_h")).where("_h").select("g", "m", "size", room.alias("parts"))


def _links(galaxies: DataFrame, vectors: DataFrame, packed: Callable[[DataFrame], DataFrame], shape: Shape) -> DataFrame:
    """(a, b): links between the sets of each galaxy (g, k) that join what is linked. `packed` gives rows (k, ...) their sets."""
    cells = materialize(galaxies.join(vectors.select("k", "n"), "k").select("g", "k", "n", F.lit(True).alias("home"), F.col("g").alias("top")))
    links, large_sets, seeds, level = None, None, None, 0
    small = lambda rows: materialize(_joined(rows.join(large_sets, "k"), shape))
    before = None  # size of the region that a cell comes from
    while True:
        sizes = _measured(cells, shape)
        if before is not None:
            sizes = sizes.join(cells.select("g", "up").distinct(), "g").join(before, "up")
        else:
            sizes = sizes.withColumn("_before", F.lit(None).cast("long"))
        sizes = materialize(sizes.select("g", "m", "size", "parts", (F.coalesce(F.col("m") > shape.stuck * F.col("_before"), F.lit(False)) | F.lit(level >= shape.levels)).alias("stuck")))
        fit = cells.join(sizes.where("parts = 1").select("g"), "g", "left_semi").select("g", F.lit(0).cast("long").alias("block"), "k", "home")
        if links is None:
            links = materialize(_joined(packed(fit), shape))
            more = sizes.where("parts > 1").select("g")
            if more.isEmpty():
                return links
            large_sets = materialize(packed(cells.join(more, "g", "left_semi").select("k")))
        else:
            links = links.unionByName(small(fit))
        stuck = sizes.where("parts > 1 and stuck").select("g", "parts")
        if not stuck.isEmpty():  # home sets in blocks against all sets in blocks
            rows = cells.join(stuck, "g").withColumn("_own", F.expr("pmod(xxhash64(k), parts)"))
            every = rows.withColumn("_b", F.explode(F.expr("sequence(0L, parts - 1)"))).select("g", F.expr("_own * parts + _b").alias("block"), "k", F.lit(False).alias("home"))
            homes = rows.where("home").withColumn("_b", F.explode(F.expr("sequence(0L, parts - 1)"))).select("g", F.expr("_b * parts + _own").alias("block"), "k", "home")
            links = links.unionByName(small(every.unionByName(homes)))
        large = materialize(sizes.where("parts > 1 and not stuck").select("g", "m", "parts"))
        if large.isEmpty():
            return links
        rows = materialize(cells.join(large, "g").select("g", "k", "n", "home", "top", "m", "parts"))
        count = F.least(F.lit(shape.pivots), F.greatest(F.lit(2), F.col("parts") * 4)).cast("int")
        order = f"xxhash64(k, {level}L)"
        first = f"struct({order} AS h, k AS k)"
        some = f"pmod({order}, 1000000007L) <= 4.0D * least({shape.pivots}, greatest(2, parts * 4)) / m * 1000000007L"
        likely = rows.groupBy("g", "parts").agg(F.expr(f"sort_array(array_union(collect_set(CASE WHEN {some} THEN {first} END), array(min({first}))))").alias("_all"))  # a few times as many as are drawn
        drawn = likely.select("g", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(0).alias("role"), F.explode(F.slice("_all.k", F.lit(1), count)).alias("k"))
        dealt = rows.select("g", F.expr("pmod(xxhash64(k), parts)").alias("part"), F.lit(2).alias("role"), "k").unionByName(drawn)
        near = materialize(_nearest(dealt.join(large_sets, "k"), shape))
        links = links.unionByName(materialize(near.where("linked and k <> p").selectExpr("k AS a", "p AS b").distinct()))
        joined = materialize(components(links))
        rows = rows.join(joined.withColumnsRenamed({"node": "k"}), "k", "left").withColumn("_of", F.coalesce("root", "k")).drop("root")
        if seeds is None:  # each galaxy's core: what its largest part then grows to
            parts = rows.groupBy("top", "_of").agg(F.count(F.lit(1)).alias("c"))
            seeds = materialize(parts.groupBy("top").agg(F.max_by("_of", F.struct("c", "_of")).alias("seed")))
        core = seeds.join(joined.withColumnsRenamed({"node": "seed", "root": "_core"}), "seed", "left").select("top", F.coalesce("_core", "seed").alias("_core"))
        rows = rows.join(core, "top").withColumn("home", F.col("home") & (F.col("_of") != F.col("_core")))
        # a set whose distance is 1 to all pivots is in every window: its first row with the least distance is its home
        placed = near.select("g", "k", "p", F.col("home").alias("_nearest")).join(rows.select("g", "k", "n", "home", "top"), ["g", "k"])
        cells = materialize(placed.select(F.xxhash64("g", "p").alias("g"), "k", "n", (F.col("home") & F.col("_nearest")).alias("home"), "top", F.col("g").alias("up")))
        before = large.select(F.col("g").alias("up"), F.col("m").alias("_before"))
        level += 1


def join(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(_r, _q, doc_id, n_shingles, component_id, root) for each document: the least doc_id that links reach, and the component's least set key.

    Null and empty texts, and texts without words, have no n-grams, are linked to nothing, and are their own component.
    Copies are one set. Documents with a null doc_id take part, but null is a component_id only where no other id is reached,
    and different components can share a doc_id: root alone tells them apart. It is null for what has no n-grams. Rows equal in doc_id and text
    are the same document, each returned. Very long texts are read whole. An empty table gives no rows. Other columns are neither read nor
    returned. _r and _q are hashes of doc_id and text. Sets are named by 128 bits, n-grams by 64.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    read = materialize(_read(docs, shape))
    known = read.where("slice is null").select("_r", "_q", "doc_id", "n", "k", "k2", "v")
    clashes = _clashes(known)
    if clashes:
        others = spark.createDataFrame([(*x, y) for x, y in clashes.items()], "k long, k2 long, _other long")
        known = known.join(F.broadcast(others), ["k", "k2"], "left").withColumn("k", F.coalesce("_other", "k")).drop("_other")  # a few dozen rows at most
    ranks = spark.sparkContext.broadcast(_ranks(read, shape))  # 2 ** count_bits bytes, whatever the input
    given = materialize(_given(docs, ranks, clashes, shape, parts))
    reps = materialize(known.where("k is not null").groupBy("k").agg(F.min("_r").alias("_r"), F.min("doc_id").alias("_id")))
    met = materialize(given.select("k").unionByName(given.selectExpr("p AS k")).distinct())
    # an inner join: the optimizer would put a semi-join first, which deals out all sets
    vectors = materialize(maybe_among(known.select("k", "n", "v").where("k is not null"), "k", met).join(met, "k").groupBy("k").agg(F.any_value("n").alias("n"), F.any_value("v").alias("v")))
    galaxies = materialize(components(_may_link(given, vectors, shape)).select(F.col("root").alias("g"), F.col("node").alias("k")))
    joined = components(_links(galaxies, vectors, lambda wanted: _packed(docs, wanted, reps, clashes, shape), shape))
    roots = materialize(reps.join(joined.withColumnsRenamed({"node": "k"}), "k", "left").select("k", "_id", F.coalesce("root", "k").alias("root")))
    least = roots.groupBy("root").agg(F.min("_id").alias("component_id"))
    named = materialize(roots.join(least, "root").select("k", "component_id", "root"))
    out = known.join(named, "k", "left")
    return out.select("_r", "_q", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")
