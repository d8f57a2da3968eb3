"""Packing documents into fixed windows by minimum bin slack.

Each document's ids are cut at multiples of the capacity; the full windows stand alone and the remaining length joins a
pool. While the pool holds enough pieces, the largest one opens a window and a bitset subset-sum over the multiset of the
remaining lengths (Python integers as bitsets, descending lengths with counts) finds the reachable sum closest to the
capacity; backtracking over the stored bitsets gives how many pieces of each length to take. What a partition has left
at its end is cut into windows of powers of two, which need no padding.

Everything happens in one pass over each input partition, without a shuffle. The pool is bounded, so memory is too.
"""

from __future__ import annotations

import gc
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import words
from quillmark.llm.common import release

LETTER, NUMBER, OTHER, WHITE, UNKNOWN = 1, 2, 3, 4, 9


def _classes() -> np.ndarray:
    """Classes of UTF-8 bytes. A text with a byte of class UNKNOWN is encoded as a whole by the tokenizer."""
    c = np.full(256, UNKNOWN, np.uint8)
    c[0x00:0x1C] = OTHER
    c[0x21:0x80] = OTHER
    c[[0x20, *range(0x09, 0x0E)]] = WHITE
    c[0x30:0x3A] = NUMBER
    c[0x41:0x5B] = c[0x61:0x7B] = LETTER
    c[0xC3:0xCA] = LETTER  # U+00C0 to U+027F; the two signs among them are sorted out below
    c[0x80:0xC0] = 0  # continues a character
    return c


CLASSES = _classes()


class Encoder:
    """Ids by a byte-level BPE tokenizer, each distinct pre-token encoded once, while it is remembered: of more than MOST, those stay that were met
    again since the last time, half of MOST at most."""

    MOST = 600_000
    AT_ONCE = 4_096  # an encoding takes about a kilobyte besides its ids

    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def _thin(self) -> None:
        """Forget pieces that were not met again."""
        stay = np.flatnonzero(self.again)[: self.MOST // 2]
        pieces = list(self.known)  # by number, as they were added
        size = self.at[stay + 1] - self.at[stay]
        ends = np.zeros(len(stay) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        self.flat = self.flat[np.repeat(self.at[stay] - ends[:-1], size) + np.arange(ends[-1])]
        self.known = {pieces[i]: k for k, i in enumerate(stay.tolist())}
        self.at, self.again = ends, np.zeros(len(stay), bool)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece in the table of encoded pieces."""
        if len(self.known) > self.MOST:
            self._thin()
        known, n = self.known, len(self.known)
        number = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        first = number < 0
        self.again[number[~first]] = True
        new = dict.fromkeys(compress(pieces, first.tolist()))
        if new:
            texts = [p.decode() for p in new]
            ids = [e.ids for i in range(0, len(texts), self.AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[i : i + self.AT_ONCE], add_special_tokens=False)]
            known.update(zip(new, range(n, n + len(new))))
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) + len(self.flat)
            self.at = np.concatenate([self.at, ends])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            number[first] = np.fromiter(map(known.__getitem__, compress(pieces, first.tolist())), np.int64)
        return number

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row's whole text; null is empty."""
        for i, j, flat, offsets in words.blocks(column):
            odd = self._odd(flat, offsets) | self._has_added(flat, offsets)
            ids, ends = self._block(flat, offsets, odd) if len(flat) else (np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64))
            for k in range(j - i):
                if odd[k]:
                    yield self.whole(flat[offsets[k] : offsets[k + 1]].tobytes().decode())
                else:
                    yield ids[ends[k] : ends[k + 1]]

    @staticmethod
    def _odd(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bad = CLASSES[flat] == UNKNOWN
        if len(flat) > 1:
            bad[1:] |= (flat[:-1] == 0xC3) & ((flat[1:] == 0x97) | (flat[1:] == 0xB7))
        total = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(bad, out=total[1:])
        return np.diff(total[offsets]) > 0

    def _has_added(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with the content of an added token, which the tokenizer takes out before it splits the text: they are encoded as a whole."""
        out, data = np.zeros(len(offsets) - 1, bool), flat.tobytes()
        for content in self.added:
            at = data.find(content)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(content) <= offsets[k + 1]:
                    out[k] = True
                    at = data.find(content, int(offsets[k + 1]))
                else:
                    at = data.find(content, at + 1)
        return out

    def _block(self, flat: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.boundaries(flat, offsets)
        for k in np.flatnonzero(odd):  # these rows are encoded elsewhere: one piece, which isn't looked at
            begin[offsets[k] + 1 : offsets[k + 1]] = False
        starts = np.flatnonzero(begin)
        row_at = np.searchsorted(starts, offsets)
        bounds = np.append(starts, len(flat)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        index = coded.indices.to_numpy()
        pieces = coded.dictionary.to_pylist()
        if odd.any():
            skip = np.zeros(len(pieces), bool)
            for k in np.flatnonzero(odd):
                skip[index[row_at[k] : row_at[k + 1]]] = True
            pieces = [b"" if s else p for s, p in zip(skip, pieces)]
        number = self._learn(pieces)[index]
        size = self.at[number + 1] - self.at[number]
        ends = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        take = np.repeat(self.at[number] - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[take], ends[row_at]

    @staticmethod
    def boundaries(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of the byte-level pattern begin: contractions, runs of letters, digits or other signs,
        each with one space before, and white space of which the last character before a word stands apart."""
        kind = CLASSES[flat]
        rest = np.flatnonzero(kind == 0)
        kind[rest] = kind[rest - 1]  # two-byte characters only, all others are UNKNOWN
        last = np.empty_like(kind)
        last[:1], last[1:] = 0, kind[:-1]
        blank = np.empty(len(flat), bool)
        blank[:1], blank[1:] = False, flat[:-1] == 0x20
        follows = np.empty_like(kind)
        follows[-1:], follows[:-1] = WHITE, kind[1:]
        head = offsets[:-1][offsets[:-1] < len(flat)]
        last[head], blank[head] = 0, False
        tail = offsets[1:][offsets[1:] > 0] - 1
        follows[tail] = WHITE
        white = kind == WHITE
        begin = np.where(white, (last != WHITE) | (follows != WHITE), (kind != last) & ~blank)
        begin[head] = True
        ends = np.zeros(len(flat) + 1, bool)
        ends[offsets] = True
        for i in np.flatnonzero((flat == 0x27) & begin & (follows == LETTER)):
            two = bytes(flat[i + 1 : i + 3])
            size = 2 if two[:1] in (b"s", b"t", b"m", b"d") else 3 if two in (b"re", b"ve", b"ll") and not ends[i + 2] else 0
            if size:
                begin[i + 1] = ends[i + 1]
                if i + size < len(flat):
                    begin[i + size] = True
        return begin


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to take for the largest sum within the capacity.

    Bit s of a bitset says that sum s can be reached. Counts are split in powers of two. Ties: longer pieces first."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for size in sorted(counts, reverse=True):
        left, part = min(counts[size], capacity // size if size else 0), 1
        while left > 0:
            part = min(part, left)
            steps.append((size, part, reach))
            reach |= (reach << (size * part)) & mask
            left, part = left - part, part * 2
        if reach >> capacity & 1:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for size, part, before in reversed(steps):
        if not before >> at & 1:
            taken[size] += part
            at -= size * part
    return taken


class Pool:
    """Pieces waiting for a window, by length."""

    def __init__(self, capacity: int):
        self.capacity, self.by, self.n = capacity, defaultdict(list), 0

    def add(self, piece) -> None:
        self.by[piece[2]].append(piece)
        self.n += 1

    def _take(self, size: int):
        pieces = self.by[size]
        piece = pieces.pop()
        if not pieces:
            del self.by[size]
        self.n -= 1
        return piece

    def window(self) -> list:
        first = self._take(max(self.by))
        chosen = [first]
        room = self.capacity - first[2]
        if room and self.by:
            for size, n in fill({s: len(p) for s, p in self.by.items() if s <= room}, room).items():
                chosen += [self._take(size) for _ in range(n)]
        return chosen


def cut(chosen: list, slack_allowed: int, capacity: int) -> Iterator[list]:
    """A window that isn't full: as it is if little padding is needed, else windows of falling powers of two."""
    total = sum(p[2] for p in chosen)
    if capacity - total <= slack_allowed:
        yield chosen
        return
    queue = list(chosen)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            doc, start, length, of, ids = queue.pop(0)
            use = min(length, size)
            out.append((doc, start, use, of, ids[:use]))
            if use < length:
                queue.insert(0, (doc, start + use, length - use, of, ids[use:]))
            size -= use
        yield out


SCHEMA = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, pool: int = 512, low: int = 256, slack_allowed: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of documents in windows of `capacity` ids: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    ids holds the piece's ids as little-endian unsigned 32-bit integers; every document ends with `end_id`, and each of its
    ids lies in exactly one piece. A null or empty text has just the end id. A null doc_id is kept as null; repeated rows are packed once
    each; an empty table gives no rows. A window is shorter than the capacity by more than `slack_allowed` only if its size
    is a power of two. Long texts are cut at multiples of the capacity. `pool` pieces at most wait in each task.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the size of a vocabulary file
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _release()  # what earlier stages have left in this worker
        encoder = _encoder(shared)
        next_id = TaskContext.get().partitionId() << 40
        waiting, out, held = Pool(capacity), [], 0
        types = None

        def emit(window: list) -> None:
            nonlocal next_id, held
            at = 0
            for doc, start, length, of, ids in window:
                out.append((doc, start, length, of, next_id, at, ids.tobytes()))
                at += length
            held += at
            next_id += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out))
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(columns[0], types), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            types = batch.schema.field(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.rows(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                n = len(ids)
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    emit([(doc, start, capacity, n, ids[start : start + capacity])])
                if whole < n:
                    waiting.add((doc, whole, n - whole, n, ids[whole:].copy()))
                if waiting.n >= pool:
                    while waiting.n > low:
                        chosen = waiting.window()
                        for window in cut(chosen, slack_allowed, capacity):
                            emit(window)
                if held > 1 << 20:
                    yield flush()
        while waiting.n:
            for window in cut(waiting.window(), slack_allowed, capacity):
                emit(window)
        if out:
            yield flush()

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA.format(id=kind))


def _release() -> None:
    gc.collect()
    release()


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    json = shared.value
    key = hash(json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(json)
    return _ENCODERS[key]
