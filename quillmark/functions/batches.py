"""Arrow batches in small pieces: what a task holds as Python objects is bounded, however large its batches are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa

#: Bytes of a piece. A batch of Spark has up to 10,000 rows and 64 MB; as Python objects, with what is made of them, rows take ten times their bytes and more.
PIECE = 1 << 20


def pieces(columns: Sequence[pa.Array], most: int = PIECE) -> Iterator[list[pa.Array]]:
    """The columns cut into runs of rows of at most `most` bytes together, or of one row; their rows in order, an empty batch once."""
    n = len(columns[0])
    if n <= 1 or sum(c.nbytes for c in columns) <= most:
        yield list(columns)
        return
    for at, size in ((0, n // 2), (n // 2, n - n // 2)):
        yield from pieces([c.slice(at, size) for c in columns], most)
