"""Packing into sequences of near-equal length by multiway differencing (Karmarkar and Karp).

A partial partition is a list of windows. At first every piece is a partition with one window, the others being empty. The two partitions
with the largest imbalance (largest window less smallest) are merged, over and over: the largest windows of one meet the smallest of the
other, so that their imbalances cancel. The last one is the packing.

There are as many windows as the tokens need at least. What a window holds beyond the capacity is cut off its largest piece, and the
differencing goes on with these overhangs and the partition as it stands. If some are still too full after a few turns, the number of windows
rises by one, an empty window, at each further turn.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import SLICE, Encoder, Vocabulary
from .common import slices

CAPACITY = 2048
#: The token that ends a document.
END = 1
#: Tokens of documents that are packed together.
GROUP = 4 << 20
#: Turns of cutting overhangs before the number of windows rises.
TURNS = 3
#: Up to so many windows are put in their places one by one.
_FEW = 16
#: Tokens given out at once.
_OUT = 1 << 20

Piece = tuple[int, int, int]  # (item, first token, end)
Window = tuple[int, int, "Piece | list"]  # (tokens, serial number, a piece or a pair of such trees)


def difference(parts: list[list[Window]], k: int, serial: Iterator[int]) -> list[Window]:
    """One partition into at most ``k`` windows from partial ones, by rising size. Windows that are not listed are empty."""
    def imbalance(part: list[Window]) -> int:
        return part[-1][0] - (part[0][0] if len(part) == k else 0)

    heap = [(-imbalance(p), next(serial), p) for p in parts]
    heapify(heap)
    while len(heap) > 1:
        a, b = heappop(heap)[2], heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        meet = max(0, len(a) + len(b) - k)  # the others of ``b`` meet empty windows
        large = b[::-1]
        made = [(x[0] + y[0], next(serial), [x[2], y[2]]) for x, y in zip(a[:meet], large)] + large[meet:]
        if len(b) <= _FEW:
            del a[:meet]
            for window in made:
                insort(a, window)
        else:
            a = sorted(a[meet:] + made)
        heappush(heap, (-imbalance(a), next(serial), a))
    return heap[0][2]


def pieces(tree: Piece | list) -> list[Piece]:
    """The pieces of a window, shortest first."""
    found, left = [], [tree]
    while left:
        node = left.pop()
        if isinstance(node, list):
            left += node
        else:
            found.append(node)
    return sorted(found, key=lambda p: (p[2] - p[1], p))


def cut(found: list[Piece], capacity: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``capacity`` tokens of a window, and its overhang."""
    kept, over = [], []
    for item, start, end in found:
        here = min(end - start, capacity)
        capacity -= here
        if here:
            kept.append((item, start, start + here))
        if start + here < end:
            over.append((item, start + here, end))
    return kept, over


def balanced(sizes: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Windows of near-equal size and at most ``capacity`` tokens from items of the given sizes (1 at least), each a list of pieces.

    Every token of every item lies in one piece. No sizes give no windows. Equal sizes are taken in their order. Of an item that is larger than a
    window, full windows are cut first.
    """
    full = [[(i, start, start + capacity)] for i, size in enumerate(sizes) for start in range(0, size - capacity + 1, capacity)]
    rests = [(i, size - size % capacity, size) for i, size in enumerate(sizes) if size % capacity]
    if not rests:
        return full
    serial = count()
    k = -(-sum(end - start for _, start, end in rests) // capacity)
    parts = [[(piece[2] - piece[1], next(serial), piece)] for piece in rests]
    for turn in count(1):
        windows = difference(parts, k, serial)
        if windows[-1][0] <= capacity:
            return full + [pieces(tree) for _, _, tree in windows]
        fitting, overhangs = [], []
        for size, number, tree in windows:
            if size > capacity:
                kept, over = cut(pieces(tree), capacity)
                size, tree = capacity, list(kept)
                overhangs += over
            fitting.append((size, number, tree))
        k += turn > TURNS
        parts = [sorted(fitting), *[[(end - start, next(serial), (i, start, end))] for i, start, end in overhangs]]
    raise AssertionError  # not reached


class _Rows:
    """Pieces that are to be given out."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.rows, self.tokens = names, [], 0

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int, sequence: int, offset: int) -> None:
        self.rows.append((doc_id, start, len(ids), ids.tobytes(), doc_tokens, sequence, offset))
        self.tokens += len(ids)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.binary() if n == "ids" else pa.int64() for n in self.names]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), kinds)], names=self.names)
        self.rows, self.tokens = [], 0
        return made


def pack(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """The pieces of all sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset; ``docs`` has doc_id and text.

    A document is the ids of its whole text and ``end``; ``ids`` are those of the piece as unsigned little-endian 32-bit numbers. Full sequences are cut
    from long documents first; the rests are packed in groups of about ``group`` tokens of neighbouring documents, as they are read: nothing
    is shuffled, and a task holds one group. Sequences are padded to ``capacity`` later on.

    Null and empty texts are their ``end`` alone. Repeated rows are packed each, ids may be null; ties are taken in the order of the rows. An empty
    table gives none; other columns are ignored. A run that is repeated after a loss gives the same rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))  # bounded by the vocabulary
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.kept(shared.value)
        sequence = count(TaskContext.get().partitionId() << 40)
        out = _Rows(names)
        rests: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for window in balanced([len(ids) for _, _, ids in rests], capacity):
                number, offset = next(sequence), 0
                for item, first, stop in window:
                    doc_id, n, ids = rests[item]
                    out.add(doc_id, n - len(ids) + first, ids[first:stop], n, number, offset)
                    offset += stop - first
                if out.tokens >= _OUT:
                    yield out.batch()
            rests.clear()

        for batch in stream:
            for part in slices(batch, SLICE):
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.batch(part.column(1))):
                    ids = np.append(ids, np.int32(end)).astype("<u4")
                    n, full = len(ids), len(ids) - len(ids) % capacity
                    for start in range(0, full, capacity):
                        out.add(doc_id, start, ids[start:start + capacity], n, next(sequence), 0)
                        if out.tokens >= _OUT:
                            yield out.batch()
                    if full < n:
                        rests.append((doc_id, n, ids[full:].copy()))
                        held += n - full
                    if held >= group:
                        yield from flush()
                        held = 0
        yield from flush()
        if out.rows:
            yield out.batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The pieces that ``pack`` gives, with the CRC-32 of their ids in place of these."""
    return pack(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
