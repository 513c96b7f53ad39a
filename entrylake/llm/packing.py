"""Best-fit packing into bins of several permitted lengths.

Documents are dealt evenly into groups of bounded size, and each group is packed on its own, longest pieces first: a piece goes to the open bin that it
fills best. If it fits none, a bin is opened whose length costs least for each token that can still come to fill it; all
permitted lengths compete for each bin. The group is packed once more with the shortest length that holds each piece, the cheaper of both
packings counts, and in the end every bin is cut down to the shortest permitted length that holds its contents. Documents longer than the
longest bin are split; no token is dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import Vocabulary, token_counts
from .common import stored

#: Permitted sequence lengths in tokens, and the cost of a sequence beyond its length (also in tokens).
CAPACITIES = (1024, 2048, 4096, 8192)
OVERHEAD = 32
GROUP = 100_000


def cost(capacity: int) -> int:
    return capacity + OVERHEAD


def fill(lengths: list[int], capacities: tuple[int, ...], least_cost: bool) -> tuple[list[int], list[int]]:
    """Bin of every piece, and what every bin holds. ``lengths`` fall, none exceeds the largest of ``capacities`` (rising)."""
    left = sum(lengths)
    free: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    bins, held = [], []
    for length in lengths:
        at = bisect_left(free, (length, -1))
        if at < len(free):
            space, to = free.pop(at)
        else:
            fitting = [c for c in capacities if c >= length]
            space = min(fitting, key=lambda c: (cost(c) / min(c, left), c)) if least_cost else fitting[0]
            to = len(held)
            held.append(0)
        bins.append(to)
        held[to] += length
        left -= length
        if space > length:
            insort(free, (space - length, to))
    return bins, held


def downsized(held: list[int], capacities: tuple[int, ...]) -> list[int]:
    return [capacities[bisect_left(capacities, h)] for h in held]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int]]:
    """Bin of every piece, and the final length of every bin; the cheaper of the two ways to open bins."""
    best = None
    for least_cost in (True, False):
        bins, held = fill(lengths, capacities, least_cost)
        sizes = downsized(held, capacities)
        total = sum(map(cost, sizes))
        if best is None or total < best[0]:
            best = total, bins, sizes
    return best[1], best[2]


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group: int = GROUP) -> DataFrame:
    """Where every token goes: doc_id, piece, start, length, bin_id, bin_length, bin_offset; ``docs`` has doc_id and n_tokens.

    A piece is ``length`` tokens of its document from ``start`` on, put at ``bin_offset`` of the bin. Documents without tokens (0, negative or null) get a row
    with null bin. Repeated rows are packed each. An empty table gives none; other columns are ignored. Ties are broken by doc_id.
    """
    capacities = tuple(sorted(set(capacities)))
    most = capacities[-1]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bin_id", pa.int64()),
                        ("bin_length", pa.int32()), ("bin_offset", pa.int32())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        n_bins, rest, rows = 0, [], []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows.clear()
            return made

        for batch in stream:
            for doc_id, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not n or n < 0:
                    rows.append((doc_id, 0, 0, 0, None, None, None))
                    continue
                for piece in range(n // most):  # these fill a bin each
                    rows.append((doc_id, piece, piece * most, most, base + n_bins, most, 0))
                    n_bins += 1
                    if len(rows) >= 20_000:
                        yield flush()
                if n % most:
                    rest.append((-(n % most), doc_id is None, doc_id or 0, doc_id, n // most))
        rest.sort(key=lambda r: r[:3])
        lengths = [-r[0] for r in rest]
        bins, sizes = pack(lengths, capacities)
        used = [0] * len(sizes)
        for length, (*_, doc_id, piece), to in zip(lengths, rest, bins):
            rows.append((doc_id, piece, piece * most, length, base + n_bins + to, sizes[to], used[to]))
            used[to] += length
            if len(rows) >= 20_000:
                yield flush()
        if rows:
            yield flush()

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long"))
    # Dealt in turn, so groups are equally large and no key can crowd one.
    return narrow.repartition(max(1, -(-narrow.count() // group))).mapInArrow(
        run, "doc_id long, piece long, start long, length long, bin_id long, bin_length int, bin_offset int")


def pack_texts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``pack_documents`` of ``docs`` (doc_id, text) by the tokens of their whole texts; null and empty texts have none."""
    # Packing reads the counts twice, the texts are encoded once.
    return pack_documents(stored(token_counts(docs, vocabulary), "token-counts"))
