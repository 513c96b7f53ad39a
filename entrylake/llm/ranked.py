"""Ranked lexical search: the documents with the highest term scores for each item of a query set.

Documents are read once into postings of the items' terms. For a block of documents and an item, bitmaps of the item's terms are joined
to one mask per document: the terms it has. Documents of one mask form a group; what the terms of the mask can give at most in this block bounds the
score of the group. Groups are evaluated by falling bound until the bound is below the lowest of the best scores found, so
the result is exact. No pair of item and document becomes a row but those few.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import SLICE, _places
from .common import raw, slices, stored

#: Hits per item.
TOP = 10
#: Share (in hundredths) by which a document's length counts, and the weight of the length against the occurrences of a term.
LENGTH, SATURATION = 75, 8
#: Bytes of items that are sent to all tasks at once; more items are searched block by block.
ITEM_BYTES = 4 << 20
#: Documents that are evaluated together, at least.
_AT_ONCE = 64
_FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms(data: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and other than ASCII characters in UTF-8; only A-Z are lower-cased."""
    return data.translate(_FOLD).split()


@dataclass
class Items:
    """A block of items: their ids, the number of each term, and of each item the numbers of its terms with their repeats."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    wanted: list[tuple[np.ndarray, np.ndarray]]


def item_blocks(items: DataFrame, most: int = ITEM_BYTES) -> Iterator[Items]:
    """Blocks of ``items`` (item_id, text) with at most ``most`` bytes of text, or one item. The driver holds one block at a time."""
    block, size = Items([], {}, []), 0
    for item_id, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).toLocalIterator(prefetchPartitions=False):
        data = bytes(text or b"")
        if block.ids and size + len(data) > most:
            yield block
            block, size = Items([], {}, []), 0
        size += len(data)
        found = Counter(terms(data))
        codes = [block.vocabulary.setdefault(term, len(block.vocabulary)) for term in found]
        block.ids.append(item_id)
        block.wanted.append((np.array(codes, np.int64), np.array([*found.values()], np.int64)))
    if block.ids:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text, with repeats), and ``codes`` and ``tfs`` of those in ``vocabulary``, by rising code."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the block of items

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = shared.value.get, len(shared.value) + 1
        for batch in stream:
            for part in slices(batch, SLICE):
                n, known = [], []
                for row, data in enumerate(raw(part.column(1))):
                    found = terms(data)
                    n.append(len(found))
                    codes = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
                    known.append(codes[codes >= 0] + row * size)
                key, tf = np.unique(np.concatenate(known), return_counts=True)
                bounds = pa.array(np.searchsorted(key // size, np.arange(len(n) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array((key % size).astype(np.int32))),
                     pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "codes", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<int>")


def document_frequencies(made: DataFrame, size: int) -> np.ndarray:
    """Number of documents of each code below ``size``; counted where the postings are read, and added up."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in stream:
            df += np.bincount(_flat(batch.column(0))[0], minlength=size)
        codes = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(df[codes])], names=["code", "df"])

    out = np.zeros(size, np.int64)
    for code, df in made.select("codes").mapInArrow(run, "code long, df long").groupBy("code").agg(F.sum("df")).collect():  # a row per code
        out[code] = df
    return out


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column without nulls."""
    bounds = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[bounds[0]:bounds[-1]].astype(np.int64), bounds - bounds[0]


class Best:
    """The best documents of an item so far: falling scores above 0, equal ones by rising id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    def least(self) -> int:
        """What a further score must reach at least."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, ids: list[int | None], scores: list[int]) -> None:
        made = [(-s, i is None, i or 0) for i, s in zip(ids, scores) if s > 0]
        self.rows = sorted(self.rows + made)[:self.k]


class Documents:
    """A block of documents with their postings."""

    def __init__(self, batch: pa.RecordBatch, all_docs: int, all_terms: int, size: int) -> None:
        self.ids = batch.column(0)
        n = batch.column(1).to_numpy().astype(np.int64)
        self.codes, self.bounds = _flat(batch.column(2))
        tf = _flat(batch.column(3))[0]
        m = 100 - LENGTH + (LENGTH * n * all_docs) // all_terms
        row = np.repeat(np.arange(len(n)), np.diff(self.bounds))
        #: What a term adds to the score of a document, for a weight of one.
        self.impact = 1_000_000_000 * tf // (1000 * tf + SATURATION * m[row])
        order = np.argsort(self.codes, kind="stable")
        self.rows = row[order]
        self.starts = np.searchsorted(self.codes[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        there = np.flatnonzero(np.diff(self.starts))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.impact[order], self.starts[there])

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """A row of bytes for each document: bit j is set if it has the term ``codes[j]``."""
        bits = np.zeros((len(codes), len(self.ids)), bool)
        for j, code in enumerate(codes):
            bits[j, self.rows[self.starts[code]:self.starts[code + 1]]] = True
        made = np.zeros((-(-len(codes) // 64) * 8, len(self.ids)), np.uint8)
        made[:-(-len(codes) // 8)] = np.packbits(bits, axis=0, bitorder="little")
        return np.ascontiguousarray(made.T)

    def search(self, codes: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Add the best documents for an item: its terms and the weight of each, repeats included."""
        gains = weights * self.most[codes]
        codes, weights, gains = codes[gains > 0], weights[gains > 0], gains[gains > 0]
        if not len(codes):
            return
        words = self.masks(codes).view(np.uint64)
        if words.shape[1] == 1:
            masks, group = np.unique(words[:, 0], return_inverse=True)
            masks = masks[:, None]
        else:
            masks, group = np.unique(words, axis=0, return_inverse=True)
            group = group.ravel()
        bits = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1, bitorder="little")[:, :len(codes)]
        bound = bits.astype(np.int64) @ gains
        members = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(masks)))
        order = np.argsort(-bound, kind="stable")
        weight = np.zeros(len(self.most), np.int64)
        weight[codes] = weights
        at = 0
        while at < len(order) and bound[order[at]] >= best.least():
            docs: list[np.ndarray] = []
            while at < len(order) and bound[order[at]] >= best.least() and sum(map(len, docs)) < _AT_ONCE:
                mask = order[at]
                docs.append(members[ends[mask - 1] if mask else 0:ends[mask]])
                at += 1
            some = np.concatenate(docs)
            best.add(self.ids.take(pa.array(some)).to_pylist(), self.scores(some, weight).tolist())

    def scores(self, some: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of documents, each of which has a term of the item."""
        sizes = self.bounds[some + 1] - self.bounds[some]
        where = _places(self.bounds[some], sizes)
        return np.add.reduceat(weight[self.codes[where]] * self.impact[where], np.cumsum(sizes) - sizes)


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame | None:
    made = stored(postings(docs, items.vocabulary), "postings")
    all_docs, all_terms = made.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not all_docs:
        return None
    df = document_frequencies(made, len(items.vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((items, weight))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = shared.value
        best = [Best(k) for _ in block.ids]
        for batch in stream:
            if batch.num_rows:
                found = Documents(batch, all_docs, all_terms, len(weight))
                for (codes, times), to in zip(block.wanted, best):
                    found.search(codes, times * weight[codes], to)
        rows = [(i, item, None if null else doc, -s) for i, (item, to) in enumerate(zip(block.ids, best)) for s, null, doc in to.rows]
        names = ["place", "item_id", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], names=names)

    hits = made.mapInArrow(run, "place long, item_id long, doc_id long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(items: DataFrame, docs: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Only scores above 0 count; equal scores are ranked by rising doc_id, null ids last. Repeated rows of either table are rows of their own.
    Null and empty texts have no terms: such items find nothing, such documents are not found and do not count. Empty tables give no rows; other columns
    are ignored. Items are read in blocks of bounded size, each against all documents.
    """
    found = [hits for block in item_blocks(items, item_bytes) if (hits := _search(docs, block, k)) is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
