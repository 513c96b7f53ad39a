"""Product-quantised vectors: cells that are scanned as short codes, and exact scores for the few entries that can matter.

A unit vector is its cell's centre plus a rest. The rest is cut into parts, and each part is replaced by the nearest entry of that part's codebook: one
byte each. The inner product of a query with such a vector is a sum of table entries. The length of what the codes lose is
kept with each row; it bounds the error of every product, so entries that cannot be among the best k are left out without scoring their vectors, and the others are
scored exactly where they lie. The result is that of a scan over the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import topk as K
from .search import IvfIndex, ProbedHits, _Cells, _kept, _Router, ivf_load, ivf_save

#: Entries of a codebook; a code is one byte.
CODES = 256
#: Bytes of vectors that the codebooks are learnt from, at most (about).
TRAIN_BYTES = 64 * 2**20
_ROUNDS = 12
#: Table entries that a block of queries may have (float32), if only so many of each are scored.
_TABLES = 64 * 2**20
_CODED = "id long, cell long, code binary, lost float"
#: One in so many entries is searched before the others, if that leaves so many; rows of a task then.
_SHARES, _FIRST_ROWS, _TASK_ROWS = 16, 8192, 2048
_SIEVED = "q_id long, id long, score double, n long"


@dataclass
class PqIndex:
    """``codes`` (id, cell, code, lost) of the rows of ``cells``, and the codebooks (part, code, coordinate)."""

    cells: IvfIndex
    codes: DataFrame
    books: np.ndarray


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmax(points @ book.T - np.square(book).sum(1) / 2, axis=1)


def _learn(points: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Centres of the points by Lloyd's rounds; a centre that loses all its points stays where it is."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    book = distinct[rng.permutation(len(distinct))[:codes]]
    for _ in range(_ROUNDS):
        code = _nearest(points, book)
        n = np.bincount(code, minlength=len(book))
        total = np.stack([np.bincount(code, weights=points[:, j], minlength=len(book)) for j in range(points.shape[1])], axis=1)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return np.concatenate([book, np.repeat(book[:1], codes - len(book), axis=0)])


def _rests(batch: pa.RecordBatch, dim: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, block = K.list_matrix(batch.column("v"), dim)
    return rows, _units(block) - unit[batch.column("cell").to_numpy()[rows]]


def pq_build(index: IvfIndex, parts: int, train_bytes: int = TRAIN_BYTES, seed: int = 7) -> PqIndex:
    """Codes of ``parts`` bytes for every row of an inverted file; the dimension must be a multiple of ``parts``.

    The codebooks are learnt from a sample of about ``train_bytes`` of vectors, one task for each part; every row is then encoded where it is read.
    """
    dim = index.centres.shape[1]
    if parts < 1 or dim % parts:
        raise ValueError("the dimension must be a multiple of the parts")
    unit, wide = _units(index.centres), dim // parts
    rows = index.rows.select("id", "v", "cell")
    total, most = rows.count(), max(CODES, train_bytes // (8 * dim))
    sample = rows if total <= most else rows.sample(most / total, seed=seed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rest = _rests(batch, dim, unit)
            for part in range(parts if len(rest) else 0):
                piece = np.ascontiguousarray(rest[:, part * wide:(part + 1) * wide])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), part, np.int32)), pa.array(list(piece))], names=["part", "points"])

    def fit(table: pa.Table) -> pa.Table:
        flat = table.column("points").combine_chunks().flatten().to_numpy()
        book = _learn(flat.reshape(-1, wide), CODES, seed)
        return pa.table({"part": table.column("part")[:1], "book": pa.array([book.ravel()])})

    books = np.zeros((parts, CODES, wide))
    for r in (sample.mapInArrow(cut, "part int, points array<double>").groupBy("part")
              .applyInArrow(fit, "part int, book array<double>").collect()):  # one row for each part
        books[r["part"]] = np.array(r["book"]).reshape(CODES, wide)
    return PqIndex(index, _encoded(rows, books, unit), books)


def _encoded(rows: DataFrame, books: np.ndarray, unit: np.ndarray) -> DataFrame:
    dim, (parts, _, wide) = unit.shape[1], books.shape

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = K.rows_per_matrix(dim)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                good, rest = _rests(part, dim, unit)
                code, lost = np.empty((len(good), parts), np.uint8), np.zeros(len(good))
                for p in range(parts):
                    piece = rest[:, p * wide:(p + 1) * wide]
                    code[:, p] = _nearest(piece, books[p])
                    lost += np.square(piece - books[p][code[:, p]]).sum(1)
                # Rounded up, so that it stays a bound.
                lost = np.nextafter(np.sqrt(lost).astype(np.float32), np.float32(np.inf))
                taken = pa.array(good)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(taken), part.column("cell").take(taken),
                     pa.array([c.tobytes() for c in code], pa.binary()), pa.array(lost)], names=["id", "cell", "code", "lost"])

    return rows.mapInArrow(kernel, _CODED)


def pq_save(index: PqIndex, path: str) -> None:
    """Write an index below ``path``: vectors and codes have a folder per cell."""
    ivf_save(index.cells, path)
    index.codes.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/codes")
    books = [(p, b.ravel().tolist()) for p, b in enumerate(index.books)]
    index.codes.sparkSession.createDataFrame(books, "part int, book array<double>").coalesce(1).write.parquet(f"{path}/books")


def pq_load(spark: SparkSession, path: str) -> PqIndex:
    """Read a saved index; a search reads the code folders of the probed cells, and vectors of survivors only."""
    cells = ivf_load(spark, path)
    books = np.array([r["book"] for r in spark.read.parquet(f"{path}/books").orderBy("part").collect()])
    codes = spark.read.parquet(f"{path}/codes").withColumn("cell", F.col("cell").cast("long")).select("id", "cell", "code", "lost")
    return PqIndex(cells, codes, books.reshape(len(books), CODES, -1))


def pq_search(queries: DataFrame, index: PqIndex, k: int, nprobe: int, survivors: int | None = None, skip_self: bool = False,
              max_bytes: int = K.BROADCAST_BYTES) -> ProbedHits:
    """Top-k by cosine among the entries of the ``nprobe`` nearest cells, as ``ivf_search`` gives them, from codes.

    Entries whose highest possible score is below the k-th best found so far are left out, so the result equals that of
    the vectors. With ``survivors`` only so many of each query, by their estimated scores, are scored exactly: the result is approximate then.
    ``effort`` has, per query, rows_read (codes), survivors, and bytes_read against those of the same scan over vectors (plain_bytes). Queries are searched in
    blocks that fit ``max_bytes``, with ``survivors`` also their tables.
    """
    parts, dim = len(index.books), index.cells.centres.shape[1]
    queries = queries.select(F.col("q_id").cast("long").alias("q_id"), "v")
    per_block = max_bytes // (8 * dim) if survivors is None else min(max_bytes // (8 * dim), _TABLES // (4 * parts * CODES))
    per_block = max(1, per_block)
    blocks = max(1, -(-queries.count() // per_block))
    if blocks > 1:  # each block reads them again
        index = PqIndex(IvfIndex(_kept(index.cells.rows.select("id", "v", "cell"), "cells"), index.cells.centres), _kept(index.codes, "codes"), index.books)
    hits, effort = [], []
    for b in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b)
        packed = K.pack(some, K.list_matrix, dim, 4 * max_bytes)
        if packed is None:
            raise ValueError("too many queries of one id")
        made = _search(packed, index, k, nprobe, survivors, skip_self)
        hits.append(made.hits)
        effort.append(made.effort)
    for more, to in ((hits, 0), (effort, 0)):
        while len(more) > 1:
            more[to] = more[to].unionByName(more.pop())
    return ProbedHits(hits[0], effort[0])


def _search(packed: tuple[np.ndarray, np.ndarray], index: PqIndex, k: int, nprobe: int, survivors: int | None, skip_self: bool) -> ProbedHits:
    q_ids, vectors = packed
    parts, dim = len(index.books), index.cells.centres.shape[1]
    probes = _Cells(index.cells.centres, nprobe)(vectors) if len(q_ids) else np.zeros((0, 1), np.int64)
    spark = index.codes.sparkSession
    wanted = np.unique(probes).tolist()
    read = index.codes.where(F.col("cell").isin(wanted))
    rows = index.cells.rows.select("id", "v", "cell").where(F.col("cell").isin(wanted))
    size = {r["cell"]: r["count"] for r in read.groupBy("cell").count().collect()}  # as many as there are centres at most
    if survivors is None:
        given = (packed, index.books, _units(index.cells.centres), _Router(probes, None, joined=True))
        # A part of the entries is searched first, in few tasks: its best k are the bars of the others, so those write little.
        total = sum(size.values())
        shares = min(_SHARES, max(1, total // _FIRST_ROWS))
        share = F.pmod(F.xxhash64("id"), F.lit(shares))
        few = min(spark.sparkContext.defaultParallelism, 1 + total // shares // _TASK_ROWS)
        made = _sieved(read.where(share == 0), rows.where(share == 0), few, (*given, None), k, skip_self)
        if shares > 1:
            best = _kept(K.rank_hits(made.where("id is not null").select("q_id", "id", "score"), k), "best")
            bars = _bars(best, q_ids, k)
            most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
            many = min(most, max(2 * spark.sparkContext.defaultParallelism, total // (2 * _TASK_ROWS)))
            rest = _sieved(read.where(share > 0), rows.where(share > 0), many, (*given, bars), k, skip_self)
            made = rest.unionByName(best.select("q_id", "id", "score", F.lit(None).cast("long").alias("n"))).unionByName(made.where("id is null"))
        hits = _kept(K.rank_hits(made.where("id is not null").select("q_id", "id", "score"), k), "hits")
        per_query = made.where("id is null").groupBy("q_id").agg(F.sum("n").alias("survivors"))
    else:
        left = _estimated(packed, index, read, _Router(probes, None), survivors, skip_self)
        hits = _kept(K.rank_hits(_rescored(packed, rows.join(left, ["id", "cell"])), k), "hits")
        per_query = left.groupBy("q_id").agg(F.count(F.lit(1)).alias("survivors"))
    counted = spark.createDataFrame([(int(i), int(sum(size.get(c, 0) for c in row))) for i, row in zip(q_ids, probes.tolist())],
                                    "q_id long, rows_read long")
    effort = counted.join(per_query, "q_id", "left").withColumn("survivors", F.coalesce("survivors", F.lit(0))).withColumns({
        "bytes_read": F.col("rows_read") * (parts + 4) + F.col("survivors") * 4 * dim, "plain_bytes": F.col("rows_read") * 4 * dim})
    return ProbedHits(hits, effort)


def _decoded(part: pa.RecordBatch, books: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, near those of unit length."""
    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, len(books))
    return unit[part.column("cell").to_numpy()] + np.concatenate([book[code[:, p]] for p, book in enumerate(books)], axis=1)


def _bars(best: DataFrame, q_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query."""
    kth = best.where(F.col("rnk") == k).select("q_id", "score").toArrow()  # one for each query
    named, low = kth.column("q_id").to_numpy(), kth.column("score").to_numpy()
    if not len(named):
        return np.full(len(q_ids), -np.inf)
    order = np.argsort(named)
    at = order[np.minimum(np.searchsorted(named[order], q_ids), len(named) - 1)]
    return np.where(named[at] == q_ids, low[at], -np.inf)


def _sieved(codes: DataFrame, rows: DataFrame, tasks: int, given: tuple, k: int, skip_self: bool) -> DataFrame:
    """Hits of the queries among some entries, and how many entries of each the codes did not rule out, stored.

    Codes and vectors lie side by side: nothing but the best k of a task leaves it, however little the codes rule out.
    """
    both = rows.join(codes, ["id", "cell"]).repartition(tasks, "id").sortWithinPartitions("cell")
    shared = rows.sparkSession.sparkContext.broadcast(given)
    return _kept(both.select("id", "v", "cell", "code", "lost").mapInArrow(_sieve(shared, k, skip_self), _SIEVED), "sieved")


def _sieve(shared, k: int, skip_self: bool):
    """Scores the entries that the codes do not rule out; the bars are those of exact scores, so they rise as a task goes on."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q_ids, given), books, unit, route, bars = shared.value
        best = K.Best(q_ids, given, k, "cosine", skip_self, False, bars)
        # Codes decode to vectors somewhat longer than one.
        best.repeats, best.error = True, 3 * best.error
        step = K.rows_per_matrix(unit.shape[1])
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                rows, block = K.list_matrix(part.column("v"), unit.shape[1])
                if not len(rows):
                    continue
                near = _decoded(part, books, unit)[rows]
                lost, ids = part.column("lost").to_numpy()[rows], part.column("id").to_numpy()[rows]
                for entries, asked in route(part, rows, block):
                    best.add(ids[entries], block[entries], asked, (near[entries], lost[entries]))
        for made in best.batches():
            yield pa.RecordBatch.from_arrays([*made.columns, pa.nulls(made.num_rows, pa.int64())], names=["q_id", "id", "score", "n"])
        some = np.flatnonzero(best.scored)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[some]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.float64()),
                                          pa.array(best.scored[some])], names=["q_id", "id", "score", "n"])

    return kernel


def _estimated(packed: tuple[np.ndarray, np.ndarray], index: PqIndex, read: DataFrame, router: _Router, survivors: int, skip_self: bool) -> DataFrame:
    """Of each query the ``survivors`` entries with the highest estimates: (q_id, id, cell)."""
    q_ids, vectors = packed
    parts, _, wide = index.books.shape
    unit_q, unit_c = _units(vectors), _units(index.cells.centres)
    tables = np.stack([unit_q[:, p * wide:(p + 1) * wide] @ index.books[p].T for p in range(parts)], axis=1).astype(np.float32)
    shared = index.codes.sparkSession.sparkContext.broadcast((q_ids, tables, unit_q @ unit_c.T, router))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, table, near, route = shared.value
        bar = np.full(len(ids_of), -np.inf)
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids, cell = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for entries, asked in route(batch, np.arange(len(ids)), None):
                step = max(1, 4_000_000 // max(1, len(asked)))
                for a in range(0, len(entries), step):
                    some = entries[a:a + step]
                    score = np.repeat(near[asked, cell[some[0]]][:, None], len(some), axis=1)
                    for p in range(parts):
                        score += table[asked, p][:, code[some, p]]
                    if skip_self:
                        score[ids_of[asked][:, None] == ids[some][None, :]] = -np.inf
                    if len(some) >= survivors:
                        bar[asked] = np.maximum(bar[asked], np.partition(score, -survivors, axis=1)[:, -survivors])
                    q, r = np.nonzero((score >= bar[asked][:, None]) & (score > -np.inf))
                    held.append((asked[q], ids[some[r]], score[q, r], cell[some[r]]))
                    if sum(len(h[0]) for h in held) > 1_000_000:
                        held = [_highest(held, survivors)]
        if held:
            q, found, low, cells = _highest(held, survivors)
            for a in range(0, len(q), 100_000):
                some = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids_of[q[some]]), pa.array(found[some]), pa.array(low[some]), pa.array(cells[some])],
                                                 names=["q_id", "id", "low", "cell"])

    able = _kept(read.mapInArrow(scan, "q_id long, id long, low double, cell long"), "able")
    by_low = Window.partitionBy("q_id").orderBy(F.desc("low"), "id")
    left = able.withColumn("n", F.row_number().over(by_low)).where(F.col("n") <= survivors)
    return _kept(left.select("q_id", "id", "cell"), "survivors")


def _highest(held: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    """The n highest of each query, ties by smaller id."""
    q, ids, score, cells = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((ids, -score, q))
    q = q[order]
    order = order[np.arange(len(q)) - np.searchsorted(q, q) < n]
    return tuple(np.concatenate(c)[order] for c in zip(*held))


def _rescored(packed: tuple[np.ndarray, np.ndarray], pairs: DataFrame) -> DataFrame:
    """Exact scores of pairs (q_id, id, v)."""
    vectors_of = pairs.sparkSession.sparkContext.broadcast(packed)

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, given = vectors_of.value
        order = np.argsort(ids_of, kind="stable")
        for batch in batches:
            rows, block = K.list_matrix(batch.column("v"), given.shape[1])
            asked = batch.column("q_id").to_numpy()[rows]
            q = given[order[np.searchsorted(ids_of[order], asked)]]
            score = np.einsum("ij,ij->i", q, block) / (np.linalg.norm(q, axis=1) * np.linalg.norm(block, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(batch.column("id").to_numpy()[rows]), pa.array(K._round(score))],
                                             names=["q_id", "id", "score"])

    return pairs.select("q_id", "id", "v").mapInArrow(rescore, K.RESULT)
