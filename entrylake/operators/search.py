"""Embeddings, exact and approximate search over knowledge entries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .. import schemas as S
from ..functions.text import token_code, tokens
from ..functions.vectors import norm, vector_problem
from ..session import work_dir
from . import topk as K

# --- embeddings ------------------------------------------------------------------


def embed(entries: DataFrame, fn: Callable[[list[str]], np.ndarray], dim: int = S.EMBEDDING_DIM,
          id_col: str = "id", text: str = "body", model: str = "custom", batch: int = 256) -> DataFrame:
    """Embeddings from any model: ``fn`` turns a list of texts into an (n, dim) array.

    Texts go to ``fn`` whole, in batches; nothing is shuffled.
    """
    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a:a + batch]
                vectors = np.asarray(fn(part["_text"].tolist()), dtype=np.float32)
                if vectors.shape != (len(part), dim):
                    raise ValueError(f"model returned {vectors.shape}, not {(len(part), dim)}")
                yield pd.DataFrame({"entry_id": part["entry_id"].to_numpy(), "model": model,
                                    "dim": dim, "embedding": list(vectors)})

    texts = entries.select(F.col(id_col).cast("long").alias("entry_id"),
                           F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return texts.mapInPandas(kernel, S.ENTRY_EMBEDDINGS)


def embed_model(entries: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int = S.EMBEDDING_DIM,
                id_col: str = "id", text: str = "body", model: str = "custom", batch: int = 256) -> DataFrame:
    """``embed`` for a model that is costly to load: ``load()`` returns the function, and runs once in each Python worker.

    The model is kept by the worker for the tasks that follow and does not travel with them; what ``load`` refers to must be reachable
    from the executors. Null texts count as empty.
    """
    def make():
        fn = load()

        def predict(part: np.ndarray) -> np.ndarray:
            vectors = np.asarray(fn(part.tolist()), dtype=np.float32)
            if vectors.shape != (len(part), dim):
                raise ValueError(f"model returned {vectors.shape}, not {(len(part), dim)}")
            return vectors
        return predict

    vector = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch)
    return entries.select(F.col(id_col).cast("long").alias("entry_id"), F.lit(model).alias("model"), F.lit(dim).alias("dim"),
                          vector(F.coalesce(F.col(text), F.lit(""))).alias("embedding"))


def hash_embed(entries: DataFrame, dim: int = S.EMBEDDING_DIM, id_col: str = "id",
               text: str = "body") -> DataFrame:
    """Signed feature hashing of the tokens, sparse: (id, bucket, weight), no zero weights.

    Lexical, not semantic. A text is hashed where it is read and needs no shuffle; ids are
    unique.
    """
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = K.rows_per_matrix(dim)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                rows, matrix = K.code_matrix(part.column("v"), dim)
                row, bucket = np.nonzero(matrix)
                weight = matrix[row, bucket].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows[row])), pa.array(bucket.astype(np.int32)),
                     pa.array(weight)], names=["id", "bucket", "weight"])

    split = entries.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("id"), tokens(F.col(text)).alias("v"))
    id_type = split.schema["id"].dataType.simpleString()
    return split.mapInArrow(kernel, f"id {id_type}, bucket int, weight long")


def token_codes(text: Column, dim: int) -> Column:
    """The tokens of a text as small integers, smaller to store than the tokens."""
    return F.transform(tokens(text), lambda w: token_code(w, dim))


def check_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Adds ``problem``: null for a searchable vector, else null, width, element or zero."""
    return df.withColumn("problem", vector_problem(F.col(vector), dim))


def normalize(df: DataFrame, vector: str) -> DataFrame:
    """Scale vectors to unit length."""
    length = norm(F.col(vector))
    return df.withColumn("_n", length).withColumn(
        vector, F.transform(vector, lambda x: x.cast("double") / F.col("_n"))).drop("_n")


# --- exact search ----------------------------------------------------------------


def knn(queries: DataFrame, corpus: DataFrame, k: int, dim: int, metric: str = "cosine",
        min_sim: float | None = None, where: DataFrame | Column | None = None, skip_self: bool = False,
        **limits) -> DataFrame:
    """Exact top-k of all queries (q_id, v) in corpus (id, v): (q_id, rnk, id, score).

    ``where`` filters before ranking: a condition on columns the corpus carries, which is
    pushed into the scan, or a DataFrame with the ids to search, which is joined. ``min_sim``
    drops lower scores before ranking; for ``l2`` it is the largest distance. ``skip_self``
    leaves out the entry whose id is the query's. Unusable vectors never enter.
    """
    if isinstance(where, Column):
        corpus = corpus.where(where)
    elif where is not None:
        corpus = corpus.join(where.select("id"), "id", "left_semi")
    floor = -min_sim if metric == "l2" and min_sim is not None else min_sim
    return K.top_k(queries, corpus, K.list_matrix, dim, k, metric, skip_self=skip_self,
                   overlap=False, floor=floor, **limits)


def encode_entries(entries: DataFrame, dim: int = S.EMBEDDING_DIM) -> DataFrame:
    """Entries (id, body) as (id, v) for ``search``, v being token codes; write it once, search it often."""
    return entries.where("body is not null").select("id", token_codes(F.col("body"), dim).alias("v"))


def search(queries: DataFrame, entries: DataFrame, k: int, dim: int = S.EMBEDDING_DIM, **limits) -> DataFrame:
    """Text search: cosine of hashed tokens of queries (q_id, text) and entries (id, body).

    Entries that share no bucket with a query are no hits of it. One pass over the entries:
    each text becomes a row of a matrix where it is read, so common words cause no skew.
    ``entries`` may also be the result of ``encode_entries`` with the same ``dim``.
    """
    q = queries.where("text is not null").select("q_id", tokens(F.col("text")).alias("v"))
    c = entries
    if "v" not in entries.columns:
        c = entries.where("body is not null").select("id", tokens(F.col("body")).alias("v"))
    return K.top_k(q, c, K.code_matrix, dim, k, "cosine", skip_self=False, overlap=True, floor=None,
                   **limits)


def search_log(conversations: DataFrame, entries: DataFrame, k: int, dim: int = S.EMBEDDING_DIM,
               **limits) -> DataFrame:
    """Replay the user turns of logged conversations: (conv_id, turn, rnk, id, score).

    A turn is searched under a number made of both keys, which needs turn < 2**20.
    """
    asked = conversations.where("role = 'user'").select(
        (F.shiftleft(F.col("conv_id"), 20) + F.col("turn")).alias("q_id"), "text")
    hits = search(asked, entries, k, dim, **limits)
    return hits.select(F.shiftright("q_id", 20).alias("conv_id"),
                       F.col("q_id").bitwiseAND(2**20 - 1).alias("turn"), "rnk", "id", "score")


# --- approximate search ----------------------------------------------------------


@dataclass
class IvfIndex:
    """``rows`` (id, v, cell) and the cell centres, whose size is fixed by their number."""

    rows: DataFrame
    centres: np.ndarray


class _Cells:
    """Assigns vectors to the cells whose centres have the highest cosine."""

    def __init__(self, centres: np.ndarray, nprobe: int):
        self.unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
        self.nprobe = min(nprobe, len(centres))

    def __call__(self, block: np.ndarray) -> np.ndarray:
        near = block @ self.unit.T / np.linalg.norm(block, axis=1)[:, None]
        return np.argsort(-np.round(near, 9), axis=1, kind="stable")[:, :self.nprobe]


class _Projections:
    """p-stable hashing of unit vectors: one bucket number per random direction.

    A bucket is numbered within its table, so equal numbers mean equal table and bucket.
    """

    def __init__(self, dim: int, tables: int, bucket_length: float, seed: int):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(dim, tables))
        self.directions /= np.linalg.norm(self.directions, axis=0)
        self.shift = rng.uniform(0, bucket_length, size=tables)
        self.length, self.tables = bucket_length, tables

    def __call__(self, block: np.ndarray) -> np.ndarray:
        unit = block / np.linalg.norm(block, axis=1)[:, None]
        bucket = np.floor((unit @ self.directions + self.shift) / self.length).astype(np.int64)
        return bucket * self.tables + np.arange(self.tables)


def _in_cells(df: DataFrame, key: str, dim: int, assign: Callable[[np.ndarray], np.ndarray],
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, v, cell, *keep), one for each cell of each searchable vector."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, block = K.list_matrix(batch.column("v"), dim)
            cells = assign(block)
            taken = pa.array(np.repeat(rows, cells.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(taken), batch.column("v").take(taken),
                 pa.array(cells.ravel().astype(np.int64)), *[batch.column(c).take(taken) for c in keep]],
                names=[key, "v", "cell", *keep])

    shape = f"{key} long, v {df.schema['v'].dataType.simpleString()}, cell long"
    shape += "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(key).cast("long").alias(key), "v", *keep).mapInArrow(kernel, shape)


class _Router:
    """Sends the entries of a batch to the queries that probe one of their cells; ``joined`` sends those of cells that all queries probe at once."""

    def __init__(self, probes: np.ndarray, assign: Callable[[np.ndarray], np.ndarray] | None, joined: bool = False):
        self.assign = assign
        order = np.argsort(probes.ravel(), kind="stable")
        cells, begins = np.unique(probes.ravel()[order], return_index=True)
        asked = np.split(order // probes.shape[1], begins[1:])
        self.asked = dict(zip(cells.tolist(), asked))
        self.whole = np.array([c for c, a in self.asked.items() if joined and len(a) == len(probes)], dtype=np.int64)

    def __call__(self, batch: pa.RecordBatch, rows: np.ndarray, block: np.ndarray):
        cells = (batch.column("cell").to_numpy()[rows][:, None] if self.assign is None
                 else self.assign(block))
        if len(self.whole):
            cells = np.where(np.isin(cells, self.whole), self.whole[0], cells)
        order = np.argsort(cells.ravel(), kind="stable")
        names, begins = np.unique(cells.ravel()[order], return_index=True)
        for name, entries in zip(names.tolist(), np.split(order // cells.shape[1], begins[1:])):
            if name in self.asked:
                yield entries, self.asked[name]


def _unit_vectors(dim: int):
    """The searchable vectors, scaled to unit length."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, block = K.list_matrix(batch.column("v"), dim)
            total = np.zeros(len(block))
            for j in range(dim):  # in this order, as Spark's aggregate adds
                total += block[:, j] * block[:, j]
            block = block / np.sqrt(total)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * dim), pa.array(block.ravel()))
            yield pa.RecordBatch.from_arrays([lists], names=["v"])

    return kernel


def ivf_build(corpus: DataFrame, dim: int, cells: int, train_rows: int = 1_000_000, seed: int = 7,
              keep: tuple[str, ...] = ()) -> IvfIndex:
    """Inverted-file index: k-means cells of the unit vectors.

    The centres are learnt from at most about ``train_rows`` vectors; every vector is then
    assigned to a cell. ``ivf_save`` keeps it for many searches. The columns ``keep`` of the
    corpus stay with its rows, for filters.
    """
    unit = corpus.select("v").mapInArrow(_unit_vectors(dim), "v array<double>")
    total = unit.count()
    part = unit if total <= train_rows else unit.sample(train_rows / total, seed=seed)
    model = (KMeans(k=cells, seed=seed, featuresCol="_f", maxIter=15, initSteps=3)
             .fit(part.select(array_to_vector("v").alias("_f"))))
    centres = np.array(model.clusterCenters())
    return IvfIndex(_in_cells(corpus, "id", dim, _Cells(centres, 1), keep), centres)


def ivf_save(index: IvfIndex, path: str) -> None:
    """Write an index below ``path``, one folder per cell; large cells become several files."""
    spark = index.rows.sparkSession
    index.rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    centres = [(i, c.tolist()) for i, c in enumerate(index.centres)]
    spark.createDataFrame(centres, "cell long, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")


def ivf_load(spark: SparkSession, path: str) -> IvfIndex:
    """Read a saved index; a search then reads the folders of the probed cells only."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    rows = spark.read.parquet(f"{path}/rows").withColumn("cell", F.col("cell").cast("long"))
    return IvfIndex(rows, np.array([c["centre"] for c in centres]))


def ivf_search(queries: DataFrame, index: IvfIndex, k: int, nprobe: int, metric: str = "cosine",
               skip_self: bool = False, max_bytes: int = K.BROADCAST_BYTES,
               block_rows: int = K.BLOCK_ROWS) -> DataFrame:
    """Top-k among the entries of the ``nprobe`` nearest cells; all cells give the exact result.

    Few queries (checked) are broadcast and the probed cells are read in place; many queries
    meet the cells in the block grid.
    """
    dim = index.centres.shape[1]
    assign = _Cells(index.centres, nprobe)
    options = {"skip_self": skip_self, "overlap": False, "floor": None}
    packed = K.pack(queries, K.list_matrix, dim, max_bytes)
    if packed is not None:
        probes = assign(packed[1])
        # At most as many cells as there are centres.
        rows = index.rows.where(F.col("cell").isin(np.unique(probes).tolist()))
        hits = K.scan(packed, rows, K.list_matrix, dim, k, metric, _Router(probes, None, joined=True), **options)
    else:
        asked = _in_cells(queries, "q_id", dim, assign)
        hits = K.grid(asked, index.rows, K.list_matrix, dim, k, metric, block_rows, **options)
    return K.rank_hits(hits, k, metric)


@dataclass
class ProbedHits:
    """``hits`` (q_id, rnk, id, score) and, per query, what was read for them: ``effort`` (q_id, cells_read, rows_read)."""

    hits: DataFrame
    effort: DataFrame


class _Asked:
    """Sends the entries of a batch to the queries that ask for their cell; each asks for cells of its own."""

    def __init__(self, probes: list[tuple[int, np.ndarray]]):
        cells = np.concatenate([c for _, c in probes])
        who = np.repeat([q for q, _ in probes], [len(c) for _, c in probes])
        order = np.argsort(cells, kind="stable")
        names, begins = np.unique(cells[order], return_index=True)
        self.asked = dict(zip(names.tolist(), np.split(who[order], begins[1:])))

    def __call__(self, batch: pa.RecordBatch, rows: np.ndarray, block: np.ndarray):
        cells = batch.column("cell").to_numpy()[rows]
        order = np.argsort(cells, kind="stable")
        names, begins = np.unique(cells[order], return_index=True)
        for name, entries in zip(names.tolist(), np.split(order, begins[1:])):
            if name in self.asked:
                yield entries, self.asked[name]


def cell_reach(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell, the number of ``rows`` (v, cell) in it and the widest angle between one and the centre.

    Each task gives one row per cell, so the driver gets as many as there are centres.
    """
    dim = centres.shape[1]
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = np.zeros(len(unit), np.int64), np.ones(len(unit))
        step = K.rows_per_matrix(dim)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                good, block = K.list_matrix(part.column("v"), dim)
                cell = part.column("cell").to_numpy()[good]
                near = np.einsum("ij,ij->i", block, unit[cell]) / np.linalg.norm(block, axis=1)
                np.add.at(held, cell, 1)
                np.minimum.at(least, cell, near)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some]), pa.array(least[some])], names=["cell", "n", "near"])

    n, least = np.zeros(len(unit), np.int64), np.ones(len(unit))
    found = (rows.select("v", "cell").mapInArrow(kernel, "cell long, n long, near double")
             .groupBy("cell").agg(F.sum("n").alias("n"), F.min("near").alias("near")))
    for r in found.collect():
        n[r["cell"]], least[r["cell"]] = r["n"], r["near"]
    return n, np.arccos(np.clip(least, -1.0, 1.0))


def _bounds(queries: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The highest cosine that a query can have with an entry of a cell: the angle to the centre less the cell's reach."""
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    near = queries @ unit.T / np.linalg.norm(queries, axis=1)[:, None]
    return np.cos(np.maximum(np.arccos(np.clip(near, -1.0, 1.0)) - reach[None, :], 0.0))


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared working folder and read back: a round does not compute the ones before it again."""
    return K.stored(df, purpose)


def ivf_filtered(queries: DataFrame, index: IvfIndex, k: int, where: DataFrame | Column | None = None,
                 min_sim: float | None = None, max_cells: int | None = None, skip_self: bool = False,
                 max_bytes: int = K.BROADCAST_BYTES, first_cells: int = 1) -> ProbedHits:
    """Top-k by cosine among the indexed entries that pass a filter, reading as few cells as the answer needs.

    ``where`` is a condition on columns that the index keeps, or a DataFrame with the ids to search; ``min_sim`` drops
    lower scores. Cells are probed in rounds, each query its own in the order of their bounds: the best cosine that
    an entry which passes the filter can have there. A query stops when it holds k hits and the next bound is below the worst
    of them (or below ``min_sim``): the result is then exact. ``max_cells`` stops it earlier, and the result is approximate. A
    selective filter empties most cells and narrows the others, and the search goes on until k hits are found.

    Queries are searched in blocks that fit ``max_bytes``; the driver holds their vectors and a bound per query and cell. Unusable
    vectors never enter.
    """
    if first_cells < 1 or (max_cells is not None and max_cells < 1):
        raise ValueError("at least one cell has to be read")
    dim, n_cells = index.centres.shape[1], len(index.centres)
    rows = index.rows
    if isinstance(where, Column):
        rows = rows.where(where)
    elif where is not None:
        rows = rows.join(where.select("id").distinct(), "id", "left_semi")
    rows = rows.select("id", "v", "cell")
    size, reach = cell_reach(rows, index.centres)
    limit = min(n_cells if max_cells is None else max_cells, int((size > 0).sum()))
    queries = queries.select(F.col("q_id").cast("long").alias("q_id"), "v")
    per_block = max(1, min(max_bytes // (8 * dim), max_bytes // (8 * n_cells)))
    blocks = max(1, -(-queries.count() // per_block))
    found = []
    for b in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b)
        packed = K.pack(some, K.list_matrix, dim, 4 * max_bytes)  # blocks dealt by hash are not quite equal
        if packed is None:
            raise ValueError("too many queries of one id")
        found.append(_probe(packed, rows, index.centres, size, reach, k, limit, min_sim, skip_self, first_cells))
    return ProbedHits(reduce(DataFrame.unionByName, [h for h, _ in found]), reduce(DataFrame.unionByName, [e for _, e in found]))


def _probe(packed: tuple[np.ndarray, np.ndarray], rows: DataFrame, centres: np.ndarray, size: np.ndarray, reach: np.ndarray, k: int,
           limit: int, min_sim: float | None, skip_self: bool, first_cells: int) -> tuple[DataFrame, DataFrame]:
    """Hits of a block of queries, and what each has read."""
    spark, (q_ids, vectors), dim = rows.sparkSession, packed, centres.shape[1]
    options = {"skip_self": skip_self, "overlap": False, "floor": min_sim}
    bound = np.where(size > 0, _bounds(vectors, centres, reach), -np.inf) if len(q_ids) else np.empty((0, len(centres)))
    order = np.argsort(-bound, axis=1, kind="stable")
    ranked = np.take_along_axis(bound, order, axis=1)
    # Scores are rounded to six decimals.
    worst = np.full(len(q_ids), -np.inf if min_sim is None else min_sim) - 1e-6
    hits = spark.createDataFrame([], "q_id long, rnk int, id long, score double")
    at, step, read = 0, first_cells, np.zeros(len(q_ids), np.int64)
    while at < limit:
        stop = min(at + step, limit)
        able = (ranked[:, at:stop] >= worst[:, None]) & (ranked[:, at:stop] > -np.inf)
        probes = [(q, order[q, at:stop][able[q]]) for q in np.flatnonzero(able[:, 0]).tolist()]
        if not probes:
            break
        for q, cells in probes:
            read[q] += len(cells)
        cells = np.unique(np.concatenate([c for _, c in probes])).tolist()  # as many as there are centres at most
        new = K.scan(packed, rows.where(F.col("cell").isin(cells)), K.list_matrix, dim, k, "cosine", _Asked(probes), **options)
        hits = _kept(K.rank_hits(hits.select("q_id", "id", "score").unionByName(new), k), "probed")
        full = {r["q_id"]: r["score"] for r in hits.where(F.col("rnk") == k).select("q_id", "score").collect()}  # one per query
        if full:
            worst = np.maximum(worst, np.array([full.get(q, -np.inf) for q in q_ids.tolist()]) - 1e-6)
        at, step = stop, 2 * step
    # Queries read the cells at the front of their order.
    upto = np.concatenate([np.zeros((len(q_ids), 1), np.int64), np.cumsum(size[order], axis=1)], axis=1)
    effort = [(int(q), int(n), int(upto[i, n])) for i, (q, n) in enumerate(zip(q_ids, read))]
    return hits, spark.createDataFrame(effort, "q_id long, cells_read long, rows_read long")


def lsh_search(queries: DataFrame, corpus: DataFrame, k: int, dim: int, tables: int = 8,
               bucket_length: float = 0.5, seed: int = 7, skip_self: bool = False,
               max_bytes: int = K.BROADCAST_BYTES, block_rows: int = K.BLOCK_ROWS) -> DataFrame:
    """Top-k by cosine among entries that share a random-projection bucket with the query.

    Few queries (checked) are broadcast, and entries are hashed where they are read; many
    queries meet the buckets in the block grid. The pairs of a bucket are never listed.
    """
    assign = _Projections(dim, tables, bucket_length, seed)
    options = {"skip_self": skip_self, "overlap": False, "floor": None}
    packed = K.pack(queries, K.list_matrix, dim, max_bytes)
    if packed is not None:
        entries = corpus.select(F.col("id").cast("long").alias("id"), "v")
        hits = K.scan(packed, entries, K.list_matrix, dim, k, "cosine",
                      _Router(assign(packed[1]), assign), **options)
    else:
        hits = K.grid(_in_cells(queries, "q_id", dim, assign), _in_cells(corpus, "id", dim, assign),
                      K.list_matrix, dim, k, "cosine", block_rows, **options).distinct()
    return K.rank_hits(hits, k)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits of each query that the approximate result has."""
    found = approx.select("q_id", "id", F.lit(1).alias("_found"))
    return (exact.join(found, ["q_id", "id"], "left").groupBy("q_id")
            .agg((F.count("_found") / F.count(F.lit(1))).alias("recall")))
