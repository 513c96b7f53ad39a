"""Text search over stored posting lists: block maxima bound what a block can score, and blocks out of reach are not read.

Blocks hold about ``block_rows`` entries of one leading bucket (that of the largest weight) and similar length. A posting row holds what one bucket has in one block: positions,
weights, and the largest and smallest share of a unit vector; so a frequent bucket is many rows of bounded size. The row of bucket -1
is the directory of its block: ids and squared lengths. Folders hold ranges of buckets, so a search opens those of its own buckets only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .. import schemas as S
from ..functions.text import tokens
from ..sources.tables import read_snapshot, write_snapshot
from . import topk as K
from .search import _kept

BLOCK_ROWS = 256
#: Bands of length that the entries of one leading bucket are dealt into, at most.
_BANDS = 16
#: Buckets in a folder.
_FOLDER = 16
#: Queries that meet a block at a time.
_QUERIES = 2_000
#: Scores are rounded to six decimals; a bound must fall short by more than that.
_SLACK = 2e-6
_DIRECTORY = -1
_SPARSE = "id long, norm2 long, lead int, buckets array<int>, weights array<long>"
_POSTINGS = "bucket int, block long, hi double, lo double, n int, docs array<long>, weights array<long>"


@dataclass
class PostingIndex:
    """``postings`` (part, bucket, block, hi, lo, n, docs, weights) and the number of buckets."""

    postings: DataFrame
    dim: int


@dataclass
class PostingHits:
    """``hits`` (q_id, rnk, id, score); ``effort`` per query: blocks and postings that its buckets have, and those that were read."""

    hits: DataFrame
    effort: DataFrame


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _sparse(df: DataFrame, id_col: str, text: str, dim: int) -> DataFrame:
    """The hashed bag of each text that has one: (id, norm2, lead, buckets, weights). Null texts and texts without tokens are left out."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = K.rows_per_matrix(dim)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                rows, matrix = K.code_matrix(part.column("v"), dim)
                row, bucket = np.nonzero(matrix)
                cuts = np.searchsorted(row, np.arange(1, len(rows)))
                weight = matrix[row, bucket].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows)), pa.array(np.square(matrix).sum(1).astype(np.int64)),
                     pa.array(np.abs(matrix).argmax(1).astype(np.int32)),
                     _lists(np.split(bucket, cuts) if len(rows) else [], pa.int32()),
                     _lists(np.split(weight, cuts) if len(rows) else [], pa.int64())],
                    names=["id", "norm2", "lead", "buckets", "weights"])

    split = df.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), tokens(F.col(text)).alias("v"))
    return split.mapInArrow(kernel, _SPARSE)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row that each stands in."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))


def _invert(entries: pa.Table) -> pa.Table:
    """The posting rows and the directory of one block."""
    entries = entries.sort_by("id")
    norm2 = entries.column("norm2").to_numpy()
    bucket, row = _flat(entries.column("buckets"))
    weight, _ = _flat(entries.column("weights"))
    order = np.argsort(bucket, kind="stable")
    bucket, row, weight = bucket[order], row[order], weight[order]
    names, begins = np.unique(bucket, return_index=True)
    share = weight / np.sqrt(norm2[row])
    docs = [entries.column("id").to_numpy(), *np.split(row, begins[1:])]
    weights = [norm2, *np.split(weight, begins[1:])]
    # An entry without the bucket has the share 0.
    hi = np.concatenate([[0.0], np.maximum(np.maximum.reduceat(share, begins), 0.0)])
    lo = np.concatenate([[0.0], np.minimum(np.minimum.reduceat(share, begins), 0.0)])
    return pa.Table.from_arrays(
        [pa.array(np.concatenate([[_DIRECTORY], names]), pa.int32()), pa.array(np.full(len(docs), entries.column("block")[0].as_py())),
         pa.array(hi), pa.array(lo), pa.array([len(d) for d in docs], pa.int32()), _lists(docs, pa.int64()), _lists(weights, pa.int64())],
        names=["bucket", "block", "hi", "lo", "n", "docs", "weights"])


def postings_build(entries: DataFrame, root: str, dim: int = S.EMBEDDING_DIM, id_col: str = "id", text: str = "body",
                   block_rows: int = BLOCK_ROWS) -> int:
    """Write the posting lists of all entries as the next version below ``root``; ids are unique. Returns the version.

    Null texts and texts without tokens are in no list. The block of an entry follows from its own row and the counts, so a task that
    runs again makes the same block; many entries of one length, such as copies, are dealt into many blocks.
    """
    rows = _kept(_sparse(entries, id_col, text, dim), "sparse")
    shares = F.array(*[F.lit(i / _BANDS) for i in range(1, _BANDS)])
    leads = rows.groupBy("lead").agg(F.percentile_approx("norm2", shares).alias("cuts"),  # at most dim rows
                                     F.least(F.lit(_BANDS), F.ceil(F.count(F.lit(1)) / block_rows)).alias("bands"))
    passed = F.size(F.filter("cuts", lambda c: c < F.col("norm2")))
    banded = rows.join(F.broadcast(leads), "lead").withColumn("band", F.floor(passed * F.col("bands") / _BANDS))
    sizes = banded.groupBy("lead", "band").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))  # at most dim * _BANDS rows
    block = (F.shiftleft(F.col("lead").cast("long"), 44) + F.shiftleft(F.col("band").cast("long"), 36)
             + F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block")
    blocked = banded.join(F.broadcast(sizes), ["lead", "band"]).select("id", "norm2", "buckets", "weights", block)
    postings = blocked.groupBy("block").applyInArrow(_invert, _POSTINGS)
    folder = F.floor(F.col("bucket") / _FOLDER).cast("int")
    return write_snapshot(postings.withColumn("part", folder), root, "postings", sort_by=["block", "bucket"], partition_by=["part"])


def postings_load(spark: SparkSession, root: str, dim: int = S.EMBEDDING_DIM, version: int | None = None) -> PostingIndex:
    """The lists as of the last version, or a given one; ``dim`` is that of the building."""
    return PostingIndex(read_snapshot(spark, root, "postings", StructType.fromDDL(f"{_POSTINGS}, part int"), version), dim)


class _Scorer:
    """The best k entries of one block for each query that asks for it."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, lists: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"q_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        bucket = lists.column("bucket").to_numpy()
        if not asked.num_rows or len(bucket) < 2:
            return empty
        head = int(np.flatnonzero(bucket == _DIRECTORY)[0])
        ids, norm2 = (np.asarray(lists.column(c)[head].values) for c in ("docs", "weights"))
        docs, row = _flat(lists.column("docs"))
        weights, _ = _flat(lists.column("weights"))
        names, place = np.unique(bucket, return_inverse=True)
        body = row != head
        entries = np.zeros((len(names), len(ids)))
        entries[place[row[body]], docs[body]] = weights[body]
        theirs, who = _flat(asked.column("buckets"))
        value, _ = _flat(asked.column("weights"))
        at = np.minimum(np.searchsorted(names, theirs), len(names) - 1)
        held = names[at] == theirs
        queries = np.zeros((asked.num_rows, len(names)))
        queries[who[held], at[held]] = value[held]
        q2 = asked.column("norm2").to_numpy()
        score = K._round(queries @ entries / (np.sqrt(q2)[:, None] * np.sqrt(norm2)[None, :]))
        shared = (queries != 0).astype(np.float32) @ (entries != 0).astype(np.float32) > 0
        score[~shared] = -np.inf
        # Ids ascend within a block, so a stable sort leaves the smaller one first.
        best = np.argsort(-score, axis=1, kind="stable")[:, :self.k]
        q, rank = np.nonzero(np.take_along_axis(score, best, 1) > -np.inf)
        found = best[q, rank]
        return pa.table({"q_id": asked.column("q_id").to_numpy()[q], "id": ids[found], "score": score[q, found]})


def _score(wanted: DataFrame, queries: DataFrame, index: PostingIndex, folders: list[int], groups: int, k: int) -> DataFrame:
    """Hits of the wanted pairs (q_id, block): a task gets one block and at most some thousand queries."""
    group = F.pmod(F.xxhash64("q_id"), F.lit(groups)).cast("int").alias("grp")
    asked = wanted.select("q_id", "block", group).join(queries, "q_id")
    # Of a block, the lists of the buckets that one of its queries has, and the directory.
    need = (asked.select("block", "grp", F.explode("buckets").alias("bucket"))
            .unionByName(asked.select("block", "grp", F.lit(_DIRECTORY).alias("bucket"))).distinct())
    lists = index.postings.where(F.col("part").isin(folders)).select("bucket", "block", "docs", "weights").join(need, ["block", "bucket"])
    asked = asked.toDF(*asked.columns)  # the other side of the cogroup came from it
    scorer = _Scorer(k)
    return (lists.groupBy("block", "grp").cogroup(asked.groupBy("block", "grp"))
            .applyInArrow(lambda left, right: scorer(left, right), K.RESULT))


def postings_search(queries: DataFrame, index: PostingIndex, k: int, first: int = 2) -> PostingHits:
    """Text search as ``search.search`` does it, from stored lists: queries (q_id, text), any number of them; the same hits.

    The maxima alone bound what each block can score for a query. Its ``first`` best blocks are read, which gives a k-th score; of the
    others only those are read whose bound reaches it. A query without tokens has no hits; one with fewer than k hits reads all its blocks.
    """
    asked = _kept(_sparse(queries, "q_id", "text", index.dim).withColumnRenamed("id", "q_id"), "asked")
    groups = max(1, -(-asked.count() // _QUERIES))
    used = [r[0] for r in asked.select(F.explode(F.transform("buckets", lambda b: F.floor(b / _FOLDER).cast("int")))).distinct().collect()]
    folders = [_DIRECTORY, *used]  # at most dim / _FOLDER
    terms = asked.select("q_id", "norm2", F.explode(F.arrays_zip("buckets", "weights")).alias("t")).select(
        "q_id", "norm2", F.col("t.buckets").alias("bucket"), F.col("t.weights").alias("w"))
    heads = index.postings.where(F.col("part").isin(used)).select("bucket", "block", "hi", "lo", "n")
    reach = F.sum(F.greatest(F.col("w") * F.col("hi"), F.col("w") * F.col("lo"))) / F.sqrt(F.first("norm2"))
    bounds = terms.join(heads, "bucket").groupBy("q_id", "block").agg(reach.alias("bound"), F.sum("n").alias("n"))
    bounds = _kept(bounds, "bounds")
    best = Window.partitionBy("q_id").orderBy(F.col("bound").desc(), "block")
    opening = bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= first)
    opening = _kept(opening.select("q_id", "block", "n"), "opening")
    early = _kept(_score(opening, asked, index, folders, groups, k), "early")
    bar = K.rank_hits(early, k).where(F.col("rnk") == k).select("q_id", F.col("score").alias("bar"))
    in_reach = F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - _SLACK)
    later = bounds.join(opening.select("q_id", "block"), ["q_id", "block"], "left_anti").join(bar, "q_id", "left").where(in_reach)
    later = _kept(later.select("q_id", "block", "n"), "later")
    hits = K.rank_hits(early.unionByName(_score(later, asked, index, folders, groups, k)), k)
    read = opening.unionByName(later).groupBy("q_id").agg(F.count(F.lit(1)).alias("blocks_read"), F.sum("n").alias("postings_read"))
    held = bounds.groupBy("q_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("postings"))
    return PostingHits(hits, held.join(read, "q_id"))
