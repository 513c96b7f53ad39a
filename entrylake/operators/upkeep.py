"""An inverted file that changes: appended segments, deleted ids, split cells, compaction.

Below ``root``/index lie the centres of every version, the rows of every version by cell (``rows/seg=N/cell=C``) and the ids that a version
replaced or deleted (``gone/seg=N``). A row is live if its id is not gone in a later version. A version counts once its commit record
is written, which also names the oldest version that is still read. A change batch writes its own rows only; a search reads the folders
of its cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import vector_problem
from ..sources.tables import committed
from .mutations import latest
from .search import IvfIndex, _Cells, _in_cells, _kept, normalize

_NAME = "index"
#: Rows of a cell that the centres of its halves are learnt from, at most (about).
SPLIT_ROWS = 200_000


def _versions(spark: SparkSession, root: str) -> tuple[int, int]:
    """The oldest version that is read, and the last one."""
    done = committed(spark, root, _NAME)
    if not done:
        raise FileNotFoundError(f"{root}: no index")
    return done[-1]["upto"], done[-1]["version"]


def _write(spark: SparkSession, root: str, version: int, oldest: int, centres: np.ndarray, rows: DataFrame, gone: DataFrame | None) -> int:
    """Rows (id, v, cell, ...) and gone ids of a version; what a failed attempt left behind is replaced."""
    base = f"{root.rstrip('/')}/{_NAME}"
    rows.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{base}/rows/seg={version}")
    ids = gone.select(F.col("id").cast("long").alias("id")) if gone is not None else spark.createDataFrame([], "id long")
    ids.write.mode("overwrite").parquet(f"{base}/gone/seg={version}")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell long, centre array<double>").coalesce(1) \
        .write.mode("overwrite").parquet(f"{base}/centres/seg={version}")
    spark.createDataFrame([(version, oldest)], "version long, upto long").coalesce(1).write.mode("append").json(f"{base}/commits")
    return version


def index_create(index: IvfIndex, root: str) -> int:
    """Write an index as the first version below ``root``; ids are unique. Returns the version."""
    spark = index.rows.sparkSession
    if committed(spark, root, _NAME):
        raise FileExistsError(f"{root}: an index is there")
    index.rows.limit(0).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{_NAME}/schema")
    return _write(spark, root, 1, 1, index.centres, index.rows, None)


def index_load(spark: SparkSession, root: str) -> IvfIndex:
    """The index as of the last committed version."""
    oldest, last = _versions(spark, root)
    base = f"{root.rstrip('/')}/{_NAME}"
    centres = spark.read.parquet(f"{base}/centres/seg={last}").orderBy("cell").collect()  # as many as there are centres
    schema = spark.read.parquet(f"{base}/schema").schema
    rows = (spark.read.schema(StructType([*schema.fields]).add("seg", "long")).option("basePath", f"{base}/rows")
            .parquet(*[f"{base}/rows/seg={n}" for n in range(oldest, last + 1)]))
    if last > oldest:
        gone = (spark.read.schema("id long, seg long").option("basePath", f"{base}/gone")
                .parquet(*[f"{base}/gone/seg={n}" for n in range(oldest + 1, last + 1)])
                .groupBy("id").agg(F.max("seg").alias("_gone")))
        rows = rows.join(gone, "id", "left").where(F.col("_gone").isNull() | (F.col("seg") >= F.col("_gone")))
    return IvfIndex(rows.select(*schema.names), np.array([c["centre"] for c in centres]))


def index_apply(spark: SparkSession, root: str, changes: DataFrame) -> int:
    """Append a batch of changes (id, v, seq, op, and the columns that the index keeps) as a version; returns it.

    Of several changes of an id the one with the highest ``seq`` counts. ``op = 'delete'`` removes the id, anything else sets its vector; a
    vector that cannot be searched removes it too. What is written grows with the batch, not with the index.
    """
    index = index_load(spark, root)
    oldest, last = _versions(spark, root)
    dim, keep = index.centres.shape[1], tuple(c for c in index.rows.columns if c not in ("id", "v", "cell"))
    newest = latest(changes.where("id is not null"), ["id"], "seq")
    put = newest.where(F.coalesce(F.col("op"), F.lit("")) != "delete").where(vector_problem(F.col("v"), dim).isNull())
    kind = index.rows.schema["v"].dataType
    rows = _in_cells(put.withColumn("v", F.col("v").cast(kind)), "id", dim, _Cells(index.centres, 1), keep)
    return _write(spark, root, last + 1, oldest, index.centres, rows.select(*index.rows.columns), newest)


def index_split(spark: SparkSession, root: str, max_rows: int, seed: int = 7) -> int | None:
    """Split the cells with more than ``max_rows`` live rows into two as a version; None if there are none.

    The halves' centres are learnt from about ``SPLIT_ROWS`` rows of the cell at most. All rows are compared to the new centres, but
    only those that move are written, so the index is that of a fresh build with the same centres. A cell whose vectors are all alike stays.
    """
    index = index_load(spark, root)
    oldest, last = _versions(spark, root)
    dim = index.centres.shape[1]
    full = {r["cell"]: r["count"] for r in index.rows.groupBy("cell").count().where(F.col("count") > max_rows).collect()}
    centres = index.centres.copy()
    for cell, n in sorted(full.items()):  # as many as there are centres at most
        some = normalize(index.rows.where(F.col("cell") == cell).select("id", "v"), "v")
        some = some if n <= SPLIT_ROWS else some.sample(SPLIT_ROWS / n, seed=seed)
        halves = np.array(KMeans(k=2, seed=seed, featuresCol="_f", maxIter=15).fit(some.select(array_to_vector("v").alias("_f"))).clusterCenters())
        if len(halves) == 2 and not np.array_equal(halves[0], halves[1]):
            centres[cell] = halves[0]
            centres = np.concatenate([centres, halves[1:]])
    if len(centres) == len(index.centres):
        return None
    keep = ("_from", *[c for c in index.rows.columns if c not in ("id", "v", "cell")])
    routed = _in_cells(index.rows.withColumnRenamed("cell", "_from"), "id", dim, _Cells(centres, 1), keep)
    moved = _kept(routed.where(F.col("cell") != F.col("_from")), "moved")
    return _write(spark, root, last + 1, oldest, centres, moved.select(*index.rows.columns), moved)


def index_compact(spark: SparkSession, root: str) -> int:
    """Rewrite the live rows as a version that needs none of the ones before; returns it. Searches under way go on with the old files."""
    index = index_load(spark, root)
    last = _versions(spark, root)[1]
    return _write(spark, root, last + 1, last + 1, index.centres, index.rows, None)
