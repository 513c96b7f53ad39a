"""A table laid out by a hash of its key, where a batch of changes rewrites only the buckets that it touches.

Below ``root``/``name`` lie the buckets that each version wrote (``data/v=N/_bucket=B``) and one commit record per version, which names the
version that holds each bucket. Files of other buckets keep name and time. A version counts once its record is written, so a reader
never sees half a batch and may still read an older version.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

_BUCKET = "_bucket"
_RECORD = "version long, keys array<string>, schema string, held array<long>"


def _record(spark: SparkSession, root: str, name: str, version: int | None = None) -> Row | None:
    """The last commit record, or that of a version."""
    try:
        done = spark.read.schema(_RECORD).json(f"{root.rstrip('/')}/{name}/commits")
        wanted = done if version is None else done.where(F.col("version") == version)
        return wanted.orderBy(F.desc("version")).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _bucket(schema: StructType, keys: list[str], buckets: int) -> Column:
    """Of a row with these keys; a key of another type than the table's is cast to it first."""
    return F.pmod(F.xxhash64(*[F.col(k).cast(schema[k].dataType) for k in keys]), F.lit(buckets)).cast("int")


def _write(df: DataFrame, root: str, name: str, version: int, keys: list[str], schema: StructType, held: list[int], touched: list[int]) -> int:
    """Rows of the touched buckets and the record; what a failed attempt left behind is replaced."""
    spark = df.sparkSession
    base = f"{root.rstrip('/')}/{name}"
    path = f"{base}/data/v={version}"
    rows = df.withColumn(_BUCKET, _bucket(schema, keys, len(held))).hint("rebalance", _BUCKET)
    rows.write.partitionBy(_BUCKET).mode("overwrite").parquet(path)
    stored = spark.read.schema(StructType(list(schema.fields)).add(_BUCKET, IntegerType())).parquet(path)
    filled = {r[0] for r in stored.select(_BUCKET).distinct().collect()}  # at most as many as there are buckets
    for b in touched:
        held[b] = version if b in filled else 0
    spark.createDataFrame([(version, keys, schema.json(), held)], _RECORD).coalesce(1).write.mode("append").json(f"{base}/commits")
    return version


def _rows(spark: SparkSession, root: str, name: str, record: Row, buckets: list[int]) -> DataFrame:
    schema = StructType.fromJson(json.loads(record["schema"]))
    paths = [f"{root.rstrip('/')}/{name}/data/v={record['held'][b]}/{_BUCKET}={b}" for b in buckets if record["held"][b]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def keyed_create(df: DataFrame, root: str, name: str, keys: list[str], buckets: int = 256) -> int:
    """Write a table with unique keys as version 1. Buckets should hold some 100 MB each; their number stays."""
    if _BUCKET in df.columns:
        raise ValueError(f"a column may not be called {_BUCKET}")
    if _record(df.sparkSession, root, name) is not None:
        raise FileExistsError(f"{root}/{name}: a table is there")
    return _write(df, root, name, 1, keys, df.schema, [0] * buckets, list(range(buckets)))


def keyed_read(spark: SparkSession, root: str, name: str, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """The table as of the last version or a given one; with ``only`` (rows of keys), those keys, from their buckets alone."""
    record = _record(spark, root, name, version)
    if record is None:
        raise FileNotFoundError(f"{name}: no committed version {version or ''}".strip())
    if only is None:
        return _rows(spark, root, name, record, list(range(len(record["held"]))))
    schema = StructType.fromJson(json.loads(record["schema"]))
    keys = record["keys"]
    found = _rows(spark, root, name, record, touched_buckets(only, schema, keys, len(record["held"])))
    return found.join(only.select(*keys), keys, "left_semi")


def touched_buckets(changes: DataFrame, schema: StructType, keys: list[str], buckets: int) -> list[int]:
    """The buckets that hold the keys of some rows."""
    return sorted(r[0] for r in changes.select(_bucket(schema, keys, buckets).alias(_BUCKET)).distinct().collect())


def keyed_apply(spark: SparkSession, root: str, name: str, changes: DataFrame,
                merge: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> int:
    """Merge a batch into the buckets of its keys: ``merge(rows, changes, keys)`` gets their rows and returns the new ones.

    ``merge`` keeps keys as they are (``mutations.upsert`` does). A batch without rows changes nothing. Null keys have a bucket
    like others; what becomes of them is up to ``merge``. Returns the version. One writer at a time.
    """
    record = _record(spark, root, name)
    if record is None:
        raise FileNotFoundError(f"{name}: no table")
    schema = StructType.fromJson(json.loads(record["schema"]))
    keys, held = list(record["keys"]), list(record["held"])
    touched = touched_buckets(changes, schema, keys, len(held))
    if not touched:
        return record["version"]
    merged = merge(_rows(spark, root, name, record, touched), changes, keys)
    merged = merged.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return _write(merged, root, name, record["version"] + 1, keys, schema, held, touched)
