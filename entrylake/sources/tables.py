"""Table files, versioned snapshots, relational tables, schema changes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

_SMALL_INPUT = 256 * 2**20


def read_table(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """A Parquet table below ``root`` (any Hadoop path), with its declared schema."""
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input of few bytes but much work per row over all cores.

    A single small file is a single task otherwise. Inputs above 256 MB are returned as they
    are: their splits already keep every core busy, and shuffling them would cost more.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > _SMALL_INPUT:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def jdbc_options(url: str, table: str, key: str, low: int, high: int, partitions: int,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a parallel scan that splits ``table`` by ranges of its numeric key."""
    if partitions < 1 or high < low:
        raise ValueError("need at least one partition and low <= high")
    return {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(low),
            "upperBound": str(high + 1), "numPartitions": str(partitions),
            "fetchsize": str(fetch_size), "pushDownPredicate": "true", "pushDownAggregate": "true"}


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, partitions: int,
              bounds: tuple[int, int] | None = None, **properties: str) -> DataFrame:
    """Scan a relational table in parallel; the key range is asked from the database if not given.

    The driver class of the database must be on the class path (``driver="..."``).
    """
    if bounds is None:
        query = f"(select min({key}) as lo, max({key}) as hi from {table}) bounds"
        row = spark.read.format("jdbc").options(url=url, dbtable=query, **properties).load().first()
        bounds = (0, 0) if row is None or row[0] is None else (int(row[0]), int(row[1]))
    return (spark.read.format("jdbc")
            .options(**jdbc_options(url, table, key, *bounds, partitions), **properties).load())


def committed(spark: SparkSession, root: str, name: str) -> list[Row]:
    """Commit records of a table (version, upto), oldest first."""
    log = f"{root.rstrip('/')}/{name}/commits"
    try:
        rows = spark.read.schema("version long, upto long").json(log).distinct().collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(rows, key=lambda r: r["version"])


def write_snapshot(df: DataFrame, root: str, name: str, sort_by: list[str] | None = None,
                   partition_by: list[str] | None = None, upto: int | None = None) -> int:
    """Write the next version of a table and commit it; returns the version. One writer at a time.

    Data goes to a new folder, so the version being read is never overwritten. A version is
    visible only after its commit record is written; a job that dies leaves no half table.
    ``sort_by`` sorts inside the files for pruning by row-group statistics, ``partition_by``
    makes folders for pruning (a large one gets several files); ``upto`` notes the last
    micro-batch a snapshot has taken in.
    """
    spark = df.sparkSession
    done = committed(spark, root, name)
    version = done[-1]["version"] + 1 if done else 1
    base = f"{root.rstrip('/')}/{name}"
    out = df.hint("rebalance", *partition_by) if partition_by else df
    out = out.sortWithinPartitions(*(partition_by or []), *sort_by) if sort_by else out
    # A folder without a commit is what a failed attempt left behind.
    out.write.partitionBy(*(partition_by or [])).mode("overwrite").parquet(f"{base}/data/v={version}")
    spark.createDataFrame([(version, upto)], "version long, upto long").coalesce(1) \
        .write.mode("append").json(f"{base}/commits")
    return version


def read_snapshot(spark: SparkSession, root: str, name: str, schema: StructType | None = None,
                  version: int | None = None) -> DataFrame:
    """The last committed version of a table, or a given one."""
    done = [r["version"] for r in committed(spark, root, name)]
    if not done or (version is not None and version not in done):
        raise FileNotFoundError(f"{name}: no committed version {version or ''}".strip())
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{root.rstrip('/')}/{name}/data/v={version or done[-1]}")


def evolve(df: DataFrame, target: StructType) -> DataFrame:
    """Bring a table to the columns, order and types of ``target``.

    New columns are null, columns that ``target`` lacks are dropped; so the same call goes
    forward and back.
    """
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.fields])
