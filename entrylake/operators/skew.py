"""Splitting hot keys without losing order.

Ordered logic per key (as-of, sessions, rate limits, numbering) normally sends a whole
key to one task. Here a key with more rows than ``rows_per_chunk`` is cut into runs of
consecutive rows, so that windows are partitioned by (key, chunk) and only one small
record per chunk is carried over to the next. Keys below the limit stay in chunk 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

ROWS_PER_CHUNK = 5_000_000
MAX_CHUNKS = 65_536
MAX_CHUNKS_PER_KEY = 4_096
_SAMPLES_PER_CHUNK = 200
_FANOUT = 64


@dataclass
class Chunked:
    """``df`` with an int column ``_chunk``; ``hot`` has the split keys, or is None."""

    df: DataFrame
    hot: DataFrame | None
    key: str

    @property
    def split(self) -> bool:
        return self.hot is not None

    def hot_rows(self) -> DataFrame:
        """Rows of split keys only. There are few such keys: each has about rows_per_chunk rows or more."""
        return self.df.join(F.broadcast(self.hot.select(self.key)), self.key, "left_semi")

    def attach(self, carry: DataFrame) -> DataFrame:
        """Join one carry record per (key, chunk); their number is bounded by 2 * MAX_CHUNKS."""
        return self.df.join(F.broadcast(carry), [self.key, "_chunk"], "left")


def chunk_hot_keys(df: DataFrame, key: str, order: list[str],
                   rows_per_chunk: int = ROWS_PER_CHUNK, at_most: int | None = None) -> Chunked:
    """Cut hot keys of ``df`` into runs along ``order`` (columns that order rows uniquely).

    Any choice of keys and cut points gives a correct result, so both come from a sample. The
    cut points are fetched once (about MAX_CHUNKS small records at most) and enter the plan as
    constants, so every later evaluation, also after a lost executor, puts a row into the
    same chunk.
    ``df`` must be deterministic, ``key`` is one non-null column. ``at_most`` is an upper
    bound of its rows, if that is known more cheaply than by counting.
    """
    spark = df.sparkSession
    whole = Chunked(df.withColumn("_chunk", F.lit(0)), None, key)
    if at_most is not None and at_most <= rows_per_chunk:
        return whole
    total = df.count()
    if total <= rows_per_chunk:
        return whole
    target = max(rows_per_chunk, -(-total // MAX_CHUNKS))
    # A sample shows which keys are large and where to cut them; small keys are dropped early.
    fraction = min(1.0, _SAMPLES_PER_CHUNK / target)
    w = Window.partitionBy(key)
    cuts = (df.select(key, F.struct(*order).alias("_o")).sample(fraction, seed=17)
            .withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") > target * fraction)
            .withColumn("_r", F.row_number().over(w.orderBy("_o")))
            .withColumn("_chunks", F.least(F.ceil(F.col("_n") / (target * fraction)), F.lit(MAX_CHUNKS_PER_KEY)))
            .withColumn("_c", F.floor((F.col("_r") - 1) * F.col("_chunks") / F.col("_n")))
            .groupBy(key, "_c").agg(F.min("_o").alias("_o")).where("_c > 0").collect())
    if not cuts:
        return whole
    bounds: dict = {}
    for r in cuts:
        bounds.setdefault(r[key], []).append(tuple(r["_o"]))
    for values in bounds.values():
        values.sort()
    key_type = df.schema[key].dataType
    hot_df = spark.createDataFrame([(k,) for k in bounds], StructType([StructField(key, key_type)]))

    # Two short lookups per hot row instead of one long list.
    order_type = StructType([StructField(c, df.schema[c].dataType) for c in order])
    tops, leaves = [], []
    for k, values in bounds.items():
        groups = [values[i:i + _FANOUT] for i in range(0, len(values), _FANOUT)]
        tops.append((k, [g[0] for g in groups[1:]]))
        leaves += [(k, i, g) for i, g in enumerate(groups)]
    top_df = spark.createDataFrame(tops, StructType(
        [StructField(key, key_type), StructField("_tops", ArrayType(order_type))]))
    leaf_df = spark.createDataFrame(leaves, StructType(
        [StructField(key, key_type), StructField("_g", IntegerType()),
         StructField("_leaf", ArrayType(order_type))]))

    def passed(bound_list: str) -> Column:
        here = F.struct(*[F.col(c) for c in order])
        return F.array_size(F.filter(F.col(bound_list), lambda b: b <= here))

    out = (df.join(F.broadcast(top_df), key, "left")
           .withColumn("_g", passed("_tops"))
           .join(F.broadcast(leaf_df), [key, "_g"], "left")
           .withColumn("_chunk", F.coalesce(F.col("_g") * _FANOUT + passed("_leaf"), F.lit(0)))
           .select(*df.columns, "_chunk"))
    return Chunked(out, hot_df, key)


def number_rows(df: DataFrame, order: list[str], name: str,
                rows_per_chunk: int = ROWS_PER_CHUNK, at_most: int | None = None) -> DataFrame:
    """Consecutive numbers 1..n in global ``order`` without sorting everything in one task."""
    keyed = df.withColumn("_all", F.lit(0))
    chunked = chunk_hot_keys(keyed, "_all", order, rows_per_chunk, at_most)
    local = F.row_number().over(Window.partitionBy("_all", "_chunk").orderBy(*order)).cast("long")
    if not chunked.split:
        return chunked.df.withColumn(name, local).drop("_all", "_chunk")
    before = Window.partitionBy("_all").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (chunked.df.groupBy("_all", "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
               .select("_all", "_chunk",
                       F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")))
    return (chunked.attach(offsets).withColumn(name, local + F.col("_offset"))
            .drop("_all", "_chunk", "_offset"))
