"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from entrylake.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave. Nothing that is still to be computed may read them."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``most`` bytes of text in a column, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``kernel`` for ``mapInArrow``; at the end of a task its worker gives back the memory that it no longer needs, for idle workers stay."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(stream)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's library only
        if trim is not None:
            trim(0)
    return run


def batches(kernel: Callable[[pa.RecordBatch], dict | None], schema: pa.Schema):
    """A ``mapInArrow`` function from a kernel that makes columns out of one batch."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows and (made := kernel(batch)) is not None:
                yield pa.RecordBatch.from_pydict(made, schema=schema)
    return run
