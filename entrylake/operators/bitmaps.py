"""Bitmaps of entries by category and tag: filters and facet counts without reading the entries.

A row holds the bits of one value in one range of 32 768 ids: (facet, value, bucket, bits). The facet ``all`` has every entry. Ids are unique
integers of any sign; sums over ranges need no ids, so a filter or a facet count costs a few kilobytes per value and range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Ids in a range; fixed by the bitmap functions of Spark.
_BITS = 32_768


def bitmap_build(entries: DataFrame) -> DataFrame:
    """Bitmaps of entries (id, category, tags). Null ids, categories, tag lists and tags have none."""
    def facet(name: str, value: Column) -> DataFrame:
        return entries.select(F.col("id").cast("long").alias("id"), F.lit(name).alias("facet"), value.alias("value"))

    values = facet("all", F.lit("")).unionByName(facet("category", F.col("category"))).unionByName(facet("tag", F.explode(F.array_distinct("tags"))))
    return (values.where("id is not null and value is not null").groupBy("facet", "value", F.bitmap_bucket_number("id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")))


def bitmap_filter(index: DataFrame, category: str | None = None, any_tags: list[str] | None = None,
                  all_tags: list[str] | None = None) -> DataFrame:
    """The entries that ``entries.filter_entries`` keeps, as bitmaps (bucket, bits); ranges without a bit may be missing.

    Only the rows of the named values are read. No condition keeps all entries; an empty list of tags is no condition.
    """
    def of(facet: str, values: list[str]) -> DataFrame:
        return index.where((F.col("facet") == facet) & F.col("value").isin(values)).select("bucket", "bits")

    parts = [] if category is None else [of("category", [category])]
    if any_tags:
        parts.append(of("tag", any_tags).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
    needed = len(parts)
    if all_tags:
        parts.append(of("tag", all_tags))  # a part for each tag
        needed += len(set(all_tags))
    if not parts:
        return of("all", [""])
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    met = together.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("parts"))
    return met.where(F.col("parts") == needed).where(F.bitmap_count("bits") > 0).select("bucket", "bits")


def bitmap_ids(bitmaps: DataFrame) -> DataFrame:
    """The ids of bitmaps (bucket, bits), a row each."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, bits in zip(batch.column("bucket").to_pylist(), batch.column("bits").to_pylist()):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype(np.int64)
                ids = (bucket - 1) * _BITS + at + 1 if bucket > 0 else bucket * _BITS - at
                yield pa.RecordBatch.from_arrays([pa.array(ids)], names=["id"])

    return bitmaps.select("bucket", "bits").mapInArrow(kernel, "id long")


def bitmap_facets(index: DataFrame, kept: DataFrame) -> DataFrame:
    """Entries per category and per tag (facet, value, entries) among those of a filter (bucket, bits); values without one are left out.

    Two bitmaps of a range meet in the task that joined them, before anything but their intersection is shuffled.
    """
    values = index.where("facet <> 'all'").join(kept.select("bucket", F.col("bits").alias("kept")), "bucket")
    both = values.select("facet", "value", "bucket", F.explode(F.array("bits", "kept")).alias("bits"))
    met = both.groupBy("facet", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return met.groupBy("facet", "value").agg(F.sum("n").alias("entries")).where("entries > 0")
