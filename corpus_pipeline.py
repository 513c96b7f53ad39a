"""A corpus from documents to packed sequences: toxic ones go, near copies go, repeated passages go, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from entrylake.llm import packing, shingles, suffix, toxicity
from entrylake.llm.common import stored, table
from entrylake.llm.queries import vocabulary


#: Texts may be long: with Spark's 10,000 rows a batch between it and Python takes tens of megabytes on either side.
BATCH_ROWS = 2_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts. Null and empty texts are judged too, repeated rows each; an empty table stays empty."""
    _small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (0.8 of five-word shingles in common): that of the smallest id.

    SimHash fingerprints link the nearest ones, MinHash bands the others; exact sets decide. Texts without words are copies of each other; null ids
    come last; repeated rows become one."""
    _small_batches(spark)
    return shingles.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of more than 50 words, or of 400 bytes, that stand elsewhere too. Null texts stay null."""
    _small_batches(spark)
    return suffix.remove_repeats(docs, words=50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token of every document in a training sequence; a text without tokens has a row without a place."""
    _small_batches(spark)
    return packing.pack_texts(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("best_fit_packing", pack)]

#: SQL cannot express a trained model, component search or packing; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
