"""One registered query for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, capfilters, chat, differencing, infill, packing, ranked, simhash, suffix, syncmers, toxicity, urls, warc
from .common import table

RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
         urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> bpe.Vocabulary:
    """The vocabulary that texts are tokenised and packed with."""
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path(VOCABULARY))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_digest(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the labelled document with its number: bad if of low quality or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.filter_urls(table(spark, sf_dir, "pages"), outcomes, RULES)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.select("record_id", "type", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest",
                       F.col("headers")["WARC-Source-Payload-Digest"].alias("source_digest"), F.col("headers")["WARC-Source-Page"].alias("source_page"),
                       F.decode("block", "utf-8").alias("block"))


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_study(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_messages(chat.as_parts(given)))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), vocabulary())


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), vocabulary())


def op11_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differencing.pack_digest(table(spark, sf_dir, "documents"), vocabulary())


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_toxicity, op2_embedding_dedup, op3_simhash_dedup, op4_suffix_dedup, op5_url_filter, op6_warc_derivatives, op7_syncmer_fingerprints,
    op8_chat_format, op9_best_fit_packing, op10_bpe, op11_differencing_packing, op12_ranked_search, op13_fill_in_middle)}
