"""Streaming jobs over several micro-batches against the batch jobs."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from entrylake.operators import search as X, temporal as T
from entrylake.session import work_dir
from entrylake.sources.tables import read_snapshot, write_snapshot
from entrylake.streaming import jobs as R

START = datetime(2024, 1, 1)


def put(df, place):
    """One more file for a stream; file times order the micro-batches."""
    df.coalesce(1).write.mode("append").parquet(place)
    time.sleep(0.05)


@pytest.fixture(scope="module")
def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet").withColumn("account", F.col("user_id") % 5).cache()


@pytest.fixture(scope="module")
def parts(spark, events):
    """The events in four files, in order of time."""
    place = work_dir(spark, "parts")
    for i in range(4):
        put(events.where(F.floor(F.col("event_id") / 250) == i), place)
    return place


def source(spark, events, place):
    return R.read_files(spark, place, events.schema, files_per_batch=1)


def finished(spark, result, **options):
    root = work_dir(spark, "run")
    query = R.write_files(result, f"{root}/out", f"{root}/progress", 4, **options)
    query.awaitTermination(200)
    assert not query.isActive
    return spark.read.schema(result.schema).parquet(f"{root}/out")


def test_limiter_equals_batch(spark, events, parts):
    got = finished(spark, R.stream_rate_limit(source(spark, events, parts), "account", "ts", "event_id", 5, 7200))
    want = T.rate_limit(events, "account", "ts", "event_id", 5, 7200)
    assert {r["id"]: (r["n"], r["allowed"]) for r in got.collect()} == {
        r["event_id"]: (r["n"], r["allowed"]) for r in want.collect()}


def test_limiter_ttl_must_exceed_window(spark, events, parts):
    with pytest.raises(ValueError):
        R.stream_rate_limit(source(spark, events, parts), "account", "ts", "event_id", 5, 60, ttl_seconds=60)


def test_limiter_with_life_ends_and_equals_batch(spark, events, parts):
    limited = R.stream_rate_limit(source(spark, events, parts), "account", "ts", "event_id", 5, 7200, ttl_seconds=86400)
    got = finished(spark, limited, idle_batches=False)
    want = T.rate_limit(events, "account", "ts", "event_id", 5, 7200)
    assert {r["id"]: r["n"] for r in got.collect()} == {r["event_id"]: r["n"] for r in want.collect()}


@pytest.mark.parametrize("rows_per_chunk", [10**6, 40])
def test_hot_key_limiter_equals_batch(spark, events, parts, rows_per_chunk):
    root = work_dir(spark, "hot")
    R.limit_stream(source(spark, events, parts), "account", "ts", "event_id", 5, 7200, root, f"{root}/progress",
                   rows_per_chunk=rows_per_chunk).awaitTermination(200)
    want = T.rate_limit(events, "account", "ts", "event_id", 5, 7200)
    got = spark.read.parquet(f"{root}/hits")
    assert got.select("batch").distinct().count() == 4
    assert {r["id"]: (r["n"], r["allowed"]) for r in got.collect()} == {
        r["event_id"]: (r["n"], r["allowed"]) for r in want.collect()}


def test_windows_and_sessions_equal_batch(spark, events, parts):
    place = work_dir(spark, "with-end")
    for i in range(4):
        put(events.where(F.floor(F.col("event_id") / 250) == i), place)
    end = events.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts"))
    put(end.select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"),
                   F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"),
                   F.lit(-1).cast("long").alias("account")), place)
    counts = finished(spark, R.stream_rate_count(source(spark, events, place), "account", "ts", 3600))
    want = T.rate_count(events, "account", "ts", 3600).collect()
    assert sorted((r["key"], str(r["window_start"]), r["n"]) for r in counts.where("key >= 0").collect()) == sorted(
        (r["key"], str(r["window_start"]), r["n"]) for r in want)
    sessions = finished(spark, R.stream_sessions(source(spark, events, place), "account", "ts", 20))
    want = T.sessionize(events, "account", "ts", "event_id", 20).collect()
    assert sorted((r["account"], str(r["first_ts"]), r["n"]) for r in sessions.where("account >= 0").collect()) == sorted(
        (r["account"], str(r["first_ts"]), r["n"]) for r in want)


CHANGE = "id long, body string, category string, seq long, op string, ts timestamp"


def test_ingest_merge_and_compact(spark):
    root, place = work_dir(spark, "ingest"), work_dir(spark, "changes")
    write_snapshot(spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")],
                                         "id long, body string, category string"), root, "entries")

    def send(*rows):
        put(spark.createDataFrame([(*r, START + timedelta(seconds=r[3])) for r in rows], CHANGE), place)
        stream = R.read_files(spark, place, spark.createDataFrame([], CHANGE).schema, files_per_batch=1)
        R.ingest_stream(stream, root, f"{root}/progress", ts="ts", state_partitions=2).awaitTermination(200)

    schema = spark.createDataFrame([], CHANGE).drop("ts").schema
    now = lambda: {r["id"]: r["body"] for r in R.current_entries(spark, root, schema).collect()}
    send((1, "a2", "x", 1, "update"), (2, "", "x", 2, "delete"), (4, "", "x", 3, "create"), (5, "e", "x", 4, "create"))
    assert now() == {1: "a2", 3: "c", 5: "e"}
    assert R.compact_entries(spark, root, schema) == 2
    assert now() == {1: "a2", 3: "c", 5: "e"}
    send((1, "a3", "x", 11, "update"), (1, "a2", "x", 10, "update"), (5, "", "x", 12, "delete"))
    assert now() == {1: "a3", 3: "c"}
    assert read_snapshot(spark, root, "entries").count() == 3
    R.compact_entries(spark, root, schema)
    assert {r["id"]: r["body"] for r in read_snapshot(spark, root, "entries").collect()} == {1: "a3", 3: "c"}


def test_search_streams_equal_batch(spark, small):
    root = work_dir(spark, "search")
    entries = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id id", "text body")
    asked = spark.read.parquet(f"{small}/benchmark.parquet").selectExpr("item_id q_id", "text")
    for i in range(2):
        put(asked.where(F.col("q_id") % 2 == i), f"{root}/in")
    stream = R.read_files(spark, f"{root}/in", asked.schema, files_per_batch=1)
    R.search_stream(stream, entries, 3, f"{root}/out", f"{root}/progress").awaitTermination(200)
    got = spark.read.parquet(f"{root}/out").select("q_id", "rnk", "id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, X.search(asked, entries, 3).collect()))


def test_live_keys(spark):
    place = work_dir(spark, "writes")
    put(spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 3)], "key string, value string, seq long"), place)
    put(spark.createDataFrame([("a", "old", 1), ("b", "2", 9)], "key string, value string, seq long"), place)
    schema = spark.read.parquet(place).schema
    run = lambda seconds: sorted(tuple(r) for r in finished(spark, R.stream_live_keys(
        R.read_files(spark, place, schema, files_per_batch=1), seconds), idle_batches=False).collect())
    assert run(3600) == [("a", "2", 2, "created"), ("b", "1", 3, "created"), ("b", "2", 9, "replaced")]
