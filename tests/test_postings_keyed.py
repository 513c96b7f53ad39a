"""Stored posting lists against the scan; tables that rewrite only touched buckets."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from entrylake.operators import mutations as M, postings as P, search as X
from entrylake.sources import keyed as T

DIM = 64
WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]


def texts(n, seed, longest=60):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS[(i % 10) * 30:][:40] + WORDS[:3], k=rng.randint(1, longest))) for i in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.select("q_id", "rnk", "id", "score").collect()))


@pytest.fixture(scope="module")
def entries(spark):
    rows = list(enumerate(texts(700, 1)))
    rows += [(1000 + i, rows[5][1]) for i in range(90)]  # copies: ties by id
    rows += [(2000, None), (2001, ""), (2002, "12 34"), (2003, "waa " * 30_000)]
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "id long, body string, block string, bucket int")


@pytest.fixture(scope="module")
def asked(spark):
    rows = list(enumerate(texts(60, 1)[:30] + texts(20, 7, 4))) + [(100, None), (101, ""), (102, "nowhere zzz"), (103, "waa")]
    return spark.createDataFrame(rows, "q_id long, text string")


@pytest.mark.parametrize("block_rows,first,k", [(32, 1, 5), (32, 3, 40), (1000, 2, 5), (7, 2, 3)])
def test_postings_equal_scan(spark, tmp_path, entries, asked, block_rows, first, k):
    P.postings_build(entries, str(tmp_path), DIM, block_rows=block_rows)
    found = P.postings_search(asked, P.postings_load(spark, str(tmp_path), DIM), k, first)
    assert rows_of(found.hits) == rows_of(X.search(asked, entries, k, DIM))


def test_hot_bucket_is_cut_and_lists_are_exact(spark, tmp_path, entries):
    P.postings_build(entries, str(tmp_path), DIM, block_rows=32)
    lists = P.postings_load(spark, str(tmp_path), DIM).postings
    assert lists.agg(F.max("n")).first()[0] < 150  # copies of one text share a band, not a block
    words = lists.where("bucket >= 0")
    bodies = lists.where("bucket = -1").select("block", F.posexplode("docs").alias("at", "id"))
    flat = words.select("bucket", "block", F.explode(F.arrays_zip("docs", "weights")).alias("e")).select(
        "bucket", "block", F.col("e.docs").alias("at"), F.col("e.weights").alias("weight"))
    got = flat.join(bodies, ["block", "at"]).select("id", "bucket", "weight")
    want = X.hash_embed(entries, DIM)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("id", "bucket", "weight").collect()))


def test_blocks_out_of_reach_are_not_read(spark, tmp_path, entries):
    P.postings_build(entries, str(tmp_path), DIM, block_rows=8)
    asked = entries.where("id < 20").select(F.col("id").alias("q_id"), F.col("body").alias("text"))
    effort = P.postings_search(asked, P.postings_load(spark, str(tmp_path), DIM), 1).effort.collect()
    assert len(effort) == 20
    assert all(r.blocks_read <= r.blocks and r.postings_read <= r.postings for r in effort)
    assert sum(r.postings_read for r in effort) < 0.5 * sum(r.postings for r in effort)


def test_postings_of_nothing(spark, tmp_path, entries, asked):
    P.postings_build(entries.where("id < 0"), str(tmp_path / "a"), DIM)
    assert P.postings_search(asked, P.postings_load(spark, str(tmp_path / "a"), DIM), 3).hits.count() == 0
    P.postings_build(entries, str(tmp_path / "b"), DIM)
    assert P.postings_search(asked.where("q_id < 0"), P.postings_load(spark, str(tmp_path / "b"), DIM), 3).hits.count() == 0


# --- tables by buckets of the key ----------------------------------------------------


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(f"{root}/t/data") for f in names if f.endswith(".parquet")}


def merge(rows, changes, keys):
    return M.upsert(rows, changes, keys, "seq", "op")


def changes_of(spark, rows):
    return spark.createDataFrame(rows, "key int, value string, seq long, op string")


def test_untouched_files_stay(spark, tmp_path):
    root = str(tmp_path)
    base = spark.range(400).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("value"), F.lit(5).cast("long").alias("seq"))
    assert T.keyed_create(base, root, "t", ["key"], buckets=32) == 1
    before = files(root)
    batch = changes_of(spark, [(3, "new", 9, "put"), (3, "older", 8, "put"), (7, "late", 1, "put"), (11, None, 9, "delete"), (900, "x", 1, "put")])
    touched = T.touched_buckets(batch, base.schema, ["key"], 32)
    assert T.keyed_apply(spark, root, "t", batch, merge) == 2
    after = files(root)
    assert before.items() <= after.items()
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in after.keys() - before.keys()} == set(touched)
    want = {i: (f"v{i}", 5) for i in range(400) if i != 11} | {3: ("new", 9), 900: ("x", 1)}
    assert {r.key: (r.value, r.seq) for r in T.keyed_read(spark, root, "t").collect()} == want
    assert T.keyed_read(spark, root, "t", version=1).count() == 400
    only = spark.createDataFrame([(3,), (11,), (900,), (12345,)], "key int")
    assert sorted(r.key for r in T.keyed_read(spark, root, "t", only=only).collect()) == [3, 900]
    read = T.keyed_read(spark, root, "t", only=only).inputFiles()
    assert 0 < len(read) <= len(T.touched_buckets(only, base.schema, ["key"], 32))


def test_many_batches_equal_one_table(spark, tmp_path):
    root, rng = str(tmp_path), random.Random(4)
    plain = {}
    base = changes_of(spark, []).select("key", "value", "seq")
    T.keyed_create(base, root, "t", ["key"], buckets=5)
    for turn in range(4):
        batch = [(rng.randint(0, 30), f"{turn}-{i}", turn * 100 + i, rng.choice(["put", "put", "delete"])) for i in range(25)]
        for key, value, seq, op in batch:
            plain.pop(key, None)
            if op == "put":
                plain[key] = (value, seq)
        T.keyed_apply(spark, root, "t", changes_of(spark, batch), merge)
    assert {r.key: (r.value, r.seq) for r in T.keyed_read(spark, root, "t").collect()} == plain
    everything = [(k, None, 10_000, "delete") for k in plain]
    last = T.keyed_apply(spark, root, "t", changes_of(spark, everything), merge)
    assert T.keyed_read(spark, root, "t").count() == 0
    assert T.keyed_apply(spark, root, "t", changes_of(spark, []), merge) == last
    assert T.keyed_read(spark, root, "t").dtypes == base.dtypes


def test_failed_batch_leaves_the_table(spark, tmp_path):
    root = str(tmp_path)
    T.keyed_create(spark.range(20).withColumnRenamed("id", "key"), root, "t", ["key"], buckets=4)

    def broken(rows, changes, keys):
        return rows.withColumn("key", F.raise_error(F.lit(uuid.uuid4().hex)).cast("long"))

    with pytest.raises(Exception):
        T.keyed_apply(spark, root, "t", spark.range(3).withColumnRenamed("id", "key"), broken)
    assert sorted(r.key for r in T.keyed_read(spark, root, "t").collect()) == list(range(20))
    T.keyed_apply(spark, root, "t", spark.range(3).withColumnRenamed("id", "key"), lambda rows, c, keys: rows.join(c, keys, "left_anti"))
    assert sorted(r.key for r in T.keyed_read(spark, root, "t").collect()) == list(range(3, 20))
    with pytest.raises(FileExistsError):
        T.keyed_create(spark.range(2), root, "t", ["id"])
    with pytest.raises(FileNotFoundError):
        T.keyed_read(spark, root, "t", version=9)
