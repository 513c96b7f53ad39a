"""Stored digests behind a filter, models that workers load once, metadata of entries."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from entrylake.operators import digests as G, entries as E, quality as Q, search as X


def sha(text):
    return hashlib.sha1(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def breached(spark):
    rows = spark.range(20_000).select(F.sha1(F.concat(F.lit("old"), "id")).alias("digest"), F.lit(1).alias("lead"))
    return rows.unionByName(rows.limit(50)).unionByName(spark.createDataFrame([(None, 1), ("", 1), (sha("old1").upper(), 1), ("zz" * 20, 1)], "digest string, lead int"))


@pytest.fixture(scope="module")
def root(spark, breached, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("digests"))
    assert G.digests_save(breached, place, "d", width=2) == 1
    return place


def accounts(spark, passwords):
    rows = [(i, p, p, "own", i % 2) for i, p in enumerate(passwords)]
    return spark.createDataFrame(rows, "seq long, password string, password_confirmation string, digest string, block long")


def test_same_rows_as_the_join(spark, breached, root):
    batch = accounts(spark, [f"old{i}" for i in range(0, 40_000, 7)] + [None, "", "old7", "é" * 3000] + ["old14"] * 400)
    got = G.screen_breached_stored(batch, root, "d")
    assert got.columns == ["seq", "digest", "block"]
    want = Q.screen_breached(batch.select("seq", "password"), breached)
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in want.collect()) != []


def test_filter_misses_nothing_and_rules_out_most(spark, breached, root):
    stored = G.digest_candidates(breached, root, "d")
    assert {r.digest.lower() for r in stored.collect()} == {sha(f"old{i}") for i in range(20_000)}
    fresh = spark.range(50_000).select(F.sha1(F.concat(F.lit("new"), "id")).alias("digest"))
    assert G.digest_candidates(fresh, root, "d").count() < 0.02 * 50_000


def test_filter_when_blocks_are_full(spark, tmp_path):
    """With one digit, as many as 200,000 rows need, a folder has several blocks."""
    many = spark.range(200_000).select(F.sha1(F.concat(F.lit("old"), "id")).alias("digest"))
    G.digests_save(many, str(tmp_path), "d")
    fresh = spark.range(50_000).select(F.sha1(F.concat(F.lit("new"), "id")).alias("digest"))
    assert 0 < G.digest_candidates(fresh, str(tmp_path), "d").count() < 0.02 * 50_000
    assert G.digest_candidates(many, str(tmp_path), "d").count() == 200_000


def test_folders_read_follow_the_batch(spark, root):
    def folders(*passwords):
        batch = accounts(spark, passwords).select(F.sha1("password").alias("digest"))
        read = G.stored_digests(G.digest_candidates(batch, root, "d"), root, "d")
        return {os.path.basename(os.path.dirname(r[0])) for r in read.select(F.input_file_name()).distinct().collect()}

    assert folders("old3", "old3") == {f"lead={sha('old3')[:2]}"}
    assert folders("old3", "old4", "old5") == {f"lead={sha(p)[:2]}" for p in ("old3", "old4", "old5")}
    assert folders() == set() and len(folders(*[f"old{i}" for i in range(3000)])) == 256


def test_versions_and_empty_tables(spark, breached, tmp_path):
    batch = accounts(spark, ["old1", "old2"])
    with pytest.raises(FileNotFoundError):
        G.screen_breached_stored(batch, str(tmp_path), "d")
    G.digests_save(breached.limit(0), str(tmp_path), "d")
    assert G.screen_breached_stored(batch, str(tmp_path), "d").count() == 0
    G.digests_save(spark.createDataFrame([(sha("old2"),)], "digest string"), str(tmp_path), "d", width=3)
    assert [r.seq for r in G.screen_breached_stored(batch, str(tmp_path), "d").collect()] == [1]
    assert G.screen_breached_stored(batch.limit(0), str(tmp_path), "d").count() == 0
    with pytest.raises(ValueError):
        G.digests_save(breached, str(tmp_path), "d", width=5)


def test_a_worker_loads_its_model_once(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    entries = spark.range(3000).select("id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("body")).repartition(40)
    entries = entries.unionByName(spark.createDataFrame([(9999, None)], entries.schema))
    made = X.embed_model(entries, load, dim=2, batch=10)
    got = sorted((r.entry_id, r.dim, list(r.embedding)) for r in made.collect())
    assert got == [(i, 2, [float(i % 50), 1.0]) for i in range(3000)] + [(9999, 2, [0.0, 1.0])]
    pids = open(log).read().split()
    # 300 batches in 41 tasks
    assert len(pids) == len(set(pids)) <= 16
    plain = X.embed(entries, lambda texts: np.array([[len(t), 1.0] for t in texts]), dim=2)
    assert plain.schema.simpleString() == made.schema.simpleString()
    assert sorted((r.entry_id, r.dim, list(r.embedding)) for r in plain.collect()) == got
    assert X.embed_model(entries.limit(0), load, dim=2).count() == 0
    with pytest.raises(Exception, match="model returned"):
        X.embed_model(entries, lambda: lambda texts: np.zeros((len(texts), 3)), dim=2).collect()


def test_metadata(spark):
    raw = spark.createDataFrame([(1, '{"a": "x", "b": 7}'), (2, '{"a": null}'), (3, None), (4, "no json"), (5, '{"a": "x"}'), (6, "{}"),
                                 (5, '{"a": "x"}'), (7, '{"b": {"c": 1}, "é k": ""}')], "id long, metadata string").withColumn("key", F.lit("clash"))
    typed = E.parse_metadata(raw)

    def ids(**conditions):
        return sorted(r.id for r in E.filter_metadata(typed, **conditions).collect())

    assert ids() == [1, 2, 3, 4, 5, 5, 6, 7]
    assert ids(equals={"a": "x"}) == [1, 5, 5] and ids(equals={"a": "x", "b": "7"}) == [1] and ids(equals={"é k": ""}) == [7]
    assert ids(has=["a"]) == [1, 2, 5, 5] and ids(has=["a", "b"]) == [1]
    assert ids(lacks=["a"]) == [3, 4, 6, 7] and ids(has=["a"], lacks=["b"]) == [2, 5, 5]
    facets = {(r.key, r.value): r.entries for r in E.metadata_facets(typed).collect()}
    assert facets == {("a", "x"): 3, ("a", None): 1, ("b", "7"): 1, ("b", '{"c":1}'): 1, ("é k", ""): 1}
    assert {r.key for r in E.metadata_facets(typed, ["b"]).collect()} == {"b"}
    assert E.metadata_facets(typed.limit(0)).count() == 0
