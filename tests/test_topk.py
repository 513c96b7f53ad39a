"""What the best k of many queries cost: memory of a tile, sparse text queries, one group of blocks for a task."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from entrylake.operators import compressed as C, search as X, topk as K


def test_scoring_takes_the_memory_of_a_tile():
    rng = np.random.default_rng(3)
    asked, block = rng.normal(size=(20_000, 8)), rng.normal(size=(2_000, 8))
    best = K.Best(np.arange(20_000), asked, 3, "cosine", False, False, None)
    tracemalloc.start()
    best.add(np.arange(2_000), block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * 2**20


def test_short_text_queries_are_broadcast_by_their_tokens(spark):
    asked = spark.range(100).select(F.col("id").alias("q_id"), F.array(F.lit("one"), F.col("id").cast("string")).alias("v"))
    ids, queries = K.pack(asked, K.code_matrix, 1536, max_bytes=4000)
    assert len(ids) == len(queries) == 100
    assert K.pack(asked, K.code_matrix, 1536, max_bytes=2000) is None


def test_sums_of_codes_equal_products_at_any_weight():
    rng = np.random.default_rng(4)
    for high in (3, 3_000):
        asked = rng.integers(-2, 3, size=(70, 40)) * (rng.random((70, 40)) < 0.3)
        asked[0] = 9  # longer than the queries that are added up
        asked = asked[asked.any(axis=1)].astype(float)
        block = rng.integers(-high, high, size=(600, 40)).astype(float)
        best = K.Best(np.arange(len(asked)), K.Coded(40, *K.Coded.split(asked)), 4, "cosine", False, True, None)
        best.add(np.arange(600), block)
        near = K._round(asked @ block.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(block, axis=1))
        want = [sorted(range(600), key=lambda i: (-row[i], i))[:4] for row in near]
        assert best.ids.tolist() == want


def test_blocks_of_the_grid_are_not_merged_into_few_tasks(spark):
    rows = spark.range(300).select(F.col("id"), F.array([F.sin(F.col("id") + i) for i in range(4)]).alias("v"), F.lit(0).alias("cell"))
    hits = K.grid(rows.withColumnRenamed("id", "q_id"), rows, K.list_matrix, 4, 2, "cosine", 30, skip_self=True, overlap=False, floor=None)
    assert hits.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_codes_that_rule_out_little_write_little(spark, monkeypatch):
    written, kept = {}, C._kept

    def counted(df, purpose):
        made = kept(df, purpose)
        written[purpose] = made.count()
        return made

    monkeypatch.setattr(C, "_kept", counted)
    noise = np.random.default_rng(5).normal(size=(1500, 16))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(noise)], "id long, v array<double>")
    asked = corpus.where("id % 75 = 0").withColumnRenamed("id", "q_id")
    found = C.pq_search(asked, C.pq_build(X.ivf_build(corpus, 16, cells=2), parts=1), 2, nprobe=2, skip_self=True).hits
    want = X.knn(asked, corpus, 2, 16, skip_self=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert max(written.values()) < 20 * 1500 / 10


def test_guesses_that_rule_out_little_are_not_followed_by_scores_of_all(monkeypatch):
    rng, counted, score = np.random.default_rng(6), [], K.Best._score
    monkeypatch.setattr(K.Best, "_score", lambda self, ids, block, length, q, r: counted.append(len(q)) or score(self, ids, block, length, q, r))
    asked, block = rng.normal(size=(300, 16)), rng.normal(size=(2000, 16))
    unit = block / np.linalg.norm(block, axis=1)[:, None]
    guess = unit + 0.15 * rng.normal(size=unit.shape)
    best = K.Best(np.arange(300), asked, 3, "cosine", True, False, np.full(300, 0.5))
    best.add(np.arange(2000), block, guess=(guess, np.linalg.norm(unit - guess, axis=1) + 1e-6))
    near = K._round(asked @ unit.T / np.linalg.norm(asked, axis=1)[:, None])
    np.fill_diagonal(near, -1)
    assert best.ids.tolist() == [sorted(range(2000), key=lambda i: (-row[i], i))[:3] for row in near]
    assert sum(counted) < best.scored.sum() / 4


def test_cells_that_all_queries_probe_are_scored_together(spark):
    probes = np.array([[0, 2], [2, 1], [2, 0]])
    route = X._Router(np.sort(np.concatenate([probes, np.full((3, 1), 3)], axis=1), axis=1), None, joined=True)
    batch = pa.RecordBatch.from_arrays([pa.array([3, 0, 2, 3, 1])], names=["cell"])
    found = sorted((entries.tolist(), asked.tolist()) for entries, asked in route(batch, np.arange(5), None))
    assert found == [([0, 2, 3], [0, 1, 2]), ([1], [0, 2]), ([4], [1])]


def test_unit_vectors_equal_those_of_spark(spark):
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(7).normal(size=(200, 24)))]
                                 + [(900, None), (901, [0.0] * 24), (902, [1.0])], "id long, v array<float>")
    want = X.normalize(rows.where("id < 900"), "v").select("v")
    assert sorted(map(tuple, rows.select("v").mapInArrow(X._unit_vectors(24), "v array<double>").collect())) == sorted(map(tuple, want.collect()))


def test_sparse_queries_are_not_unfolded_to_be_scored(monkeypatch):
    rng, unfolded, full = np.random.default_rng(8), [], K.Coded.full
    asked = rng.integers(-2, 3, size=(400, 512)) * (rng.random((400, 512)) < 0.02)
    asked = asked[asked.any(axis=1)].astype(float)
    block = (rng.integers(-4, 5, size=(700, 512)) * (rng.random((700, 512)) < 0.3)).astype(float)
    best = K.Best(np.arange(len(asked)), K.Coded(512, *K.Coded.split(asked)), 4, "cosine", False, True, None)
    monkeypatch.setattr(K.Coded, "full", lambda self, which: unfolded.append(len(which)) or full(self, which))
    best.add(np.arange(700), block)
    near = K._round(asked @ block.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(block, axis=1))
    assert best.ids.tolist() == [sorted(range(700), key=lambda i: (-row[i], i))[:4] for row in near]
    assert not sum(unfolded)


def test_short_queries_come_in_larger_blocks_than_long_entries(spark, monkeypatch):
    words = [f"{a}{b}" for a in "abcdef" for b in "ghijkl"]
    entries = spark.range(600).select("id", F.array(*[F.element_at(F.array(*map(F.lit, words)), (F.xxhash64(F.lit(i), "id") % 18 + 18 + 1).cast("int")) for i in range(40)]).alias("v"))
    asked = entries.where("id < 200").select(F.col("id").alias("q_id"), F.slice("v", 1, 2).alias("v"))
    sizes, grid = [], K.grid
    monkeypatch.setattr(K, "grid", lambda *given, query_rows=None, **more: sizes.append(query_rows) or grid(*given, query_rows=query_rows, **more))
    options = {"skip_self": False, "overlap": True, "floor": None}
    got = K.top_k(asked, entries, K.code_matrix, 64, 3, "cosine", 10, 10, **options)
    want = K.top_k(asked, entries, K.code_matrix, 64, 3, "cosine", **options)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(sizes) == 1 and sizes[0] > 50
