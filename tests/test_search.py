"""Exact search against brute force in both plans; approximate search by its bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from entrylake.operators import search as X, topk as K

DIM = 16


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, DIM)).astype(np.float32)
    v[100:240] = v[100]          # a third are copies of one vector
    v[300] = 0
    return v


@pytest.fixture(scope="module")
def corpus(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [1.0] * (DIM - 1)), (902, [float("nan")] * DIM)]
    return spark.createDataFrame(rows, "id long, v array<float>").repartition(5)


@pytest.fixture(scope="module")
def queries(corpus):
    return corpus.where("id < 130 or id = 300 or id >= 900").withColumnRenamed("id", "q_id")


def brute(vectors, k, metric, skip_self, floor=None):
    v = vectors.astype(np.float64)
    out = []
    for q in range(130):
        scored = []
        for i in range(len(v)):
            if not v[i].any() or (skip_self and i == q):
                continue
            dot = float(v[q] @ v[i])
            s = {"cosine": lambda: dot / math.sqrt((v[q] @ v[q]) * (v[i] @ v[i])), "inner": lambda: dot,
                 "l2": lambda: math.sqrt(((v[q] - v[i]) ** 2).sum())}[metric]()
            s = round(s, 6) + 0.0
            if floor is None or (s <= floor if metric == "l2" else s >= floor):
                scored.append(((s if metric == "l2" else -s), i, s))
        out += [(q, r + 1, i, s) for r, (_, i, s) in enumerate(sorted(scored)[:k])]
    return out


def rows(df):
    return sorted((r["q_id"], r["rnk"], r["id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("metric,floor", [("cosine", None), ("l2", None), ("inner", None), ("cosine", 0.4), ("l2", 3.0)])
def test_knn_broadcast_and_grid_equal_brute_force(queries, corpus, vectors, metric, floor):
    want = brute(vectors, 5, metric, True, floor)
    for limits in ({}, {"max_bytes": 10, "block_rows": 37}):
        got = rows(X.knn(queries, corpus, 5, DIM, metric, floor, skip_self=True, **limits))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))


def test_knn_filter_before_rank(spark, queries, corpus, vectors):
    even = spark.range(0, 400, 2)
    got = rows(X.knn(queries, corpus, 3, DIM, where=even))
    everything = brute(vectors, 400, "cosine", False)
    by_query = {}
    for q, _, i, s in everything:
        if i % 2 == 0 and len(by_query.setdefault(q, [])) < 3:
            by_query[q].append(i)
    assert [g[2] for g in got] == [i for q in sorted(by_query) for i in by_query[q]]
    assert rows(X.knn(queries, corpus, 3, DIM, where=F.col("id") % 2 == 0)) == got


def test_knn_rejects_unknown_metric(queries, corpus):
    with pytest.raises(ValueError):
        X.knn(queries, corpus, 5, DIM, "manhattan")


def test_no_usable_query(spark, corpus):
    none = spark.createDataFrame([(1, None)], "q_id long, v array<float>")
    assert X.knn(none, corpus, 5, DIM).count() == 0
    assert X.knn(none.where("q_id = 2"), corpus, 5, DIM).count() == 0


def test_ivf_grows_to_exact(queries, corpus):
    exact = X.knn(queries, corpus, 5, DIM, skip_self=True).cache()
    index = X.ivf_build(corpus, DIM, cells=6)
    recall = []
    for probes in (1, 3, 6):
        found = X.ivf_search(queries, index, 5, probes, skip_self=True)
        recall.append(X.recall_at_k(found, exact).agg(F.avg("recall")).first()[0])
    assert recall == sorted(recall) and recall[0] > 1 / 6 and recall[2] == 1.0
    assert rows(found) == rows(exact)
    in_grid = X.ivf_search(queries, index, 5, 2, skip_self=True, max_bytes=10, block_rows=30)
    assert rows(in_grid) == rows(X.ivf_search(queries, index, 5, 2, skip_self=True))


def test_saved_index_reads_probed_cells_only(spark, queries, corpus):
    from entrylake.session import work_dir
    path = work_dir(spark, "index")
    index = X.ivf_build(corpus, DIM, cells=6)
    X.ivf_save(index, path)
    loaded = X.ivf_load(spark, path)
    few = queries.where("q_id = 5")
    found = X.ivf_search(few, loaded, 5, 1)
    assert rows(found) == rows(X.ivf_search(few, index, 5, 1)) and found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cast(cell" in plan


def test_lsh_plans_agree_and_recall_grows_with_tables(queries, corpus):
    exact = X.knn(queries, corpus, 5, DIM, skip_self=True).cache()
    recall = []
    for tables in (1, 4, 16):
        few = X.lsh_search(queries, corpus, 5, DIM, tables, 0.2, skip_self=True)
        recall.append(X.recall_at_k(few, exact).agg(F.avg("recall")).first()[0])
    assert recall == sorted(recall) and 0 < recall[0] < recall[2] <= 1
    many = X.lsh_search(queries, corpus, 5, DIM, 4, 0.2, skip_self=True, max_bytes=10, block_rows=25)
    assert rows(many) == rows(X.lsh_search(queries, corpus, 5, DIM, 4, 0.2, skip_self=True))


def text_brute(queries, entries, k, dim):
    import hashlib
    import regex

    def embed(text):
        out = {}
        for w in regex.findall(r"\p{L}+", text.lower()):
            h = hashlib.md5(w.encode()).hexdigest()
            b = int(h[:8], 16) % dim
            out[b] = out.get(b, 0) + (1 if h[8] < "8" else -1)
        return {b: w for b, w in out.items() if w}

    ev, out = {i: embed(t) for i, t in entries}, []
    for q, text in queries:
        a, scored = embed(text), []
        for i, b in ev.items():
            if set(a) & set(b):
                dot = sum(w * b.get(x, 0) for x, w in a.items())
                norm = math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
                s = round(dot / norm, 6) + 0.0
                scored.append((-s, i, s))
        out += [(q, r + 1, i, s) for r, (_, i, s) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_text_search_equals_brute_force(spark):
    words = "rate limit session token entry index vector queue größe été año".split()
    rng = np.random.default_rng(1)
    entries = [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(120)]
    asked = [(i, " ".join(rng.choice(words, 3))) for i in range(15)] + [(99, "12 34")]
    e = spark.createDataFrame(entries + [(500, None)], "id long, body string").repartition(4)
    q = spark.createDataFrame(asked, "q_id long, text string")
    want = text_brute(asked, entries, 4, 64)
    assert rows(X.search(q, e, 4, 64)) == want
    assert rows(X.search(q, X.encode_entries(e, 64), 4, 64)) == want
    assert rows(X.search(q, e, 4, 64, max_bytes=10, block_rows=20)) == want


def test_hash_embed_weights(spark):
    e = spark.createDataFrame([(1, "A a b"), (2, ""), (3, None)], "id long, body string")
    got = {(r["id"], abs(r["weight"])) for r in X.hash_embed(e).collect()}
    assert got == {(1, 2), (1, 1)}


def test_embed_checks_shape(spark):
    e = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, body string")
    made = X.embed(e, lambda texts: np.array([[len(t), 1.0] for t in texts]), dim=2)
    assert sorted((r["entry_id"], r["embedding"]) for r in made.collect()) == [(1, [1.0, 1.0]), (2, [2.0, 1.0])]
    with pytest.raises(Exception, match="model returned"):
        X.embed(e, lambda texts: np.zeros((len(texts), 3)), dim=2).collect()


def test_check_vectors(spark, corpus):
    got = {r["id"]: r["problem"] for r in X.check_vectors(corpus, "v", DIM).where("problem is not null").collect()}
    assert got == {300: "zero", 900: "null", 901: "width", 902: "element"}


def test_rounding_has_no_minus_zero():
    x = K._round(np.array([-1e-9, 0.0, -0.0000005, 1.2345675]))
    assert x.tolist() == [0.0, 0.0, -1e-06, 1.234568] and not np.signbit(x[0])
