"""Filtered, compressed and changing indexes against exact search."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from entrylake.operators import compressed as C, search as X, upkeep as U

DIM = 16


def vectors(n, seed, groups=12, dim=DIM):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return centre[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dim))


def corpus_of(spark, rows):
    return spark.createDataFrame([(i, v.tolist() if v is not None else None, i % 5) for i, v in rows], "id long, v array<double>, kind int")


def queries_of(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in rows], "q_id long, v array<double>")


def rows_of(df):
    return sorted(map(tuple, df.select("q_id", "rnk", "id", "score").collect()))


@pytest.fixture(scope="module")
def data(spark):
    corpus = [*enumerate(vectors(900, 1))] + [(5000, None), (5001, np.zeros(DIM)), (5002, np.full(DIM, np.nan)), (5003, np.ones(3))]
    asked = [(100 + i, v) for i, v in enumerate(vectors(40, 1)[:25])] + [(900 + i, v) for i, v in enumerate(vectors(15, 9))]
    return corpus_of(spark, corpus), queries_of(spark, asked)


@pytest.fixture(scope="module")
def index(spark, data):
    made = X.ivf_build(data[0], DIM, cells=24, keep=("kind",))
    return X.IvfIndex(X._kept(made.rows, "index"), made.centres)


def recall(got, want):
    want = {(q, i) for q, _, i, _ in want}
    return len({(q, i) for q, _, i, _ in got} & want) / len(want)


# --- filters

@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000))
def test_no_entry_exceeds_the_bound_of_its_cell(seed):
    rows, centres = vectors(80, seed), vectors(6, seed + 1)
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    near = rows @ unit.T / np.linalg.norm(rows, axis=1)[:, None]
    cell = near.argmax(axis=1)
    reach = np.array([np.arccos(np.clip(near[cell == c, c], -1, 1)).max(initial=0) for c in range(6)])
    asked = vectors(10, seed + 2)
    score = asked @ rows.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(rows, axis=1)
    assert (score <= X._bounds(asked, centres, reach)[:, cell] + 1e-9).all()


@pytest.mark.parametrize("options", [{}, {"min_sim": 0.8}, {"skip_self": True}, {"min_sim": 2.0}])
def test_filtered_search_is_exact(spark, data, index, options):
    corpus, asked = data
    ids = corpus.where("id % 7 < 3").select("id")
    for where in (None, F.col("kind") == 2, F.col("kind") > 9, ids, ids.unionByName(ids)):
        got = X.ivf_filtered(asked, index, 4, where, **options)
        assert rows_of(got.hits) == rows_of(X.knn(asked, corpus, 4, DIM, where=where, **options))
        assert got.effort.count() == asked.count()


def test_filtered_search_reads_few_cells(spark, data, index):
    corpus, asked = data
    exact = X.ivf_filtered(asked, index, 4)
    read = exact.effort.agg(F.avg("cells_read"), F.avg("rows_read")).first()
    assert read[0] < 12 and read[1] < 600  # of 24 cells and 900 rows
    want = rows_of(X.knn(asked, corpus, 4, DIM, where=F.col("kind") == 1))
    part = X.ivf_filtered(asked, index, 4, F.col("kind") == 1, max_cells=6)
    assert part.effort.agg(F.max("cells_read")).first()[0] <= 6
    assert recall(rows_of(part.hits), want) >= 0.9
    one = X.ivf_filtered(asked, index, 4, F.col("kind") == 1, max_cells=1)
    assert recall(rows_of(one.hits), want) <= recall(rows_of(part.hits), want)


def test_filtered_search_in_blocks_and_of_nothing(spark, data, index):
    corpus, asked = data
    whole = rows_of(X.ivf_filtered(asked, index, 3, F.col("kind") == 0).hits)
    assert rows_of(X.ivf_filtered(asked, index, 3, F.col("kind") == 0, max_bytes=24 * 8 * 10).hits) == whole
    none = X.ivf_filtered(asked.limit(0), index, 3)
    assert none.hits.count() == 0 and none.effort.count() == 0
    few = X.ivf_filtered(asked, index, 3, F.col("id") == 7).hits
    assert {r.id for r in few.collect()} == {7} and few.count() == asked.count()
    with pytest.raises(ValueError):
        X.ivf_filtered(asked, index, 3, max_cells=0)


# --- codes

def test_codes_give_the_scan_of_the_vectors(spark, data, index):
    corpus, asked = data
    coded = C.pq_build(index, parts=8)
    for nprobe, skip in ((24, False), (24, True), (4, False)):
        got = C.pq_search(asked, coded, 4, nprobe, skip_self=skip)
        assert rows_of(got.hits) == rows_of(X.ivf_search(asked, index, 4, nprobe, skip_self=skip))
    effort = got.effort.agg(F.sum("bytes_read"), F.sum("plain_bytes"), F.sum("survivors"), F.sum("rows_read")).first()
    assert effort[2] < 0.4 * effort[3]
    everything = C.pq_search(asked, coded, 4, 24).effort.agg(F.sum("bytes_read"), F.sum("plain_bytes")).first()
    assert everything[0] < 0.5 * everything[1]


def test_coarse_codes_and_few_survivors(spark, data, index):
    corpus, asked = data
    want = rows_of(X.knn(asked, corpus, 4, DIM))
    coarse = C.pq_build(index, parts=2)
    assert rows_of(C.pq_search(asked, coarse, 4, 24).hits) == want
    few = C.pq_search(asked, coarse, 4, 24, survivors=40)
    assert few.effort.agg(F.max("survivors")).first()[0] <= 40
    assert recall(rows_of(few.hits), want) >= 0.9
    assert C.pq_search(asked.limit(0), coarse, 4, 24).hits.count() == 0
    with pytest.raises(ValueError):
        C.pq_build(index, parts=3)


def test_lost_length_bounds_the_error(spark, data, index):
    coded = C.pq_build(index, parts=4, train_bytes=1)  # learnt from a small sample
    unit = index.centres / np.linalg.norm(index.centres, axis=1, keepdims=True)
    given_rows = {r.id: np.array(r.v) for r in index.rows.collect()}
    rows = coded.codes.collect()
    assert len(rows) == len(given_rows) == 900
    for r in rows:
        made = unit[r.cell] + np.concatenate([coded.books[p][c] for p, c in enumerate(bytes(r.code))])
        v = given_rows[r.id]
        assert np.linalg.norm(v / np.linalg.norm(v) - made) <= r.lost + 1e-9


def test_saved_codes(spark, data, index, tmp_path):
    coded = C.pq_build(index, parts=8)
    C.pq_save(coded, str(tmp_path / "pq"))
    again = C.pq_load(spark, str(tmp_path / "pq"))
    assert rows_of(C.pq_search(data[1], again, 3, 5).hits) == rows_of(X.ivf_search(data[1], index, 3, 5))


# --- upkeep

def test_index_after_changes_equals_a_fresh_one(spark, data, tmp_path):
    rng, root = random.Random(3), str(tmp_path)
    table = {i: v for i, v in enumerate(vectors(300, 4))}
    built = X.ivf_build(corpus_of(spark, table.items()), DIM, cells=6, keep=("kind",))
    assert U.index_create(built, root) == 1
    with pytest.raises(FileExistsError):
        U.index_create(built, root)
    asked = queries_of(spark, [*enumerate(vectors(20, 5))])

    def check():
        index = U.index_load(spark, root)
        fresh = X.IvfIndex(X._in_cells(corpus_of(spark, table.items()), "id", DIM, X._Cells(index.centres, 1), ("kind",)), index.centres)
        assert sorted((r.id, r.cell, r.kind) for r in index.rows.collect()) == sorted((r.id, r.cell, r.kind) for r in fresh.rows.collect())
        assert rows_of(X.ivf_search(asked, index, 5, 2)) == rows_of(X.ivf_search(asked, fresh, 5, 2))
        return index

    shape = "id long, v array<double>, kind int, seq long, op string"
    for batch in range(3):
        changes = []
        for seq in range(60):
            i = rng.randrange(400)
            v = vectors(1, 1000 * batch + seq)[0]
            op = rng.choice(["put", None, "delete", "broken"])
            changes.append((i, [1.0] if op == "broken" else v.tolist(), i % 5, seq, op))
            table.pop(i, None)
            if op in ("put", None):
                table[i] = v
        U.index_apply(spark, root, spark.createDataFrame(changes + [(None, [1.0], 0, 0, "put")], shape))
        check()
    U.index_apply(spark, root, spark.createDataFrame([], shape))
    before = check()
    assert U.index_split(spark, root, max_rows=10**6) is None
    assert U.index_split(spark, root, max_rows=40) is not None
    assert len(check().centres) > len(before.centres)
    U.index_compact(spark, root)
    check()
    U.index_apply(spark, root, spark.createDataFrame([(1, None, 0, 1, "delete")], shape))
    table.pop(1, None)
    check()


def test_a_version_without_commit_does_not_count(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        U.index_load(spark, root)
    built = X.ivf_build(corpus_of(spark, enumerate(vectors(60, 2))), DIM, cells=3)
    U.index_create(built, root)
    broken = X._in_cells(corpus_of(spark, [(1, np.ones(DIM))]), "id", DIM, X._Cells(built.centres, 1))
    broken.write.partitionBy("cell").parquet(f"{root}/index/rows/seg=2")  # a job that died
    assert U.index_load(spark, root).rows.count() == 60
    shape = "id long, v array<double>, seq long, op string"
    U.index_apply(spark, root, spark.createDataFrame([(0, None, 1, "delete")], shape))
    assert U.index_load(spark, root).rows.count() == 59
