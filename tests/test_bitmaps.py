"""Bitmaps against filters and counts over the entries."""

import random

import pytest
from pyspark.sql import functions as F

from entrylake.operators import bitmaps as B, entries as E


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-100_000, 200_000), 1500) + [-32768 * 7, 400_001, 32768 * 20, 32768 * 20 + 1, 0, 2**40, -2**40]
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, []] + [rng.choices(["x", "y", "z", "w", None], k=rng.randint(1, 4)) for _ in range(6)]))
            for i in dict.fromkeys(ids)]
    return spark.createDataFrame(rows, "id long, category string, tags array<string>").withColumn("bits", F.lit("clash"))


@pytest.fixture(scope="module")
def index(spark, entries, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("bitmaps") / "t")
    B.bitmap_build(entries).write.parquet(place)
    return spark.read.parquet(place)


CASES = [(None, None, None), ("a", None, None), ("b", ["x", "w"], None), (None, ["x"], ["y", "y", "z"]), ("a", ["z", "w"], ["x"]),
         ("nothing", None, None), (None, ["x", "nothing"], None), (None, None, ["x", "nothing"])]


@pytest.mark.parametrize("category,any_tags,all_tags", CASES)
def test_filter_and_facets_equal_entries(entries, index, category, any_tags, all_tags):
    rows = entries.select("id", "category", "tags").collect()
    good = [r for r in rows if (category is None or r.category == category)
            and (not any_tags or set(any_tags) & set(r.tags or [])) and (not all_tags or set(all_tags) <= set(r.tags or []))]
    kept = B.bitmap_filter(index, category, any_tags, all_tags)
    assert sorted(r.id for r in B.bitmap_ids(kept).collect()) == sorted(r.id for r in good)
    want = {}
    for r in good:
        for key in [*([("category", r.category)] if r.category else []), *(("tag", t) for t in set(r.tags or []) if t is not None)]:
            want[key] = want.get(key, 0) + 1
    assert {(r.facet, r.value): r.entries for r in B.bitmap_facets(index, kept).collect()} == want


def test_same_as_filter_entries(entries, index):
    kept = B.bitmap_ids(B.bitmap_filter(index, "a", ["x", "y"], ["z"]))
    want = E.filter_entries(entries, "a", ["x", "y"], ["z"]).select("id")
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in want.collect())


def test_no_entries(entries):
    index = B.bitmap_build(entries.where("id is null"))
    kept = B.bitmap_filter(index, None, ["x"])
    assert B.bitmap_ids(kept).count() == 0 and B.bitmap_facets(index, kept).count() == 0
