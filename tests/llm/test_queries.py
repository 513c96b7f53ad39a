"""Registered queries against their SQL, and the entry points."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from compare import _cell, connect
from entrylake.llm import queries, sql
from entrylake.llm.common import table


@pytest.mark.parametrize("name", list(sql.SQL))
def test_equals_sql(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted("|".join(map(_cell, r)) for r in df.select(*names).collect())
    cursor = connect(small).execute(sql.SQL[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == names
    pick = [found.index(c) for c in names]
    assert got == sorted("|".join(_cell(r[i]) for i in pick) for r in cursor.fetchall())


def test_all_are_registered():
    names = entry_point.queries()
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in names and set(sql.SQL) <= set(names)


def test_pipeline_stages(spark, small, tmp_path):
    """Every stage keeps the columns, and its decisions reach the next one."""
    docs = table(spark, small, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.select("doc_id").distinct().count())
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] == sizes[4] > 0
    kept = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "suffix_dedup")).collect()}
    packed = {}
    for r in docs.collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    assert packed == {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) for i, r in kept.items()}
    assert all(r.n_chars == len(r.text) for r in kept.values())
    assert {tuple(r) for r in corpus_pipeline.run(spark, small).select("doc_id", "length").collect()} == {(r.doc_id, r.length) for r in docs.collect()}
