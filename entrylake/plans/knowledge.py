"""Registered queries: knowledge entries, embeddings, search."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bitmaps as B, compressed as C, entries as E, postings as P, search as X, upkeep as U
from ..session import work_dir
from ..sources.tables import read_snapshot, spread_small, write_snapshot
from .inputs import spread_table, table, view, with_views

_DIM = 64


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every stored vector is a query for its neighbours."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return spread_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))


def _knn(metric: str, min_sim: float | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return X.knn(_vector_queries(spark, d), _corpus(spark, d), 5, _DIM, metric, min_sim, skip_self=True)
    return run


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    return X.knn(_vector_queries(spark, d), _corpus(spark, d), 5, _DIM, where=_good_entries(spark, d), skip_self=True)


def _search(spark: SparkSession, d: str) -> DataFrame:
    return X.search(view(spark, d, "queries"), _entries(spark, d), 5)


def _postings_hits(spark: SparkSession, d: str) -> DataFrame:
    """The searches of ``text_search``, from posting lists that were stored before."""
    root = work_dir(spark, "postings")
    P.postings_build(_entries(spark, d), root)
    return P.postings_search(view(spark, d, "queries"), P.postings_load(spark, root), 5).hits


def _replay(spark: SparkSession, d: str) -> DataFrame:
    return X.search_log(table(spark, d, "conversations"), _entries(spark, d), 3)


def _hits_with_resources(spark: SparkSession, d: str) -> DataFrame:
    bodies = spread_small(view(spark, d, "markdown"))
    found = E.extract_code(bodies).unionByName(E.extract_links(bodies, "id", "body", "markdown"))
    return E.with_resources(_search(spark, d), found)


def _ivf(spark: SparkSession, d: str) -> DataFrame:
    index = X.ivf_build(_corpus(spark, d), _DIM, cells=16)
    return X.ivf_search(_vector_queries(spark, d), index, 5, nprobe=8, skip_self=True)


def _ivf_full(spark: SparkSession, d: str) -> DataFrame:
    index = X.ivf_build(_corpus(spark, d), _DIM, cells=4)
    return X.ivf_search(_vector_queries(spark, d), index, 5, nprobe=4, skip_self=True)


def _good_entries(spark: SparkSession, d: str) -> DataFrame:
    return E.filter_entries(view(spark, d, "entries"), any_tags=["de", "fr"], all_tags=["unrated"])


def _ivf_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter of ``knn_filtered``, given as ids; all cells may be read."""
    index = X.ivf_build(_corpus(spark, d), _DIM, cells=16)
    return X.ivf_filtered(_vector_queries(spark, d), index, 5, _good_entries(spark, d), skip_self=True).hits


def _ivf_where(spark: SparkSession, d: str) -> DataFrame:
    """A condition on a column that the index keeps, and a floor."""
    corpus = spread_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    index = X.ivf_build(corpus, _DIM, cells=16, keep=("label",))
    return X.ivf_filtered(_vector_queries(spark, d), index, 5, F.col("label").isin(1, 4, 7), min_sim=0.2, skip_self=True).hits


def _pq(spark: SparkSession, d: str) -> DataFrame:
    """Codes of 16 bytes in all cells; exact scores for the entries that they cannot rule out."""
    index = C.pq_build(X.ivf_build(_corpus(spark, d), _DIM, cells=16), parts=16)
    return C.pq_search(_vector_queries(spark, d), index, 5, nprobe=16, skip_self=True).hits


def _upkept(spark: SparkSession, d: str) -> DataFrame:
    """An index after two batches of changes, the splitting of its large cells and a compaction, searched in all cells."""
    root = work_dir(spark, "index")
    corpus = _corpus(spark, d)
    U.index_create(X.ivf_build(corpus, _DIM, cells=8), root)
    first = corpus.where("id % 3 = 0").select("id", F.reverse("v").alias("v"), F.lit(1).alias("seq"), F.when(F.col("id") % 2 == 0, "delete").alias("op"))
    U.index_apply(spark, root, first.unionByName(first.select("id", F.array(F.lit(1.0)).alias("v"), F.lit(0).alias("seq"), F.lit("put").alias("op"))))
    second = corpus.where("id % 5 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(1000000)).alias("id"),
                                               F.reverse("v").alias("v"), F.lit(2).alias("seq"), F.lit("put").alias("op"))
    U.index_apply(spark, root, second)
    U.index_split(spark, root, max_rows=60)
    U.index_compact(spark, root)
    index = U.index_load(spark, root)
    return X.ivf_search(_vector_queries(spark, d), index, 5, nprobe=len(index.centres), skip_self=True)


def _lsh(spark: SparkSession, d: str) -> DataFrame:
    return X.lsh_search(_vector_queries(spark, d), _corpus(spark, d), 5, _DIM, bucket_length=0.1, skip_self=True)


def _recall(spark: SparkSession, d: str) -> DataFrame:
    return X.recall_at_k(_ivf(spark, d), _knn("cosine")(spark, d))


def bag_of_words(texts: list[str]) -> np.ndarray:
    """A small stand-in model for ``embed``: counts of hashed words, 32 wide."""
    out = np.zeros((len(texts), 32), dtype=np.float32)
    for i, text in enumerate(texts):
        for word in re.findall(r"[a-z]+", text):
            out[i, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 32] += 1
    return out


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    made = X.embed(_entries(spark, d), bag_of_words, dim=32)
    return made.select("entry_id", "dim", F.aggregate(
        "embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double")).alias("words"))


def _load_bag():
    return bag_of_words


def _embedded_model(spark: SparkSession, d: str) -> DataFrame:
    made = X.embed_model(_entries(spark, d), _load_bag, dim=32)
    return made.select("entry_id", "dim", F.aggregate(
        "embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double")).alias("words"))


def _described(spark: SparkSession, d: str) -> DataFrame:
    return E.parse_metadata(view(spark, d, "described_entries"))


def _checked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with faults put in: null, narrow, not a number, all zero."""
    v, key = F.col("embedding"), F.col("vec_id")
    nan = F.concat(F.slice(v, 1, _DIM - 1), F.array(F.lit(float("nan")).cast("float")))
    faulty = (F.when(key % 11 == 1, F.lit(None)).when(key % 11 == 2, F.slice(v, 1, _DIM - 1))
              .when(key % 11 == 3, nan)
              .when(key % 11 == 4, F.transform(v, lambda x: F.lit(0.0).cast("float"))).otherwise(v))
    df = table(spark, d, "embeddings").select("vec_id", faulty.alias("embedding"))
    return X.check_vectors(df, "embedding", _DIM).select("vec_id", "problem")


def _ingested(spark: SparkSession, d: str) -> E.Ingested:
    return E.ingest_entries(view(spark, d, "raw_entries"))


def _changed(spark: SparkSession, d: str) -> DataFrame:
    base = view(spark, d, "entries").select("id", "body", "category")
    changed = E.apply_entry_changes(base, view(spark, d, "entry_changes"))
    return changed.select("id", "category", F.md5("body").alias("body"))


def _read(spark: SparkSession, d: str) -> DataFrame:
    return E.get_entries(view(spark, d, "entries"), view(spark, d, "wanted")).select("id", "category", "n_chars")


def _filter(spark: SparkSession, d: str) -> DataFrame:
    return E.filter_entries(view(spark, d, "entries"), "src1", ["de", "es", "fr"], ["unrated"]).select("id")


def _bitmaps(spark: SparkSession, d: str) -> DataFrame:
    root = work_dir(spark, "bitmaps")
    write_snapshot(B.bitmap_build(view(spark, d, "entries")), root, "tags", sort_by=["facet", "value", "bucket"])
    return read_snapshot(spark, root, "tags")


def _bitmap_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter of ``filter_entries``, from stored bitmaps."""
    return B.bitmap_ids(B.bitmap_filter(_bitmaps(spark, d), "src1", ["de", "es", "fr"], ["unrated"]))


def _bitmap_facets(spark: SparkSession, d: str) -> DataFrame:
    """Categories and tags of the entries that have one of two languages and no rating."""
    index = _bitmaps(spark, d)
    return B.bitmap_facets(index, B.bitmap_filter(index, None, ["de", "fr"], ["unrated"]))


def _bridge_back(spark: SparkSession, d: str) -> DataFrame:
    tags = E.bridge_to_tags(E.tags_to_bridge(view(spark, d, "entries")))
    return tags.select("entry_id", F.concat_ws(",", "tags").alias("tags"))


def _stale(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).select("id", E.content_hash(F.col("body")).alias("content_hash"))
    return E.stale_entries(entries, view(spark, d, "embedded"))


QUERIES = {
    "ingest_entries": lambda s, d: _ingested(s, d).entries.select(
        "id", "category", F.concat_ws(",", "tags").alias("tags"), "content_hash"),
    "ingest_rejects": lambda s, d: _ingested(s, d).rejects,
    "apply_entry_changes": _changed,
    "get_entries": _read,
    "filter_entries": _filter,
    "bitmap_filter": _bitmap_filter,
    "bitmap_facets": _bitmap_facets,
    "filter_metadata": lambda s, d: E.filter_metadata(
        _described(s, d), {"lang": "de", "thousands": "0"}, ["source"], ["reviewed"]).select("id"),
    "metadata_facets": lambda s, d: E.metadata_facets(_described(s, d)),
    "facet_counts": lambda s, d: E.facet_counts(view(s, d, "entries")),
    "tags_to_bridge": lambda s, d: E.tags_to_bridge(view(s, d, "entries")),
    "bridge_to_tags": _bridge_back,
    "extract_code": lambda s, d: E.extract_code(spread_small(view(s, d, "markdown"))),
    "extract_links": lambda s, d: E.extract_links(spread_table(s, d, "pages"), "page_id", "html"),
    "extract_markdown_links": lambda s, d: E.extract_links(
        spread_small(view(s, d, "markdown")), "id", "body", "markdown"),
    "embed": _embedded,
    "embed_model": _embedded_model,
    "hash_embed": lambda s, d: X.hash_embed(_entries(s, d)),
    "stale_entries": _stale,
    "check_vectors": _checked_vectors,
    "knn_cosine": _knn("cosine"),
    "knn_l2": _knn("l2"),
    "knn_inner": _knn("inner"),
    "knn_filtered": _filtered,
    "knn_floor": _knn("cosine", 0.3),
    "text_search": _search,
    "postings_search": _postings_hits,
    "search_with_resources": _hits_with_resources,
    "ivf_search": _ivf,
    "ivf_search_all_cells": _ivf_full,
    "ivf_filtered": _ivf_filtered,
    "ivf_filtered_where": _ivf_where,
    "pq_search": _pq,
    "ivf_upkeep": _upkept,
    "lsh_search": _lsh,
    "recall_at_k": _recall,
    "search_log": _replay,
}


def _knn_sql(score: str, order: str = "desc", where: str = "true", views: str = "entries") -> str:
    return with_views(views, f"""--more
scored as (select a.vec_id as q_id, b.vec_id as id, round({score}, 6) + 0.0 as score
  from embeddings a join embeddings b on a.vec_id <> b.vec_id)
select q_id, (row_number() over (partition by q_id order by score {order}, id))::int as rnk, id, score
from scored where {where} qualify rnk <= 5""")


def _weights(source: str, key: str, text: str) -> str:
    return f"""select key, bucket, sum(sign)::bigint as weight from (
  select key, (('0x' || substr(h, 1, 8))::bigint % 1536)::int as bucket,
    case when substr(h, 9, 1) < '8' then 1 else -1 end as sign from (
    select {key} as key, md5(unnest(regexp_extract_all(lower({text}), '\\p{{L}}+'))) as h from {source}))
  group by key, bucket having sum(sign) <> 0"""


def search_ctes(source: str, key: str) -> str:
    return f"""
d as ({_weights('documents', 'doc_id', 'text')}),
q as ({_weights(source, key, 'text')}),
dn as (select key, sqrt(sum(weight * weight)) as norm from d group by key),
qn as (select key, sqrt(sum(weight * weight)) as norm from q group by key),
scored as (select p.q, p.id, round(p.dot / (dn.norm * qn.norm), 6) + 0.0 as score from (
    select q.key as q, d.key as id, sum(q.weight * d.weight)::double as dot from q join d using (bucket)
    group by q.key, d.key) p join dn on dn.key = p.id join qn on qn.key = p.q),
hits as (select q, (row_number() over (partition by q order by score desc, id))::int as rnk, id, score from scored)
"""


_COSINE = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
_FENCED = r"'(?ms)^```([^\n`]*)\n(.*?)(?:^```[ \t]*$|\z)'"
_MD_LINK = r"'(?:^|[^!])\[[^\]\n]*\]\(([^()\s]+)\)'"
_HREF = r"""'(?i)<a\s(?:[^>]*\s)?href\s*=\s*["'']([^"'']*)["'']'"""
_CODE = f"""select id as entry_id, (i - 1)::int as pos, 'code' as kind, nullif(trim(langs[i]), '') as lang,
    bodies[i] as content from (
  select id, unnest(range(1, len(langs) + 1)) as i, langs, bodies from (
    select id, regexp_extract_all(body, {_FENCED}, 1) as langs, regexp_extract_all(body, {_FENCED}, 2) as bodies
    from markdown))"""
_MD_LINKS = f"""select id as entry_id, (i - 1)::int as pos, 'link' as kind, null::varchar as lang, links[i] as content from (
  select id, unnest(range(1, len(links) + 1)) as i, links from (
    select id, regexp_extract_all(body, {_MD_LINK}, 1) as links from markdown))"""
_RAW_TAGS = """array_to_string(list_sort(list_distinct(
  [lower(trim(t)) for t in tags if trim(t) <> ''])), ',')"""

_WORDS = """
select doc_id as entry_id, 32 as dim, len(regexp_extract_all(text, '[a-z]+'))::double as words from documents"""

SQL = {
    "ingest_entries": with_views("raw_entries", f"""
select id, category, {_RAW_TAGS} as tags, sha256(body) as content_hash from raw_entries
where not regexp_matches(body, '^\\s*$')"""),
    "ingest_rejects": with_views("raw_entries", """
select id, 'body.required' as violations from raw_entries where regexp_matches(body, '^\\s*$')"""),
    "apply_entry_changes": with_views("entries entry_changes", """
select coalesce(c.id, e.id) as id, coalesce(c.category, e.category) as category,
  md5(coalesce(c.body, e.body)) as body
from entries e full join entry_changes c on e.id = c.id where c.op is distinct from 'delete'"""),
    "get_entries": with_views("entries wanted", """
select id, category, n_chars from entries where id in (select id from wanted)"""),
    "filter_entries": with_views("entries", """
select id from entries where category = 'src1' and list_has_any(tags, ['de', 'es', 'fr'])
  and list_contains(tags, 'unrated')"""),
    "bitmap_filter": with_views("entries", """
select id from entries where category = 'src1' and list_has_any(tags, ['de', 'es', 'fr'])
  and list_contains(tags, 'unrated')"""),
    "bitmap_facets": with_views("entries", """--more
kept as (select * from entries where list_has_any(tags, ['de', 'fr']) and list_contains(tags, 'unrated'))
select 'category' as facet, category as value, count(*) as entries from kept group by category
union all select 'tag', tag, count(*) from (select unnest(list_distinct(tags)) as tag from kept) group by tag"""),
    "filter_metadata": with_views("described_entries", """--more
typed as (select id, case when json_valid(metadata) then metadata::json end as m from described_entries)
select id from typed where m->>'$.lang' = 'de' and m->>'$.thousands' = '0' and list_contains(json_keys(m), 'source')
  and not list_contains(json_keys(m), 'reviewed')"""),
    "metadata_facets": with_views("described_entries", """--more
typed as (select id, case when json_valid(metadata) then metadata::json end as m from described_entries)
select key, m->>('$.' || key) as value, count(*) as entries from (select m, unnest(json_keys(m)) as key from typed)
group by all"""),
    "facet_counts": with_views("entries", """
select 'category' as facet, category as value, count(*) as entries from entries group by category
union all select 'tag', tag, count(*) from (select unnest(list_distinct(tags)) as tag from entries) group by tag"""),
    "tags_to_bridge": with_views("entries", "select id as entry_id, unnest(list_distinct(tags)) as tag from entries"),
    "bridge_to_tags": with_views("entries", """
select id as entry_id, array_to_string(list_sort(list_distinct(tags)), ',') as tags from entries"""),
    "extract_code": with_views("markdown", _CODE),
    "extract_links": f"""
select page_id as entry_id, (i - 1)::int as pos, 'link' as kind, null::varchar as lang, links[i] as content from (
  select page_id, unnest(range(1, len(links) + 1)) as i, links from (
    select page_id, regexp_extract_all(html, {_HREF}, 1) as links from pages))""",
    "extract_markdown_links": with_views("markdown", _MD_LINKS),
    "embed": _WORDS,
    "embed_model": _WORDS,
    "hash_embed": f"select key as id, bucket, weight from ({_weights('documents', 'doc_id', 'text')})",
    "stale_entries": with_views("embedded", """
select doc_id as id, sha256(text) as content_hash from documents d where not exists (
  select 1 from embedded e where e.entry_id = d.doc_id and e.content_hash = sha256(d.text))"""),
    "check_vectors": """
select vec_id, case vec_id % 11 when 1 then 'null' when 2 then 'width' when 3 then 'element' when 4 then 'zero' end
  as problem from embeddings""",
    "knn_cosine": _knn_sql(_COSINE),
    "knn_l2": _knn_sql("list_distance(a.embedding::double[], b.embedding::double[])", "asc"),
    "knn_inner": _knn_sql("list_inner_product(a.embedding::double[], b.embedding::double[])"),
    "knn_filtered": _knn_sql(_COSINE, where="""id in (select id from entries
  where list_has_any(tags, ['de', 'fr']) and list_contains(tags, 'unrated'))"""),
    "knn_floor": _knn_sql(_COSINE, where="score >= 0.3"),
    "text_search": f"""with {search_ctes('benchmark', 'item_id')}
select q as q_id, rnk, id, score from hits where rnk <= 5""",
    "postings_search": f"""with {search_ctes('benchmark', 'item_id')}
select q as q_id, rnk, id, score from hits where rnk <= 5""",
    "search_with_resources": with_views("markdown", f"""--more {search_ctes('benchmark', 'item_id')},
res as ({_CODE} union all {_MD_LINKS})
select h.q as q_id, h.rnk, h.id, r.kind, r.pos, r.content
from hits h left join res r on r.entry_id = h.id where h.rnk <= 5"""),
    "ivf_search_all_cells": _knn_sql(_COSINE),
    "ivf_upkeep": f"""
with b as (
  select vec_id as id, embedding as v from embeddings where vec_id % 3 <> 0 and vec_id % 10 <> 0
  union all select vec_id, list_reverse(embedding) from embeddings where vec_id % 10 = 0 or (vec_id % 3 = 0 and vec_id % 2 = 1)
  union all select vec_id + 1000000, list_reverse(embedding) from embeddings where vec_id % 5 = 0 and vec_id % 2 = 1),
scored as (
  select a.vec_id as q_id, b.id, round({_COSINE.replace('b.embedding', 'b.v')}, 6) + 0.0 as score
  from embeddings a join b on a.vec_id <> b.id)
select q_id, (row_number() over (partition by q_id order by score desc, id))::int as rnk, id, score
from scored qualify rnk <= 5""",
    "pq_search": _knn_sql(_COSINE),
    "ivf_filtered": _knn_sql(_COSINE, where="""id in (select id from entries
  where list_has_any(tags, ['de', 'fr']) and list_contains(tags, 'unrated'))"""),
    "ivf_filtered_where": _knn_sql(_COSINE, where="score >= 0.2 and id in (select vec_id from embeddings where label in (1, 4, 7))"),
    "search_log": f"""with {search_ctes("(select * from conversations where role = 'user')", 'conv_id * 1048576 + turn')}
select q // 1048576 as conv_id, q % 1048576 as turn, rnk, id, score from hits where rnk <= 3""",
}
