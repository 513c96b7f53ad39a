"""Knowledge entries: ingest, change, filter, list, and what is written inside them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions.text import trim_space
from .mutations import upsert
from .quality import join_violations

_FENCE = r"(?msd)^```([^\n`]*)\n(.*?)(?:^```[ \t]*$|\z)"
_HTML_LINK = r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*["']([^"']*)["']"""
_MARKDOWN_LINK = r"(?:^|[^!])\[[^\]\n]*\]\(([^()\s]+)\)"


class Ingested(NamedTuple):
    entries: DataFrame
    rejects: DataFrame


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def judge_entries(raw: DataFrame) -> DataFrame:
    """Raw entries with ``violations``."""
    blank = F.col("body").isNull() | (trim_space(F.col("body")) == "")
    rules = [F.when(F.col("id").isNull(), F.lit("id.required")),
             F.when(blank, F.lit("body.required"))]
    if "title" in raw.columns:
        rules.append(F.when(F.length("title") > S.STRING_LIMIT, F.lit("title.max")))
    if "category" in raw.columns:
        rules.append(F.when(F.length("category") > S.STRING_LIMIT, F.lit("category.max")))
    return raw.withColumn("violations", join_violations(rules))


def ingest_entries(raw: DataFrame) -> Ingested:
    """Typed entries with a content hash and clean tags, and the rejected rows with reasons.

    Only rows of the change feed are judged; uniqueness of ids is settled by
    ``apply_entry_changes`` when the rows are merged into the table.
    """
    judged = judge_entries(raw)
    tags = (F.array_sort(F.array_distinct(F.filter(
        F.transform("tags", lambda t: F.lower(trim_space(t))), lambda t: t != "")))
        if "tags" in raw.columns else F.array().cast("array<string>"))
    good = judged.where("violations = ''").drop("violations").withColumns(
        {"tags": F.coalesce(tags, F.array().cast("array<string>")), "content_hash": content_hash(F.col("body"))})
    return Ingested(good, judged.where("violations <> ''").select("id", "violations"))


def apply_entry_changes(entries: DataFrame, changes: DataFrame, seq: str = "seq",
                        op: str = "op") -> DataFrame:
    """Create, update and delete entries from a change batch; the latest change per id counts."""
    return upsert(entries, changes, ["id"], seq, op)


def get_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Read one or many entries by id."""
    return entries.join(ids.select("id"), "id", "left_semi").select(*entries.columns)


def filter_entries(entries: DataFrame, category: str | None = None, any_tags: list[str] | None = None,
                   all_tags: list[str] | None = None) -> DataFrame:
    """Entries of a category, with at least one of ``any_tags``, with each of ``all_tags``."""
    if category is not None:
        entries = entries.where(F.col("category") == category)
    if any_tags:
        entries = entries.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in any_tags])))
    for tag in all_tags or []:
        entries = entries.where(F.array_contains("tags", tag))
    return entries


def facet_counts(entries: DataFrame) -> DataFrame:
    """Entries per category and per tag: (facet, value, entries), in one pass."""
    both = F.concat(
        F.array(F.struct(F.lit("category").alias("facet"), F.col("category").alias("value"))),
        F.transform(F.array_distinct("tags"),
                    lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))))
    return (entries.select(F.explode(both).alias("_f")).select("_f.*").where("value is not null")
            .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("entries")))


def parse_metadata(raw: DataFrame, text: str = "metadata") -> DataFrame:
    """Metadata given as a JSON object becomes a map of strings; null and malformed texts become null, numbers their text."""
    return raw.withColumn(text, F.from_json(text, "map<string,string>"))


def filter_metadata(entries: DataFrame, equals: dict[str, str] | None = None, has: list[str] | None = None,
                    lacks: list[str] | None = None) -> DataFrame:
    """Entries whose metadata has each value of ``equals`` and each key of ``has``, and none of the keys of ``lacks``.

    A key with a null value is there; an entry without metadata lacks every key.
    """
    there = F.coalesce(F.map_keys("metadata"), F.array().cast("array<string>"))
    for key, value in (equals or {}).items():
        entries = entries.where(F.try_element_at("metadata", F.lit(key)) == value)
    for key in has or []:
        entries = entries.where(F.array_contains(there, key))
    for key in lacks or []:
        entries = entries.where(~F.array_contains(there, key))
    return entries


def metadata_facets(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Entries per metadata key and value (key, value, entries), of some keys or of all; null values count too."""
    pairs = F.map_entries("metadata")
    if keys is not None:
        pairs = F.filter(pairs, lambda p: p["key"].isin(keys))
    return (entries.select(F.explode(F.array_distinct(pairs)).alias("_p")).groupBy("_p.key", "_p.value")
            .agg(F.count(F.lit(1)).alias("entries")))


def tags_to_bridge(entries: DataFrame) -> DataFrame:
    """One row per entry and tag."""
    return entries.select(F.col("id").alias("entry_id"),
                          F.explode(F.array_distinct("tags")).alias("tag"))


def bridge_to_tags(bridge: DataFrame) -> DataFrame:
    """The tag list of each entry. Copies of a pair are removed before the list is built, so
    a list is no longer than the column value it becomes."""
    return (bridge.select("entry_id", "tag").distinct().groupBy("entry_id")
            .agg(F.sort_array(F.collect_list("tag")).alias("tags")))


def extract_code(entries: DataFrame, id_col: str = "id", body: str = "body") -> DataFrame:
    """Fenced code of Markdown bodies: (entry_id, pos, kind, lang, content).

    An unclosed fence reaches to the end of the text.
    """
    found = F.arrays_zip(
        F.regexp_extract_all(F.col(body), F.lit(_FENCE), F.lit(1)).alias("lang"),
        F.regexp_extract_all(F.col(body), F.lit(_FENCE), F.lit(2)).alias("content"))
    return (entries.where(F.col(body).contains("```"))
            .select(F.col(id_col).alias("entry_id"), F.posexplode(found).alias("pos", "_c"))
            .select("entry_id", "pos", F.lit("code").alias("kind"),
                    F.nullif(F.trim("_c.lang"), F.lit("")).alias("lang"),
                    F.col("_c.content").alias("content")))


def extract_links(df: DataFrame, id_col: str, text: str, markup: str = "html") -> DataFrame:
    """Link targets of HTML or Markdown: (entry_id, pos, kind, lang, content)."""
    pattern = _HTML_LINK if markup == "html" else _MARKDOWN_LINK
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    return df.select(F.col(id_col).alias("entry_id"), F.posexplode(found).alias("pos", "content")) \
        .select("entry_id", "pos", F.lit("link").alias("kind"),
                F.lit(None).cast("string").alias("lang"), "content")


def with_resources(hits: DataFrame, resources: DataFrame) -> DataFrame:
    """Search hits (q_id, rnk, id) with the code and links of each entry, one row per resource.

    Hits without resources stay, with nulls. An entry may have any number of resources: an
    inner join can be split on either side, an outer join could not.
    """
    own = resources.select(F.col("entry_id").alias("id"), "kind", "pos", "content")
    columns = ["q_id", "rnk", "id", "kind", "pos", "content"]
    found = own.join(hits.select("q_id", "rnk", "id"), "id").select(*columns)
    bare = hits.join(own.select("id").distinct(), "id", "left_anti").select("q_id", "rnk", "id")
    return found.unionByName(bare, allowMissingColumns=True)


def stale_entries(entries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Entries that are new or changed since they were embedded (embeddings: entry_id, content_hash)."""
    done = embeddings.select(F.col("entry_id").alias("id"), "content_hash")
    return entries.join(done, ["id", "content_hash"], "left_anti").select(*entries.columns)
