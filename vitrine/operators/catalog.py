"""Reads of the catalogue: the media query, tag counts, folders, suggestions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.operators import filters
from vitrine.schema import CATEGORIES

@dataclass
class MediaQuery:
    categories: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    tree: str | None = None
    parent_folder: str | None = None
    scan_folder: str | None = None
    status: str | None = None
    media_type: str | None = None
    extensions: list[str] = field(default_factory=list)

    def facets(self) -> list[Column]:
        """Conditions on media columns alone; they reach the scan."""
        out = []
        if self.parent_folder:
            out.append(filters.parent_is(self.parent_folder))
        if self.scan_folder:
            out.append(filters.under_folder(self.scan_folder))
        if self.status and self.status != "unanalyzed":
            out.append(filters.status_is(self.status))
        if self.media_type:
            out.append(filters.media_type_is(self.media_type))
        if self.extensions:
            out.append(filters.has_extension(self.extensions))
        return out


def nested_tags(tags: DataFrame, media_tags: DataFrame) -> DataFrame:
    """(media_id, categories, tags), in the order of tag ids. One shuffle, by media."""
    link = media_tags.join(tags, media_tags["tag_id"] == tags["id"])
    entry = F.struct("tag_id", "name", "name_ja", F.coalesce("tag_kind", F.lit("basic")).alias("kind"))
    both = link.groupBy("media_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_category"), entry))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("is_category"), entry))).alias("t"),
    )
    return both.select("media_id", F.transform("c", lambda x: x["name"]).alias("categories"), F.transform("t", lambda x: F.struct(x["name"].alias("name"), x["name_ja"].alias("name_ja"), x["kind"].alias("kind"))).alias("tags"))


def media_items(media: DataFrame, tags: DataFrame, media_tags: DataFrame) -> DataFrame:
    nested = nested_tags(tags, media_tags).withColumnRenamed("media_id", "__m")
    out = media.join(nested, F.col("id") == F.col("__m"), "left").drop("__m")
    none = F.array().cast("array<struct<name:string,name_ja:string,kind:string>>")
    return out.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))).withColumn("tags", F.coalesce("tags", none))


def get_media(media: DataFrame, tags: DataFrame, media_tags: DataFrame, query: MediaQuery) -> DataFrame:
    """Media with their categories and tags that pass all facets, newest first."""
    for condition in query.facets():
        media = media.where(condition)
    items = media_items(media, tags, media_tags)
    if query.categories:
        items = items.where(filters.in_categories(query.categories))
    if query.tree is not None or query.tags:
        items = items.where(filters.tag_filter(query.tree, query.tags))
    if query.status == "unanalyzed":
        items = items.where(filters.unanalyzed())
    return items.select("id", "file_path", "parent_folder", "thumbnail_path", "file_size", "analysis_status", "analysis_error", "categories", "tags").orderBy(F.desc("id"))


def tag_counts(tags: DataFrame, media_tags: DataFrame) -> DataFrame:
    """All tags with the number of their links, unused ones with 0; links are counted before the join."""
    n = media_tags.where(F.col("media_id").isNotNull()).groupBy(F.col("tag_id").alias("__t")).agg(F.count(F.lit(1)).alias("count"))
    out = tags.join(n, F.col("id") == F.col("__t"), "left")
    return out.select("id", "name", "name_ja", "is_category", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce("tag_kind", F.lit("basic")).alias("kind"))


def in_list_order(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("is_category"), F.desc("count"), F.coalesce("name_ja", "name"), "id")


def tag_by_name(tags: DataFrame, media_tags: DataFrame, name: str) -> DataFrame:
    return tag_counts(tags.where(F.col("name") == name), media_tags)


def media_by_tag(media: DataFrame, media_tags: DataFrame, tag_id: int) -> DataFrame:
    return media.join(media_tags.where(F.col("tag_id") == tag_id).select(F.col("media_id").alias("id")), "id", "left_semi")


def parent_folders(media: DataFrame) -> DataFrame:
    return media.where(F.col("parent_folder") != "").select("parent_folder").distinct().orderBy("parent_folder")


def scan_folders(folders: DataFrame) -> DataFrame:
    return folders.orderBy(F.desc("id"))


def orphan_tags(tags: DataFrame, media_tags: DataFrame) -> DataFrame:
    """Free tags without a link."""
    used = media_tags.where(F.col("tag_id").isNotNull()).select(F.col("tag_id").alias("id"))
    return tags.where(~F.col("is_category")).join(used, "id", "left_anti")


def media_in_group(media_tags: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, media): exact numbers of different media of each group (group_id, tag_id)."""
    return groups.join(media_tags, "tag_id").groupBy("group_id").agg(F.countDistinct("media_id").alias("media"))


def suggested_tags(counts: DataFrame, text: str, limit: int | None = None, kinds_first: bool = True, exclude: list[str] | None = None) -> DataFrame:
    """Free tags that hold the text, in list order. The limit comes before basic goes ahead of descriptive."""
    q = text.strip().lower()
    held = F.lower("name").contains(q) | F.coalesce(F.lower("name_ja").contains(q), F.lit(False))
    found = counts.where(~F.col("is_category") & held)
    if exclude:
        found = found.where(~F.col("name").isin(exclude))
    key = [F.desc("count"), F.coalesce("name_ja", "name"), F.col("id")]
    found = found.orderBy(*key).limit(limit) if limit else found
    return found.orderBy(F.col("kind") == "descriptive", *key) if kinds_first else found.orderBy(*key)


def sorted_tags(counts: DataFrame, mode: str) -> DataFrame:
    """The tag list's orders: count_desc, count_asc, alpha, ja. The last two go by collation."""
    keys = {
        "count_desc": [F.desc("count"), F.col("id")],
        "count_asc": [F.col("count"), F.col("id")],
        "alpha": [F.collate("name", "UNICODE"), F.col("id")],
        "ja": [F.collate(F.coalesce("name_ja", "name"), "ja"), F.col("id")],
    }
    return counts.orderBy(*keys[mode])


def category_facet(tags: DataFrame) -> DataFrame:
    """Names of the categories, or the default ones when there are none."""
    own = tags.where("is_category").select("name")
    spare = tags.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "name string")
    none = own.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return own.union(spare.join(none.where("n = 0"), how="left_semi"))


def card_preview(items: DataFrame, most: int = 3) -> DataFrame:
    return items.select("id", F.transform(F.slice("tags", 1, most), lambda t: t["name"]).alias("preview"), F.greatest(F.size("tags") - most, F.lit(0)).alias("more"))


def failed(items: DataFrame) -> DataFrame:
    return items.where(F.col("analysis_status") == "failed").select("id")


def resolved_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """names (name) -> (name, tag_id): the first free tag in list order that a name means.

    A name means a tag if the part before '(', or all of it, is the tag's name, or all of it is its
    label; a leading # goes. Three equi-joins, the best rank kept.
    """
    order = Window.orderBy(F.desc("count"), F.coalesce("name_ja", "name"), "id")
    free = counts.where(~F.col("is_category")).withColumn("rank", F.row_number().over(order)).select(F.col("id").alias("tag_id"), F.col("name").alias("t"), F.col("name_ja").alias("ja"), "rank")
    clean = F.regexp_replace(S.trim("name"), "^#+", "")
    given = names.select("name", clean.alias("whole"), S.trim(F.get(F.split(clean, r"\("), F.lit(0))).alias("part")).distinct()
    hits = given.join(free, F.col("part") == F.col("t")).unionByName(given.join(free, F.col("whole") == F.col("t"))).unionByName(given.join(free, F.col("whole") == F.col("ja")))
    return hits.groupBy("name").agg(F.min_by("tag_id", "rank").alias("tag_id"))


def shown_tag(counts: DataFrame, shown: str) -> DataFrame:
    """The first tag in list order whose name or label is what a card shows; no row if none is."""
    return in_list_order(counts.where((F.col("name") == shown) | (F.col("name_ja") == shown))).limit(1)


def localized(keys: DataFrame, strings: DataFrame, language: str, fallback: str = "ja") -> DataFrame:
    """(key, text) for keys (key, default): this language's string, else the fallback's, the default, the key."""
    own = strings.where(F.col("lang") == language).select("key", F.col("text").alias("own"))
    other = strings.where(F.col("lang") == fallback).select("key", F.col("text").alias("other"))
    out = keys.join(own, "key", "left").join(other, "key", "left")
    return out.select("key", F.coalesce("own", "other", "default", "key").alias("text"))
