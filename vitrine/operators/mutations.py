"""Changes of the catalogue as functions from tables to new tables; the caller writes them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.operators import filters
from vitrine.sources.shared import written


@dataclass(frozen=True)
class Catalog:
    media: DataFrame
    tags: DataFrame
    media_tags: DataFrame


def _next_ids(new: DataFrame, old: DataFrame, order: str) -> DataFrame:
    """new with ids after old's largest, in the order of a column.

    Rows are dealt by ranges of the column and numbered within each; the driver adds up one count for
    each range, so no task gets all rows. The ranges are written first, so that numbers stay.
    """
    ranged = new.drop("id").repartitionByRange(F.col(order)).withColumn("__range", F.spark_partition_id())
    dealt = written(ranged, "new-rows")
    base, before = old.agg(F.max("id")).first()[0] or 0, {}
    for r in sorted(dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()):
        before[r[0]] = base
        base += r[1]
    offsets = dealt.sparkSession.createDataFrame(list(before.items()), "__range int, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return dealt.withColumn("__place", place).join(F.broadcast(offsets), "__range").withColumn("id", F.col("__before") + F.col("__place")).drop("__range", "__before", "__place")


def set_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    new = settings.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return settings.select("key", "value").where(F.col("key") != key).unionByName(new)


def add_folder(folders: DataFrame, path: str, now: int) -> DataFrame:
    new = folders.sparkSession.createDataFrame([(path, now)], "path string, created_at long").join(folders, "path", "left_anti")
    return folders.select("id", "path", "created_at").unionByName(_next_ids(new, folders, "path").select("id", "path", "created_at"))


def without_orphans(cat: Catalog) -> Catalog:
    """Categories and tags in use stay."""
    used = cat.media_tags.select(F.col("tag_id").alias("id")).distinct()
    kept = cat.tags.join(used.withColumn("__used", F.lit(True)), "id", "left").where(F.col("is_category") | F.col("__used").isNotNull()).drop("__used")
    return replace(cat, tags=kept)


def upsert_categories(tags: DataFrame, names: DataFrame) -> DataFrame:
    """names (name): trimmed and lower-cased; a free tag of that name becomes a category."""
    wanted = names.select(F.lower(S.trim("name")).alias("name")).where("name <> ''").distinct()
    old = tags.join(wanted.withColumn("__hit", F.lit(True)), "name", "left").withColumn("is_category", F.col("is_category") | F.col("__hit").isNotNull()).drop("__hit")
    new = wanted.join(tags, "name", "left_anti").select("name", F.lit(None).cast("string").alias("name_ja"), F.lit(True).alias("is_category"), F.lit("basic").alias("tag_kind"))
    return _merged(old, new, tags)


def upsert_tags(tags: DataFrame, pairs: DataFrame, kind: str = "basic", labels: str = "keep") -> DataFrame:
    """pairs (en, ja), normalised; empty names go. A known tag keeps its kind.

    labels: keep (the old label unless it is null), replace (the new one unless it is null) or
    blank (the new one, blank ones too). Of several new labels the smallest counts.
    """
    given = pairs.select(S.normalize_tag("en").alias("name"), (F.col("ja") if labels == "blank" else F.when(S.trim("ja") != "", F.col("ja"))).alias("__ja"))
    new = given.where("name <> ''").groupBy("name").agg(F.min("__ja").alias("__ja"))
    label = F.coalesce("name_ja", "__ja") if labels == "keep" else F.coalesce("__ja", "name_ja")
    old = tags.join(new, "name", "left").withColumn("name_ja", label).drop("__ja")
    fresh = new.join(tags, "name", "left_anti").select("name", F.col("__ja").alias("name_ja"), F.lit(False).alias("is_category"), F.lit(kind).alias("tag_kind"))
    return _merged(old, fresh, tags)


def _merged(old: DataFrame, new: DataFrame, tags: DataFrame) -> DataFrame:
    columns = ["id", "name", "name_ja", "is_category", "tag_kind"]
    return old.select(columns).unionByName(_next_ids(new, tags, "name").select(columns))


def add_links(media_tags: DataFrame, links: DataFrame) -> DataFrame:
    return media_tags.select("media_id", "tag_id").unionByName(links.select("media_id", "tag_id")).where("media_id IS NOT NULL AND tag_id IS NOT NULL").distinct()


def get_or_create_tag(tags: DataFrame, name: str, name_ja: str | None = None) -> DataFrame:
    """The tags with one of that normalised name; a missing or blank label is filled. Empty: an error."""
    spark = tags.sparkSession
    norm = spark.range(1).select(S.normalize_tag(F.lit(name)).alias("n")).first().n
    if not norm:
        raise ValueError("a tag needs a name")
    label = name_ja.strip() if name_ja and name_ja.strip() else None
    old = tags.withColumn("name_ja", F.when((F.col("name") == norm) & (F.coalesce("name_ja", F.lit("")) == "") & F.lit(label is not None), F.lit(label)).otherwise(F.col("name_ja")))
    new = spark.createDataFrame([(norm, label, False, "basic")], "name string, name_ja string, is_category boolean, tag_kind string").join(tags, "name", "left_anti")
    return _merged(old, new, tags)


def add_tag(cat: Catalog, media_id: int, name: str, name_ja: str | None = None) -> Catalog:
    tags = get_or_create_tag(cat.tags, name, name_ja)
    link = tags.where(F.col("name") == S.normalize_tag(F.lit(name))).select(F.lit(media_id).cast("long").alias("media_id"), F.col("id").alias("tag_id"))
    return replace(cat, tags=tags, media_tags=add_links(cat.media_tags, link))


def remove_tag(cat: Catalog, media_id: int, tag_id: int) -> Catalog:
    """The link goes, and the tag too if it is free and has no other."""
    links = cat.media_tags.where(~((F.col("media_id") == media_id) & (F.col("tag_id") == tag_id)))
    left = links.where(F.col("tag_id") == tag_id).select(F.col("tag_id").alias("id")).distinct().withColumn("__used", F.lit(True))
    tags = cat.tags.join(left, "id", "left").where((F.col("id") != tag_id) | F.col("is_category") | F.col("__used").isNotNull()).drop("__used")
    return replace(cat, tags=tags, media_tags=links)


def rename_tag(tags: DataFrame, tag_id: int, name: str, name_ja: str | None) -> DataFrame:
    """Name and label as given; a name that another tag has is an error."""
    if tags.where((F.col("name") == name) & (F.col("id") != tag_id)).limit(1).count():
        raise ValueError(f"there is a tag {name!r} already")
    hit = F.col("id") == tag_id
    return tags.withColumn("name", F.when(hit, F.lit(name)).otherwise(F.col("name"))).withColumn("name_ja", F.when(hit, F.lit(name_ja)).otherwise(F.col("name_ja")))


def merge_tags(cat: Catalog, mapping: DataFrame) -> Catalog:
    """mapping (source, target): links move to targets once, sources go, then all orphans do. Of
    several targets of a source the smallest counts."""
    moves = mapping.where("source <> target").groupBy("source").agg(F.min("target").alias("target"))
    links = cat.media_tags.join(moves, F.col("tag_id") == F.col("source"), "left").select("media_id", F.coalesce("target", "tag_id").alias("tag_id")).distinct()
    tags = cat.tags.join(moves.select(F.col("source").alias("id")), "id", "left_anti")
    return without_orphans(replace(cat, tags=tags, media_tags=links))


def suggestion_mapping(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """(source, target) from accepted suggestions (id, members) and decisions (id, accepted, rejected,
    master, excluded). A suggestion without sources left is skipped."""
    both = suggestions.join(decisions, "id").where("accepted AND NOT rejected")
    master = F.coalesce("master", F.get("members", F.lit(0)))
    sources = F.array_except(F.array_except("members", F.coalesce("excluded", F.array().cast("array<bigint>"))), F.array(master))
    return both.select(F.explode(sources).alias("source"), master.alias("target"))


def reset_media(media: DataFrame, ids: DataFrame | None = None, condition: Column | None = None, now: int | None = None) -> DataFrame:
    """Pending again, error cleared: rows with an id in ids, or that meet a condition."""
    if ids is not None:
        media = media.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
        condition = F.col("__hit").isNotNull()
    out = media.withColumn("analysis_error", F.when(condition, None).otherwise(F.col("analysis_error"))).withColumn("analysis_status", F.when(condition, "pending").otherwise(F.col("analysis_status")))
    return out.drop("__hit")


def reset_failed(media: DataFrame) -> DataFrame:
    return reset_media(media, condition=F.col("analysis_status") == "failed")


def reset_all(cat: Catalog) -> Catalog:
    return replace(cat, media=reset_media(cat.media, condition=F.lit(True)), media_tags=cat.media_tags.limit(0))


def reset_folder(cat: Catalog, folder: str) -> Catalog:
    hit = filters.queued_under([folder])
    ids = cat.media.where(hit).select(F.col("id").alias("media_id"))
    return replace(cat, media=reset_media(cat.media, condition=hit), media_tags=cat.media_tags.join(ids, "media_id", "left_anti"))


def remove_folder(cat: Catalog, folder: str) -> Catalog:
    """Media below the folder go with their links; tags stay, orphans too."""
    gone = cat.media.where(filters.inside(folder)).select("id")
    return replace(cat, media=cat.media.join(gone, "id", "left_anti"), media_tags=cat.media_tags.join(gone.withColumnRenamed("id", "media_id"), "media_id", "left_anti"))


def replaced_links(media_tags: DataFrame, links: DataFrame, done: DataFrame) -> DataFrame:
    """Re-analysis: the old links of the media in done (media_id) go, the new ones come."""
    return add_links(media_tags.join(done.select("media_id"), "media_id", "left_anti"), links)


def mark_results(media: DataFrame, results: DataFrame) -> DataFrame:
    """results (media_id, error): failed with its text, or completed where error is null."""
    both = media.join(results.select(F.col("media_id").alias("id"), F.col("error").alias("__e"), F.lit(True).alias("__hit")), "id", "left")
    hit = F.col("__hit").isNotNull()
    out = both.withColumn("analysis_status", F.when(hit, F.when(F.col("__e").isNull(), "completed").otherwise("failed")).otherwise(F.col("analysis_status")))
    return out.withColumn("analysis_error", F.when(hit, F.col("__e")).otherwise(F.col("analysis_error"))).drop("__e", "__hit")
