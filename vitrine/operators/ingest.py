"""Scans of folders against the catalogue: upserts, duplicates, moves, clean-up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators import filters
from vitrine.operators.mutations import Catalog, _next_ids, add_links, mark_results, replaced_links, without_orphans
from vitrine.sources.shared import written


def transitions(media: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_path, action) for each listed file: insert, keep, thumb, skip or update.

    listing: file_path, parent_folder, file_size, file_hash, file_modified_at, thumbnail_path, and
    has_thumb, whether the catalogue's thumbnail still exists (true if the listing does not say).
    """
    new = listing.dropDuplicates(["file_path"])
    old = media.select("file_path", F.col("id").alias("o_id"), F.col("analysis_status").alias("o_status"), F.col("file_modified_at").alias("o_mtime"), F.col("thumbnail_path").alias("o_thumb"))
    both = new.join(old, "file_path", "left")
    there = (F.coalesce("o_thumb", F.lit("")) != "") & (F.col("has_thumb") if "has_thumb" in listing.columns else F.lit(True))
    same = F.col("file_modified_at") == F.col("o_mtime")
    done = F.lower("o_status") == "completed"
    action = (
        F.when(F.col("o_id").isNull(), "insert")
        .when(done & same & ~there & (F.coalesce("thumbnail_path", F.lit("")) != ""), "thumb")
        .when(done & same, "keep")
        .when((F.lower("o_status") == "pending") & same & there, "skip")
        .otherwise("update")
    )
    return both.withColumn("action", action)


def scanned(media: DataFrame, listing: DataFrame, now: int) -> DataFrame:
    """The media table after a scan; the error text of a failed row stays until it is analysed again."""
    t = transitions(media, listing)
    facts = ["parent_folder", "file_size", "file_hash", "file_modified_at", "thumbnail_path"]
    changes = t.where(F.col("action").isin("thumb", "update")).select("file_path", "action", *[F.col(c).alias(f"n_{c}") for c in facts])
    both = media.join(changes, "file_path", "left")
    update = F.coalesce(F.col("action") == "update", F.lit(False))
    kept = ["file_size", "file_hash", "file_modified_at"]
    old = both
    for c in kept:
        old = old.withColumn(c, F.when(update, F.col(f"n_{c}")).otherwise(F.col(c)))
    old = old.withColumn("thumbnail_path", F.when(F.col("action").isNotNull(), F.col("n_thumbnail_path")).otherwise(F.col("thumbnail_path")))
    old = old.withColumn("analysis_status", F.when(update, "pending").otherwise(F.col("analysis_status")))
    old = old.withColumn("updated_at", F.when(F.col("action").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("updated_at"))).select(media.columns)
    fresh = t.where("action = 'insert'").select("file_path", *facts, F.lit("pending").alias("analysis_status"), F.lit(None).cast("string").alias("analysis_error"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"))
    return old.unionByName(_next_ids(fresh, media, "file_path").select(media.columns))


def pending(media: DataFrame, folders: list[str]) -> DataFrame:
    return media.where((F.col("analysis_status") == "pending") & filters.queued_under(folders))


def donors(media: DataFrame) -> DataFrame:
    """(id, donor_id) for pending media whose size and hash a completed one has; the smallest id gives.

    Grouped before the join, so a group of copies is one row on the donors' side.
    """
    hashed = media.where(F.coalesce("file_hash", F.lit("")) != "")
    done = hashed.where(F.lower("analysis_status") == "completed").groupBy("file_size", "file_hash").agg(F.min("id").alias("donor_id"))
    return hashed.where(F.lower("analysis_status") == "pending").join(done, ["file_size", "file_hash"]).where("id <> donor_id").select("id", "donor_id")


def leaders(media: DataFrame) -> DataFrame:
    """(id, leader_id) for pending media without a donor: the first of each group is analysed for the rest."""
    left = media.where(F.lower("analysis_status") == "pending").join(donors(media).select("id"), "id", "left_anti")
    alone = F.coalesce("file_hash", F.lit("")) == ""
    hashed = left.where(~alone)
    first = hashed.groupBy("file_size", "file_hash").agg(F.min("id").alias("leader_id"))
    return hashed.join(first, ["file_size", "file_hash"]).select("id", "leader_id").union(left.where(alone).select("id", F.col("id").alias("leader_id")))


def copied(cat: Catalog, pairs: DataFrame | None = None) -> Catalog:
    """Pending duplicates get their donor's links and are completed."""
    pairs = donors(cat.media) if pairs is None else pairs
    links = pairs.join(cat.media_tags, F.col("donor_id") == F.col("media_id")).select(F.col("id").alias("media_id"), "tag_id")
    media = cat.media.join(pairs.select("id", F.lit(True).alias("__hit")), "id", "left").withColumn("analysis_status", F.when(F.col("__hit").isNotNull(), "completed").otherwise(F.col("analysis_status"))).drop("__hit")
    return replace(cat, media=media, media_tags=add_links(cat.media_tags, links))


def analysed(cat: Catalog, analyse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Catalog:
    """The catalogue when nothing is pending any more.

    analyse(media) gives results (media_id, error) and links (media_id, tag_id). Each round asks it once
    for the leaders of all groups of copies. Copies of one that succeeded get its links; where a leader
    failed, the next pending copy leads in the next round. No answer for a row is a failure.
    """
    cat = copied(cat)
    while True:
        cat = replace(cat, media=written(cat.media, "media"), media_tags=written(cat.media_tags, "links"))
        lead = written(cat.media.join(leaders(cat.media).where("id = leader_id").select("id"), "id", "left_semi"), "leaders")
        if not lead.limit(1).count():
            return cat
        results, links = analyse(lead)
        answers = results.select("media_id", "error", F.lit(True).alias("__got")).dropDuplicates(["media_id"])
        error = F.when(F.col("__got").isNull(), "no answer").otherwise(F.col("error"))
        results = written(lead.select(F.col("id").alias("media_id")).join(answers, "media_id", "left").select("media_id", error.alias("error")), "results")
        good = results.where("error IS NULL").select("media_id")
        links = links.join(good, "media_id", "left_semi").select("media_id", "tag_id").distinct()
        cat = copied(replace(cat, media=mark_results(cat.media, results), media_tags=replaced_links(cat.media_tags, links, good)))


def missing(media: DataFrame, listing: DataFrame) -> DataFrame:
    return media.join(listing.select("file_path"), "file_path", "left_anti")


def unknown(media: DataFrame, listing: DataFrame) -> DataFrame:
    return listing.dropDuplicates(["file_path"]).join(media.select("file_path"), "file_path", "left_anti")


def moves(media: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, old_path, new_path, ...): missing media paired one to one with new files of equal size and hash."""
    key = ["file_size", "file_hash"]
    hashed = F.coalesce("file_hash", F.lit("")) != ""
    gone = missing(media, listing).where(hashed).select("id", F.col("file_path").alias("old_path"), *key)
    new = unknown(media, listing).where(hashed).select(F.col("file_path").alias("new_path"), F.col("parent_folder").alias("new_parent"), F.col("file_modified_at").alias("new_mtime"), *key)
    gone = gone.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    new = new.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("new_path")))
    return gone.join(new, [*key, "rn"]).select("id", "old_path", "new_path", "new_parent", "new_mtime")


def synced(cat: Catalog, listing: DataFrame, now: int) -> Catalog:
    """Moved files keep their rows and tags; what is still missing goes with its links, then orphans."""
    m = moves(cat.media, listing)
    both = cat.media.join(m.drop("old_path"), "id", "left")
    hit = F.col("new_path").isNotNull()
    media = both.withColumn("file_path", F.coalesce("new_path", "file_path")).withColumn("parent_folder", F.coalesce("new_parent", "parent_folder")).withColumn("file_modified_at", F.coalesce("new_mtime", "file_modified_at"))
    media = media.withColumn("updated_at", F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))).select(cat.media.columns)
    media = media.join(listing.select("file_path").distinct(), "file_path", "left_semi").select(cat.media.columns)
    links = cat.media_tags.join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return without_orphans(replace(cat, media=media, media_tags=links))


def cleaned(cat: Catalog, listing: DataFrame, thumbs: DataFrame | None = None) -> tuple[Catalog, DataFrame]:
    """(catalogue, gone): rows whose file is gone go with their links; a lost thumbnail's path is blanked."""
    gone = missing(cat.media, listing).select("id")
    media = cat.media.join(gone, "id", "left_anti")
    if thumbs is not None:
        media = media.join(thumbs.select("thumbnail_path", F.lit(True).alias("__there")).distinct(), "thumbnail_path", "left").withColumn("thumbnail_path", F.when(F.col("__there").isNotNull(), F.col("thumbnail_path")).otherwise("")).select(cat.media.columns)
    links = cat.media_tags.join(gone.withColumnRenamed("id", "media_id"), "media_id", "left_anti")
    out = replace(cat, media=media, media_tags=links)
    return (without_orphans(out) if gone.limit(1).count() else out), gone
