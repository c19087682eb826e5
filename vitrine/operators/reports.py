"""Prompt evaluation and log reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_LINE = r"^\[([^\]]*)\] \[([A-Z]+)\] (.*)$"


def prompt_summary(rows: DataFrame) -> DataFrame:
    """By condition: trials, failures, empty answers, few tags (of those parsed), upper median, range, seconds."""
    ok = F.col("parse_ok")
    counts = F.sort_array(F.collect_list(F.when(ok, F.col("tag_count"))))
    by = rows.groupBy("cond").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~ok).alias("failed"),
        F.count_if(F.col("fail_reason") == "empty_response").alias("empty"),
        F.count_if(ok & (F.col("tag_count") < 3)).alias("under3"),
        F.count_if(ok).alias("parsed"),
        counts.alias("__c"),
        (F.avg("elapsed_ms") / 1000).alias("mean_sec"),
    )
    middle = F.floor(F.size("__c") / 2).cast("int")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return by.select("cond", "n", "failed", share("failed", "n").alias("failed_share"), "empty", share("empty", "n").alias("empty_share"), "under3", share("under3", "parsed").alias("under3_share"), F.get("__c", middle).alias("median_tags"), F.array_min("__c").alias("min_tags"), F.array_max("__c").alias("max_tags"), F.round("mean_sec", 4).alias("mean_sec"))


def few_tags_pivot(rows: DataFrame, conditions: list[str]) -> DataFrame:
    """group -> for each condition the share of parsed answers with under three tags."""
    ok = rows.where("parse_ok")
    return ok.groupBy("group").pivot("cond", conditions).agg(F.round(F.avg((F.col("tag_count") < 3).cast("double")), 6))


def failures(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("parse_ok")).groupBy("cond", "fail_reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cond", "fail_reason")


def raw_samples(rows: DataFrame, most: int = 3) -> DataFrame:
    return rows.where(~F.col("parse_ok") & (F.coalesce("raw_sample", F.lit("")) != "")).orderBy("cond", "image", "rep").limit(most)


def agreement(rows: DataFrame) -> DataFrame:
    """By condition: mean Jaccard similarity of the tag sets of repeats of an image, and the vocabulary.

    Repeats with equal sets are one row with their number, and rows of an image are compared, so the
    work grows with different sets and not with repeats. Repeats that fail to parse take no part; a
    condition without two repeats of an image has no mean.
    """
    ok = rows.where("parse_ok").select("cond", "image", F.array_sort(F.array_distinct("tags")).alias("tags"))
    sets = ok.groupBy("cond", "image", "tags").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.concat_ws("\x1f", "tags"))
    both = sets.alias("a").join(sets.alias("b"), ["cond", "image"]).where("a.key <= b.key AND (a.key < b.key OR a.n > 1)")
    union = F.size(F.array_union("a.tags", "b.tags"))
    score = F.when(union > 0, F.size(F.array_intersect("a.tags", "b.tags")) / union).otherwise(1.0)
    pairs = F.when(F.col("a.key") == F.col("b.key"), F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n"))
    mean = both.select("cond", score.alias("score"), pairs.alias("pairs")).groupBy("cond").agg(F.round(F.sum(F.col("score") * F.col("pairs")) / F.sum("pairs"), 6).alias("mean_jaccard"))
    words = ok.select("cond", F.explode("tags").alias("t")).groupBy("cond").agg(F.countDistinct("t").alias("vocabulary"))
    return words.join(mean, "cond", "left")


def parsed_log(lines: DataFrame) -> DataFrame:
    """(line_no, ts, level, message) of lines (line_no, value); level is null where a message goes on."""
    part = lambda i: F.nullif(F.regexp_extract("value", LOG_LINE, i), F.lit(""))
    return lines.select("line_no", part(1).alias("ts"), part(2).alias("level"), F.coalesce(part(3), "value").alias("message"), "value")


def log_filter(lines: DataFrame, search: str = "", levels: list[str] | None = None) -> DataFrame:
    out = lines.where(F.trim("value") != "")
    if search:
        out = out.where(F.lower("value").contains(search.lower()))
    if levels:
        hit = F.lit(False)
        for level in levels:
            hit = hit | F.col("value").contains(f"[{level}]")
        out = out.where(hit)
    return out


def log_tail(lines: DataFrame, most: int = 1000) -> DataFrame:
    """The last lines that aren't blank, and how many are errors."""
    last = lines.where(F.trim("value") != "").orderBy(F.desc("line_no")).limit(most)
    return last.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").contains("[ERROR]")).alias("errors"), F.min("line_no").alias("first_line"))


def tag_rollup(media: DataFrame) -> DataFrame:
    """name -> count and the attributes of its first row, from media (id, tags)."""
    each = media.select("id", F.posexplode("tags").alias("p", "t")).select("id", "p", "t.*")
    return each.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.min_by("name_ja", F.struct("id", "p")).alias("name_ja"), F.min_by("kind", F.struct("id", "p")).alias("kind"))
