"""A catalogue derived by rule from the driver's tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.operators.mutations import Catalog
from vitrine.schema import CATEGORIES

EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "gif", "mp4", "mkv", "mov", "avi", "webm", "JPG"]
ERROR = "Analysis failed: 503 Service Unavailable"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = F.col("doc_id")
    both = docs.join(labels, "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "completed").otherwise("failed")
    return both.select(
        d.alias("id"),
        F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/doc_"), d, F.lit("."), _pick(EXTENSIONS, d % 12)).alias("file_path"),
        F.col("lang").alias("parent_folder"),
        F.when(d % 10 == 0, "").otherwise(F.concat(F.lit("/thumbs/"), F.sha2(d.cast("string").cast("binary"), 256), F.lit(".jpg"))).alias("thumbnail_path"),
        F.col("n_chars").alias("file_size"),
        F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"),
        (1700000000 + d * 60).alias("file_modified_at"),
        status.alias("analysis_status"),
        F.when(F.col("quality") == 0, ERROR).alias("analysis_error"),
        F.lit(1700000000).cast("long").alias("created_at"),
        F.lit(1700000000).cast("long").alias("updated_at"),
    )


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, words): the distinct words of ten letters or more of each document that has any."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 10))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), words.alias("words")).where(F.size("words") > 0)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories, every word, plurals of words that five documents hold, and every kind of part."""
    counts = _tokens(spark, sf_dir).select(F.explode("words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    row = lambda block, name: F.struct(F.lit(block).alias("block"), (-F.col("n")).alias("less"), name.alias("name"))
    named = counts.select("n", F.explode(F.array(row(0, F.col("token")), row(1, F.concat("token", F.lit("s"))))).alias("x")).where("x.block = 0 OR n >= 5")
    named = named.groupBy("x.name").agg(F.min(F.struct("x.block", "x.less")).alias("at")).select("name", "at.block", "at.less")
    part = F.regexp_replace(F.concat_ws("_", F.lower("p_type"), "p_name"), " ", "_")
    described = table(spark, sf_dir, "part").select(part.alias("name"), F.lit(2).alias("block"), F.lit(0).cast("long").alias("less")).distinct()
    k = F.row_number().over(Window.orderBy("block", "less", "name"))
    free = named.unionByName(described).withColumn("k", k.cast("long"))
    block, rest = F.floor(F.col("k") / 11), F.col("k") % 11
    label = F.when((F.col("block") == 0) & (rest <= 1), F.concat(F.substring(F.sha2(block.cast("string").cast("binary"), 256), 1, 6), F.when(block % 2 == 1, rest.cast("string")).otherwise("")))
    kind = F.when(F.col("block") == 2, "descriptive").otherwise("basic")
    free = free.select((12 + F.col("k")).alias("id"), "name", label.alias("name_ja"), F.lit(False).alias("is_category"), kind.alias("tag_kind"))
    fixed = spark.createDataFrame([(i, n, ja) for i, (n, ja) in enumerate(CATEGORIES.items(), 1)], "id long, name string, name_ja string")
    return fixed.select("id", "name", "name_ja", F.lit(True).alias("is_category"), F.lit("basic").alias("tag_kind")).unionByName(free)


def media_tags(spark: SparkSession, sf_dir: str, all_tags: DataFrame, all_media: DataFrame) -> DataFrame:
    """Each medium has its words, every third also their plurals where they are tags, a category when
    completed, and kinds of parts by remainder."""
    free = all_tags.where("NOT is_category AND tag_kind = 'basic'").select(F.col("id").alias("tag_id"), "name")
    plurals = F.when(F.col("media_id") % 3 == 0, F.transform("words", lambda w: F.concat(w, F.lit("s")))).otherwise(F.array().cast("array<string>"))
    names = _tokens(spark, sf_dir).select("media_id", F.explode(F.array_distinct(F.concat("words", plurals))).alias("name"))
    words = names.join(free, "name").select("media_id", "tag_id")
    cats = all_media.where("analysis_status = 'completed'").select(F.col("id").alias("media_id"), (1 + F.col("id") % 12).alias("tag_id"))
    rest = all_tags.where("tag_kind = 'descriptive' AND id % 5 <> 0").select(F.col("id").alias("tag_id"), (F.col("id") % 29).alias("r"))
    other = all_media.select(F.col("id").alias("media_id"), (F.col("id") % 29).alias("r")).join(rest, "r").select("media_id", "tag_id")
    return words.unionByName(cats).unionByName(other)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    m, t = media(spark, sf_dir), tags(spark, sf_dir)
    return Catalog(m, t, media_tags(spark, sf_dir, t, m))


def listing(all_media: DataFrame) -> DataFrame:
    """Files on disk: some of the media are missing, some moved, some touched."""
    i = F.col("id")
    path = F.when(i % 17 == 1, F.concat(F.lit("/lib/moved/doc_"), i, F.lit("."), _pick(EXTENSIONS, i % 12))).otherwise(F.col("file_path"))
    mtime = F.col("file_modified_at") + F.when(i % 19 == 0, 1).otherwise(0)
    return all_media.where("id % 17 <> 0").select(path.alias("file_path"), F.when(i % 17 == 1, "moved").otherwise(F.col("parent_folder")).alias("parent_folder"), "file_size", "file_hash", mtime.alias("file_modified_at"), F.concat(F.lit("/thumbs/new_"), i, F.lit(".jpg")).alias("thumbnail_path"))


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("series_key"), "ts", "event_id", F.lit(1000).cast("long").alias("total"), F.floor("value").alias("current"))


def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    tags = F.transform(F.sequence(F.lit(0), i % 6), lambda k: F.concat(F.lit("t"), ((i * 7 + k * k) % 11).cast("string")))
    return e.select(
        F.col("event_type").alias("cond"),
        (F.col("user_id") % 3).cast("string").alias("group"),
        (i % 40).cast("string").alias("image"),
        i.alias("rep"),
        F.floor(F.col("value") * 100).alias("elapsed_ms"),
        (i % 6).alias("tag_count"),
        (i % 7 != 0).alias("parse_ok"),
        F.when(i % 7 == 0, F.when(i % 2 == 0, "empty_response").otherwise("parse_error")).alias("fail_reason"),
        F.slice(tags, F.lit(1), (i % 6).cast("int")).alias("tags"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_id") % 13 == 0, "ERROR").when(F.col("event_id") % 7 == 0, "DEBUG").otherwise("INFO")
    line = F.concat(F.lit("[2024-01-01 00:00:00] ["), level, F.lit("] "), "event_type", F.lit(" by "), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 50 == 0, " ").otherwise(line).alias("value"))


#: Model answers, valid and not, by id % 12; {} stands for a token.
RESPONSES = [
    '{"categories":["animal"],"tags":[{"en":"{}","ja":"x"}]}',
    'Here it is: {"categories":["Food "],"tags":[{"en":"{}s","ja":""},{"en":"Red Car","ja":"y"}]} done',
    '```json\\n{"categories":[],"tags":[{"en":"{}","ja":"z"}],"descriptive_tags":[{"en":"wet-{}","ja":"w"}]}\\n```',
    '```\\n{"categories":["tech"],"tags":[]}\\n```',
    "   ",
    '{"categories":["a"],"tags":["{}"]}',
    '{"categories":["a"],"tags":[{"en":"{}"}]}',
    '{"categories":["a",1],"tags":[]}',
    '{"tags":[]}',
    '{"categories":["a"],"tags":[],"descriptive_tags":null}',
    '{"categories":["a"],"tags":[{"en":"{}"',
    '{"categories":["other"],"tags":[{"en":"{}","ja":"q","score":1}],"note":"extra"}',
]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, response) for pending media."""
    docs = table(spark, sf_dir, "documents")
    forms = [r.replace("\\n", "\n") for r in RESPONSES]
    token = F.concat(F.lit("token"), (F.col("doc_id") % 50).cast("string"))
    return docs.select(F.col("doc_id").alias("media_id"), F.replace(_pick(forms, F.col("doc_id") % 12), F.lit("{}"), token).alias("response"))
