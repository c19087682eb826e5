"""Tables of the catalogue, their types, and the rows they start with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])
SCAN_FOLDERS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("path", T.StringType(), False), T.StructField("created_at", T.LongType())])
MEDIA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("parent_folder", T.StringType()),
        T.StructField("thumbnail_path", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("file_modified_at", T.LongType()),
        T.StructField("analysis_status", T.StringType()),
        T.StructField("analysis_error", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("updated_at", T.LongType()),
    ]
)
TAGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("name_ja", T.StringType()),
        T.StructField("is_category", T.BooleanType()),
        T.StructField("tag_kind", T.StringType()),
    ]
)
MEDIA_TAGS = T.StructType([T.StructField("media_id", T.LongType()), T.StructField("tag_id", T.LongType())])
TAG_PAIR = T.StructType([T.StructField("en", T.StringType()), T.StructField("ja", T.StringType())])
ANALYSIS = T.StructType([T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(TAG_PAIR)), T.StructField("descriptive_tags", T.ArrayType(TAG_PAIR))])
PROGRESS = T.StructType(
    [
        T.StructField("series_key", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("total", T.LongType()),
        T.StructField("current", T.LongType()),
        T.StructField("current_file", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_count", T.LongType()),
        T.StructField("is_paused", T.BooleanType()),
    ]
)

#: Settings a new catalogue has.
DEFAULT_SETTINGS = {
    "ollama_url": "http://localhost:11434",
    "ollama_model": "qwen3-vl:30b",
    "ollama_text_model": "qwen3:14b",
    "llm_provider": "ollama",
    "gemini_model": "gemini-2.0-flash",
    "gemini_text_model": "gemini-3.5-flash-lite",
    "openai_base_url": "https://api.openai.com/v1",
    "openai_model": "gpt-4o-mini",
    "openai_text_model": "gpt-4o-mini",
    "claude_model": "claude-3-5-sonnet-20241022",
    "claude_text_model": "claude-3-5-haiku-20241022",
    "ext_llm_max_batch_items": "50",
    "ext_llm_retry_enabled": "true",
    "ext_llm_retry_max_attempts": "3",
    "ext_llm_retry_delay_sec": "2",
    "ui_language": "ja",
    "ffmpeg_notice_enabled": "true",
    "tag_granularity": "atomic",
    "force_detailed_prompt": "false",
    "ollama_num_ctx": "0",
    "ollama_max_image_edge": "1536",
    "llm_debug_logging": "false",
}
#: Categories and their Japanese labels.
CATEGORIES = {
    "screenshot": "スクリーンショット",
    "document": "書類・文書",
    "landscape": "風景・自然",
    "food": "料理・食べ物",
    "character": "キャラクター",
    "animal": "動物・ペット",
    "person": "人物・顔写真",
    "item_product": "商品・雑貨",
    "art_illustration": "イラスト・アート",
    "text_heavy": "文字主体",
    "tech": "IT・技術",
    "other": "その他",
}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def seeded_settings(settings: DataFrame) -> DataFrame:
    """Defaults for keys that settings lacks; present values stay."""
    new = settings.sparkSession.createDataFrame(list(DEFAULT_SETTINGS.items()), SETTINGS)
    return settings.select("key", "value").unionByName(new.join(settings, "key", "left_anti"))


def seeded_tags(tags: DataFrame) -> DataFrame:
    """The fixed categories: missing ones are added, present ones get their label and kind back."""
    seeds = tags.sparkSession.createDataFrame(list(CATEGORIES.items()), "seed_name string, seed_ja string")
    both = tags.join(F.broadcast(seeds), F.col("name") == F.col("seed_name"), "full")
    top = F.coalesce(F.max("id").over(_whole()), F.lit(0))
    order = F.row_number().over(_whole().orderBy(F.col("id").isNotNull(), "seed_name"))
    seeded = F.col("seed_name").isNotNull()
    return both.select(
        F.coalesce("id", top + order).alias("id"),
        F.coalesce("name", "seed_name").alias("name"),
        F.when(seeded, F.col("seed_ja")).otherwise(F.col("name_ja")).alias("name_ja"),
        (seeded | F.coalesce("is_category", F.lit(False))).alias("is_category"),
        F.coalesce("tag_kind", F.lit("basic")).alias("tag_kind"),
    )


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def migrated_tags(tags: DataFrame) -> DataFrame:
    """Tags as stored by older versions: columns that are missing get their defaults."""
    for name, default in (("name_ja", F.lit(None).cast("string")), ("is_category", F.lit(False)), ("tag_kind", F.lit("basic"))):
        tags = tags.withColumn(name, F.coalesce(F.col(name), default) if name in tags.columns else default)
    return tags.select([F.col(f.name).cast(f.dataType) for f in TAGS.fields])
