"""JSON caches and streams of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

CHUNK = "status string, completed long, total long, error string"


def save_cache(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_cache(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What was saved; no rows if there is nothing or it can't be read."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def clear_cache(spark: SparkSession, path: str, schema: T.StructType) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def decoded_chunks(lines: DataFrame, key: str = "stream", order: str = "line_no") -> DataFrame:
    """Download progress from JSON lines (key, order, value): blank and broken lines go, the last known
    status, completed and total are carried on, an error ends its stream."""
    parsed = lines.where(F.trim("value") != "").withColumn("v", F.from_json("value", CHUNK, {"mode": "PERMISSIVE"})).where(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{"))
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max(F.col("v.error").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = lambda c, d: F.coalesce(F.last(f"v.{c}", ignorenulls=True).over(so_far), F.lit(d))
    rows = parsed.withColumn("__ended", F.coalesce(ended, F.lit(False))).withColumn("completed", carried("completed", 0)).withColumn("total", carried("total", 0)).withColumn("status", carried("status", "Starting download..."))
    error = F.col("v.error")
    share = F.when(error.isNull() & (F.col("total") > 0), F.least(F.lit(100.0), F.col("completed") / F.col("total") * 100)).otherwise(0.0)
    return rows.where(~F.col("__ended")).select(key, order, F.when(error.isNotNull(), "error").otherwise(F.col("status")).alias("status"), "completed", "total", share.alias("percent"), error.isNotNull().alias("done"), error.alias("error"))
