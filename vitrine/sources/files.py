"""Folder listings through Spark's binaryFile source, and the files that scans register."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import scalar as S


def _plain(path):
    return F.regexp_replace(path, "^file:/*", "/")


def listed(spark: SparkSession, folders: list[str], hashes: bool = True) -> DataFrame:
    """Supported files below the folders, each once: file_path, parent_folder, file_size,
    file_modified_at and, if asked, file_hash of the first 64 KiB. Without hashes no content is read.
    Files of no bytes are not listed: Spark's source skips them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folders)
    path = _plain(F.col("path"))
    rows = files.where(S.is_supported("path"))
    parts = F.split(path, "/")
    facts = [path.alias("file_path"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("parent_folder"), F.col("length").alias("file_size"), F.unix_seconds("modificationTime").alias("file_modified_at")]
    if hashes:
        facts.append(S.light_hash("content").alias("file_hash"))
    return rows.select(*facts).dropDuplicates(["file_path"])


def thumbnail_path(folder: str, path: str = "file_path"):
    """Where the thumbnail of a file is kept: named by the path's hash."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.sha2(F.col(path).cast("binary"), 256), F.lit(".jpg"))


def thumbnails(files: DataFrame, make: Callable[[str], bool], folder: str) -> DataFrame:
    """(file_path, thumbnail_path): '' where make(path) fails. make runs on executors, once a file."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            pdf["thumbnail_path"] = [t if make(p) else "" for p, t in zip(pdf["file_path"], pdf["thumbnail_path"], strict=True)]
            yield pdf

    return files.select("file_path", thumbnail_path(folder).alias("thumbnail_path")).mapInPandas(run, "file_path string, thumbnail_path string")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a log file, in its order."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value")).where("value <> '' OR line_no > 0")


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines (value) that append_log adds to a folder, for reports.log_filter()."""
    return spark.readStream.text(folder)


def log_line(level: str, message: str, now: str) -> str:
    return f"[{now}] [{level}] {message}"


def append_log(spark: SparkSession, path: str, lines: list[str]) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
