"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources.shared import shared_path, written

__all__ = ["F", "crc_of_id", "fresh", "shared_path", "ship", "slices", "smallest_hashes", "table", "written"]

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver found it.

    On a cluster the package is installed or passed with --py-files; this only adds a path.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def smallest_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows (all, if fewer) with the smallest hashes of key.

    A bound on the hash from a count leaves about twice as many to order, however many there were.
    """
    h = F.xxhash64(key)
    share = min(1.0, (2 * most + 200) / max(1, rows.count()))
    return rows.where(h <= min(int(share * 2**64) - 2**63, 2**63 - 1)).orderBy(h, key).limit(most)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20, most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part come to about most_bytes (one long text stays whole)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > most_bytes or i - begin >= most_rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)
