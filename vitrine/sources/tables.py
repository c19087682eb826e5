"""Versioned table folders: a write makes a new version and then moves the pointer to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


class Store:
    """Tables under one folder. A read sees the last version whose write ended; a job may read a table
    and write its next version, which overwriting in place would not allow."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.schema("version long, folder string").json(f"{self.root}/{name}/_pointer")
        except AnalysisException:
            return None

    def read(self, name: str) -> DataFrame:
        found = self._pointers(name)
        last = found.orderBy(F.desc("version")).first() if found is not None else None
        if last is None:
            raise LookupError(f"no table {name}")
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}/{last.folder}")

    def write(self, name: str, df: DataFrame) -> None:
        found = self._pointers(name)
        last = found.agg(F.max("version")).first()[0] if found is not None else None
        folder = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{folder}")
        self.spark.createDataFrame([((last or 0) + 1, folder)], "version long, folder string").coalesce(1).write.mode("append").json(f"{self.root}/{name}/_pointer")
