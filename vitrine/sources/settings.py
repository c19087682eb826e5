"""Settings: a small table of strings with typed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Settings:
    def __init__(self, table: DataFrame):
        self.values = {r.key: r.value for r in table.select("key", "value").collect()}

    def text(self, key: str, default: str) -> str:
        return self.values.get(key, default)

    def number(self, key: str, default: int) -> int:
        try:
            return int(self.values[key])
        except (KeyError, ValueError):
            return default

    def flag(self, key: str, default: bool = False) -> bool:
        return self.values[key] == "true" if key in self.values else default


def as_map(table: DataFrame) -> DataFrame:
    return table.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("settings"))
