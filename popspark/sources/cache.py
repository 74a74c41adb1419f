"""A response cache: an append-only JSON log by model; the last entry of a key wins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, text string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, at timestamp"


class NullCache:
    """Remembers nothing: for runs that are to be fresh."""

    hits = misses = 0
    hit_rate = 0.0

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMA)

    def lookup(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        return asked.join(self.load(), "key"), asked

    def append(self, completions: DataFrame) -> None:
        pass

    def __len__(self) -> int:
        return 0


class ResponseCache:
    """hits and misses count the lookups that were recorded."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.hits = self.misses = 0
        self.spark, self.path = spark, f"{path.rstrip('/')}/{re.sub(r'[^A-Za-z0-9._-]', '_', model)}"

    def load(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(SCHEMA).json(self.path)
        except Exception as e:  # an empty cache has no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)
        last = F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), "at").alias("x")
        return rows.where("key is not null").groupBy("key").agg(last).select("key", "x.*")

    def lookup(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hits with their completion, misses); asked: key and more."""
        held = self.load()
        return asked.join(held, "key"), asked.join(held, "key", "left_anti")

    def record(self, asked: int, missed: int) -> None:
        self.hits, self.misses = self.hits + asked - missed, self.misses + missed

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0

    def __len__(self) -> int:
        return self.load().count()

    def append(self, completions: DataFrame) -> None:
        completions.withColumn("at", F.current_timestamp()).write.mode("append").json(self.path)
