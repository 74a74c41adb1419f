"""Attributes with declared, ordered levels: banding, crosswalks, validation, encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Taxonomy:
    """attribute -> levels in order. Passed in wherever levels matter, so that operators fit any data."""

    attributes: Mapping[str, tuple[str, ...]]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(a, level, i) for a, levels in self.attributes.items() for i, level in enumerate(levels)]
        return spark.createDataFrame(rows, "attribute string, level string, level_ix int")

    def cell_count(self, attributes: Sequence[str]) -> int:
        return prod(len(self.attributes[a]) for a in attributes)

    def violations(self, df: DataFrame, attribute: str) -> DataFrame:
        """Values that aren't levels; null isn't a violation."""
        return df.where(F.col(attribute).isNotNull() & ~F.col(attribute).isin(*self.attributes[attribute])).groupBy(F.col(attribute).alias("value")).agg(F.count("*").alias("rows"))

    def code(self, attribute: str, value: Column) -> Column:
        """Position of the level; null for anything else."""
        return F.nullif(F.array_position(F.array(*[F.lit(x) for x in self.attributes[attribute]]), value), F.lit(0)) - 1


def band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-open bands: label i from edges[i] on; null below the first edge."""
    out = F.lit(None).cast("string")
    for edge, label in zip(edges, labels, strict=True):
        out = F.when(value >= edge, F.lit(label)).otherwise(out)
    return out


def crosswalk(value: Column, codes: Mapping, default: str | None = None) -> Column:
    """Exact code map. Unmapped: default; null stays null."""
    out = F.when(value.isNotNull(), F.lit(default).cast("string"))
    for code, label in codes.items():
        out = F.when(value == F.lit(code), F.lit(label)).otherwise(out)
    return out
